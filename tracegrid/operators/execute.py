"""Plans as DataFrames. A value and its provenance share one filtered table, so they cannot drift apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.plans.catalog import Catalog
from tracegrid.plans.model import Aggregate, Condition, DerivedPlan, MultiStepPlan, Part, QueryPlan
from tracegrid.plans.validate import check_derived, check_multi_step, check_query


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def predicate(f: Condition, catalog: Catalog) -> Column:
    """A comparison in the column's own type; nulls never match."""
    own = catalog.column(f.column)
    value: Any = float(f.value) if own and own.is_measure else f.value
    left, right = quoted(f.column), F.lit(value)
    return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[f.op]


def all_of(filters: tuple[Condition, ...], catalog: Catalog) -> Column:
    return reduce(lambda a, b: a & b, [predicate(f, catalog) for f in filters], F.lit(True))


def aggregate(m: Aggregate, where: Column | None = None) -> Column:
    """The metric, over the rows that ``where`` admits. Sums of no rows are null, counts 0."""
    c = quoted(m.column) if where is None else F.when(where, quoted(m.column))
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[m.agg](c)


@dataclass
class Compiled:
    plan: QueryPlan
    base: DataFrame
    value: DataFrame

    def provenance(self, group_values: tuple[Any, ...] = ()) -> DataFrame:
        """The ``__row_id`` of the rows behind the value, or behind one group of it; null groups match."""
        if len(group_values) != len(self.plan.group_by):
            raise ValueError("a grouped plan needs a value for each of its group columns")
        rows = self.base
        for c, v in zip(self.plan.group_by, group_values):
            rows = rows.filter(quoted(c).eqNullSafe(F.lit(v)))
        return rows.select("__row_id")


def compile_query(plan: QueryPlan, catalog: Catalog, table: DataFrame) -> Compiled:
    """Filters, grouping, metric, order and limit; slots are named v1, v2, … in select order.

    Nulls sort last either way, and group columns break ties, so a top row is always the same row.
    """
    full = check_query(plan, catalog)
    base = table.filter(all_of(full.filters, catalog))
    slots = full.slots
    metric = aggregate(full.metric).alias(slots[-1])
    if full.group_by:
        value = base.groupBy(*[quoted(g).alias(s) for g, s in zip(full.group_by, slots)]).agg(metric)
    else:
        value = base.agg(metric)
    if full.sort != "none":
        lead = F.col(slots[-1])
        value = value.orderBy(lead.asc_nulls_last() if full.sort == "asc" else lead.desc_nulls_last(), *slots[:-1])
    elif full.group_by and full.limit:
        value = value.orderBy(*slots[:-1])
    return Compiled(full, base, value.limit(full.limit) if full.limit else value)


def combine(op: str, of: Column, by: Column, scale: float) -> Column:
    """The arithmetic of a derivation; a zero denominator gives null, a difference needs none."""
    if op == "subtract":
        return (of - by) * F.lit(scale)
    top = of if op == "divide" else of - by
    return F.try_divide(top, by) * F.lit(scale)


@dataclass
class CompiledDerived:
    plan: DerivedPlan
    parts: dict[str, DataFrame]
    value: DataFrame

    def provenance(self, part: str) -> DataFrame:
        return self.parts[part].select("__row_id")


def compile_derived(plan: DerivedPlan, catalog: Catalog, table: DataFrame) -> CompiledDerived:
    """Both parts as conditional aggregates over one scan: columns of, by and v1."""
    full = check_derived(plan, catalog)
    where = {p.name: all_of(p.filters, catalog) for p in full.parts}
    by_name: dict[str, Part] = {p.name: p for p in full.parts}
    either = reduce(lambda a, b: a | b, where.values())
    pick = lambda name, alias: aggregate(by_name[name].metric, where[name]).alias(alias)
    both = table.filter(either).agg(pick(full.of, "of"), pick(full.by, "by"))
    value = both.select("of", "by", combine(full.op, F.col("of"), F.col("by"), full.scale).alias("v1"))
    return CompiledDerived(full, {n: table.filter(w) for n, w in where.items()}, value)


def share_of_whole(base: DataFrame, measure: str, keys: list[str], within: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Each group's value, the shared total (one row for each ``within``) and the share in percent."""
    each = base.groupBy(*[quoted(k) for k in [*within, *keys]]).agg(F.sum(quoted(measure)).alias("value"))
    whole = each.groupBy(*[quoted(k) for k in within]).agg(F.sum("value").alias("total"))
    # one row for each ``within``, or a single one: the planner broadcasts it by its size
    both = each.join(whole, list(within)) if within else each.crossJoin(whole)
    return both.withColumn("share", F.try_divide("value", "total") * 100)


@dataclass
class CompiledMultiStep:
    plan: MultiStepPlan
    groups: DataFrame
    value: DataFrame
    rows: DataFrame


def compile_multi_step(plan: MultiStepPlan, catalog: Catalog, table: DataFrame) -> CompiledMultiStep:
    """Per group, the level under ``to`` or its change against ``start``; then one aggregate over groups.

    Groups without a value drop out. ``rows`` are the ids behind the groups that stay: exact lineage.
    """
    full = check_multi_step(plan, catalog)
    to = all_of(full.to, catalog)
    start = all_of(full.start, catalog) if full.start else F.lit(False)
    key = quoted(full.group).alias("group")
    inner = lambda w, name: aggregate(Aggregate(full.inner, full.measure), w).alias(name)
    both = table.filter(to | start).groupBy(key).agg(inner(to, "to"), inner(start, "start"))
    a, b = F.col("to"), F.col("start")
    step = {"level": a, "difference": a - b, "ratio": F.try_divide(a, b), "percent_change": F.try_divide(a - b, b) * 100}[full.operation]
    groups = both.withColumn("value", step).filter("value IS NOT NULL")
    value = groups.agg(aggregate(Aggregate(full.outer, "value")).alias("v1"))
    kept = groups.select(F.col("group").alias("__g"))
    rows = table.filter(to | start).join(kept, quoted(full.group).eqNullSafe(F.col("__g")), "left_semi").select("__row_id")
    return CompiledMultiStep(full, groups, value, rows)


def formatted(value: Any) -> str:
    return f"{value:,.2f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)
