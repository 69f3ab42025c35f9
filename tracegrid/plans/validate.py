"""Checks that a plan passes before any data is read."""

from __future__ import annotations

import math
import re
from dataclasses import replace

from tracegrid.plans.catalog import Catalog
from tracegrid.plans.model import Condition, DerivedPlan, MultiStepPlan, Part, PlanFailure, QueryPlan

HOLE = re.compile(r"\{(v\d+)\}")


def with_defaults(filters: tuple[Condition, ...], catalog: Catalog) -> tuple[Condition, ...]:
    """The filters with the catalog's defaults for columns that none of them mentions."""
    named = {f.column for f in filters}
    return filters + tuple(Condition(c, "=", v) for c, v in catalog.defaults.items() if c not in named)


def _known(name: str, catalog: Catalog, where: str) -> None:
    if name not in catalog.names:
        raise PlanFailure(f"{where} names {name!r}, which is no column of {catalog.table}")


def _checked_filters(filters: tuple[Condition, ...], catalog: Catalog) -> None:
    for f in filters:
        _known(f.column, catalog, "a filter")
        if catalog.column(f.column).is_measure:  # type: ignore[union-attr]
            try:
                ok = math.isfinite(float(f.value))
            except ValueError:
                ok = False
            if not ok:
                raise PlanFailure(f"{f.column} holds numbers, and {f.value!r} is none")
    kinds = [f for f in filters if f.column == "row_kind" and f.op == "=" and f.value != "entity"]
    entity = catalog.columns[0].name if catalog.columns and catalog.layout == "crosstab" else None
    if kinds and any(f.column == entity for f in filters):
        raise PlanFailure(f"only entity rows have a {entity}; rows of kind {kinds[0].value} have none")


def _checked_metric(agg: str, column: str, catalog: Catalog) -> None:
    _known(column, catalog, "the metric")
    if agg in ("sum", "avg") and not catalog.column(column).is_measure:  # type: ignore[union-attr]
        raise PlanFailure(f"{agg} needs numbers, and {column} holds text")


def check_slots(narration: str, slots: list[str]) -> None:
    holes = HOLE.findall(narration)
    if sorted(set(holes)) != sorted(slots):
        raise PlanFailure(f"the sentence has holes {sorted(set(holes))}, the plan fills {slots}")


def check_query(plan: QueryPlan, catalog: Catalog) -> QueryPlan:
    """The plan with defaults applied, or PlanFailure."""
    _checked_metric(plan.metric.agg, plan.metric.column, catalog)
    for g in plan.group_by:
        _known(g, catalog, "the grouping")
    if plan.metric.agg in ("min", "max") and plan.group_by and plan.limit:
        raise PlanFailure("the least or greatest of least or greatest cells is no ranking of groups; use sum or avg")
    full = replace(plan, filters=with_defaults(plan.filters, catalog))
    _checked_filters(full.filters, catalog)
    check_slots(plan.narration, plan.slots)
    return full


def check_part(part: Part, catalog: Catalog) -> Part:
    _checked_metric(part.metric.agg, part.metric.column, catalog)
    full = replace(part, filters=with_defaults(part.filters, catalog))
    _checked_filters(full.filters, catalog)
    return full


def derivation_problem(plan: DerivedPlan, catalog: Catalog) -> str | None:
    """Why the two parts cannot be combined as asked, if they cannot.

    A share compares a part with a whole: what both filter agrees and the whole filters less. A change or
    difference holds everything fixed but one column, the scope where the file has one.
    """
    of, by = (next(p for p in plan.parts if p.name == n) for n in (plan.of, plan.by))
    a = {f.column: (f.op, f.value) for f in of.filters}
    b = {f.column: (f.op, f.value) for f in by.filters}
    differ = sorted(c for c in a.keys() & b.keys() if a[c] != b[c])
    if plan.op == "divide":
        if differ:
            return f"part and whole disagree on {', '.join(differ)}"
        return "part and whole are the same" if a.keys() == b.keys() else None
    if a.keys() != b.keys():
        return f"one side filters {', '.join(sorted(a.keys() ^ b.keys()))} and the other does not"
    if len(differ) != 1:
        return "the two sides must differ in exactly one column"
    scopes = [c.name for c in catalog.scopes]
    if scopes and differ[0] not in scopes:
        return f"the two sides differ in {differ[0]} instead of {' or '.join(scopes)}"
    return None


def check_derived(plan: DerivedPlan, catalog: Catalog) -> DerivedPlan:
    if problem := derivation_problem(plan, catalog):
        raise PlanFailure(problem)
    check_slots(plan.narration, ["v1"])
    return replace(plan, parts=tuple(check_part(p, catalog) for p in plan.parts))


def check_multi_step(plan: MultiStepPlan, catalog: Catalog) -> MultiStepPlan:
    _checked_metric(plan.inner, plan.measure, catalog)
    _known(plan.group, catalog, "the grouping")
    to, start = with_defaults(plan.to, catalog), with_defaults(plan.start, catalog) if plan.start else ()
    _checked_filters(to + start, catalog)
    return replace(plan, to=to, start=start)
