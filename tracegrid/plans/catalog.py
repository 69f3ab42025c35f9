"""The catalog: structure of a tidy table. Labels of dimensions are listed, values of measures never."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
LABEL_CAP = 50
PERIOD_PATTERNS = (
    r"^\d{4}-\d{2}$",
    r"^\d{4}-\d{4}$",
    r"^\d{4}$",
    r"^Q[1-4][ -]?\d{2,4}$",
    r"^[A-Z][a-z]{2}-\d{2,4}$",
    r"^\d{4}-\d{2}-\d{2}$",
)
NUMERIC = ("double", "bigint", "int", "float", "decimal")


def looks_periodic(labels: list[str]) -> bool:
    """At least three labels of which four fifths follow one period pattern."""
    if len(labels) < 3:
        return False
    best = max(sum(re.search(p, str(v)) is not None for v in labels) for p in PERIOD_PATTERNS)
    return best >= 0.8 * len(labels)


@dataclass
class Column:
    name: str
    dtype: str
    nulls: int = 0
    distinct: int = 0
    labels: list[str] = field(default_factory=list)
    scope: bool = False
    aliases: dict[str, str] = field(default_factory=dict)
    unit: str | None = None
    description: str = ""
    counted: bool = True  # whether ``distinct`` was counted, not sketched

    @property
    def is_measure(self) -> bool:
        return self.dtype.split("(")[0] in NUMERIC

    @property
    def internal(self) -> bool:
        return self.name.startswith("__") or self.name == "row_kind"


@dataclass
class Catalog:
    table: str
    columns: list[Column]
    measure: str
    unit: str | None = None
    layout: str = "crosstab"
    file_defaults: dict[str, str] = field(default_factory=dict)
    absent: tuple[str, ...] = ()
    description: str = ""
    notes: tuple[str, ...] = ()
    entity: str | None = None
    period: str | None = None
    unknown_annotations: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def defaults(self) -> dict[str, str]:
        """Filters that every plan gets unless it mentions their column."""
        own = {"row_kind": "entity"} if "row_kind" in self.names else {}
        return own | {k: v for k, v in self.file_defaults.items() if k in self.names}

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def labels_for(self, name: str) -> list[str]:
        c = self.column(name)
        return c.labels if c else []

    @property
    def scopes(self) -> list[Column]:
        return [c for c in self.columns if c.scope]

    def to_prompt(self) -> str:
        """The catalog as a model sees it: names, types and labels, no values."""
        lines = [f"table {self.table}, measure {self.measure}" + (f" in {self.unit}" if self.unit else "")]
        if self.description:
            lines.append(self.description)
        for c in self.columns:
            about = f"labels {', '.join(c.labels)}" if c.labels else f"{'' if c.counted else 'about '}{c.distinct} distinct"
            lines.append(f"- {c.name} {c.dtype}: {about}" + (", a scope" if c.scope else "") + (f"; {c.description}" if c.description else ""))
        if self.defaults:
            lines.append("defaults: " + ", ".join(f"{k}={v}" for k, v in self.defaults.items()))
        if self.absent:
            lines.append("not in this file: " + ", ".join(self.absent))
        lines += [f"note: {n}" for n in self.notes]
        return "\n".join(lines)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_statistics(table: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, nulls, distinct for every visible column, in one job over the table.

    Exact counts multiply the rows by the columns on their way to the shuffle; sketches do not.
    """
    names = [c for c in table.columns if not c.startswith("__")]
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count_if(F.col(_quoted(c)).isNull()).alias(f"n{i}"), count(F.col(_quoted(c))).alias(f"d{i}")]
    one = table.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def label_listing(table: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, label: the distinct non-null labels of some string columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(_quoted(c)).cast("string").alias("label")) for c in columns])
    return table.select(F.inline(pairs)).filter("label IS NOT NULL").distinct()


def build_catalog(
    table: DataFrame,
    name: str,
    measure: str,
    *,
    layout: str = "crosstab",
    defaults: dict[str, str] | None = None,
    scopes: dict[str, bool] | None = None,
    aliases: dict[str, dict[str, str]] | None = None,
    units: dict[str, str] | None = None,
    absent: tuple[str, ...] = (),
    descriptions: dict[str, str] | None = None,
    description: str = "",
    notes: tuple[str, ...] = (),
    entity: str | None = None,
    period: str | None = None,
) -> Catalog:
    """Two jobs: sketched statistics of all columns, then the labels of those that seem to have few.

    Where labels are listed the count is exact; elsewhere it is the sketch's, and the column says so (``counted``).
    ``notes`` are what the sheet's own notes say, ``description`` and ``descriptions`` what a person says of it.
    """
    stats = {r["column_name"]: r for r in column_statistics(table, exact=False).collect()}
    types = dict(table.dtypes)
    few = [c for c, r in stats.items() if types[c] == "string" and r["distinct"] <= 1.3 * LABEL_CAP]
    labels: dict[str, list[str]] = {c: [] for c in few}
    if few:
        for r in label_listing(table, few).collect():
            labels[r["column_name"]].append(r["label"])
    columns = []
    for c, r in stats.items():
        count = len(labels[c]) if c in labels else r["distinct"]
        own = sorted(labels.get(c, [])) if count <= LABEL_CAP else []
        scope = (scopes or {}).get(c, layout == "crosstab" and looks_periodic(own))
        columns.append(Column(c, types[c], r["nulls"], count, own, scope, (aliases or {}).get(c, {}), (units or {}).get(c), (descriptions or {}).get(c, ""), c in labels))
    unknown = tuple(sorted(k for k in {*(defaults or {}), *(scopes or {}), *(aliases or {}), *(units or {}), *(descriptions or {})} if k not in stats))
    return Catalog(name, columns, measure, (units or {}).get(measure), layout, defaults or {}, absent, description, notes, entity, period, unknown)
