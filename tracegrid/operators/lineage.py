"""Lineage: the cells behind rows, checks that they give the number, and their compact form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.order import numbered
from tracegrid.plans.model import Citation, VerificationError

TOLERANCE = 1e-6


def column_letter(c: Column) -> Column:
    """Spreadsheet letters of a 1-based column number up to ZZZ."""
    one = lambda v: F.char(F.lit(65) + F.pmod(v, F.lit(26)))
    i = c - 1
    two = F.concat(one(F.floor(i / 26) - 1), one(i))
    three = F.concat(one(F.floor((i - 26) / 676) - 1), one(F.floor((i - 26) / 26)), one(i))
    return F.when(c <= 26, one(i)).when(c <= 702, two).otherwise(three)


def a1_column(a1: Column) -> Column:
    return F.regexp_extract(a1, r"^([A-Z]+)[0-9]+$", 1)


def a1_row(a1: Column) -> Column:
    return F.nullif(F.regexp_extract(a1, r"^[A-Z]+([0-9]+)$", 1), F.lit("")).cast("int")


def citations(rows: DataFrame, cell_map: DataFrame, column: str) -> DataFrame:
    """Receipts of one column for a set of ``__row_id``: a semi-join, in sheet, column and row order."""
    found = cell_map.filter(F.col("column_name") == column).join(rows.select(F.col("__row_id").alias("row_id")), "row_id", "left_semi")
    order = ["sheet", F.length(a1_column(F.col("a1"))), a1_column(F.col("a1")), a1_row(F.col("a1"))]
    return found.select("sheet", "a1", "raw_value", "formula", "row_id").orderBy(*order)


def first_citation(rows: DataFrame, cell_map: DataFrame, column: str) -> DataFrame:
    """The one cell that a group's label cites: that of its first row."""
    found = cell_map.filter(F.col("column_name") == column).join(rows.select(F.col("__row_id").alias("row_id")), "row_id", "left_semi")
    return found.agg(F.min_by(F.struct("sheet", "a1", "raw_value", "formula"), "row_id").alias("c")).select("c.*")


def grouped_citations(base: DataFrame, cell_map: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Cited cells of every group at once: the group's keys beside each cell, a row for each, however many a group has."""
    cells = cell_map.filter(F.col("column_name") == column).select(F.col("row_id").alias("__row_id"), "sheet", "a1", "raw_value", "formula")
    return base.select(*keys, "__row_id").join(cells, "__row_id").drop("__row_id")


def citation_counts(base: DataFrame, cell_map: DataFrame, keys: list[str], column: str) -> DataFrame:
    cells = cell_map.filter(F.col("column_name") == column).select(F.col("row_id").alias("__row_id"))
    return base.select(*keys, "__row_id").join(cells, "__row_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cites"))


def lineage_edges(base: DataFrame, keys: list[str], total: str = "total") -> DataFrame:
    """The value DAG of a share as edges parent → child: the total is one node over groups, groups over rows.

    Shared nodes stand once, so the edges grow with the rows and not with groups times rows.
    """
    group = F.concat_ws("|", *[F.col(k) for k in keys])
    rows = base.select(group.alias("parent"), F.concat(F.lit("row:"), F.col("__row_id").cast("string")).alias("child"))
    top = base.select(F.lit(total).alias("parent"), group.alias("child")).distinct()
    return rows.unionByName(top)


def cited_aggregate(cells: DataFrame) -> DataFrame:
    """sum, avg, min, max and count of the numbers in cited cells; other cells are skipped."""
    number = F.expr("try_cast(raw_value AS DOUBLE)")
    return cells.select(number.alias("x")).filter("x IS NOT NULL").agg(F.sum("x").alias("sum"), F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("count"))


def lineage_check(value: DataFrame, cells: DataFrame, agg: str) -> DataFrame:
    """value, cited, ok: whether the cited cells give the value, within a relative tolerance."""
    cited = cited_aggregate(cells).select(F.col(agg).cast("double").alias("cited"))
    both = value.select(F.col(value.columns[-1]).cast("double").alias("value")).crossJoin(cited)
    near = F.abs(F.col("value") - F.col("cited")) <= F.lit(TOLERANCE) * F.greatest(F.lit(1.0), F.abs("value"))
    return both.withColumn("ok", F.coalesce(near, F.col("value").isNull() & F.col("cited").isNull()))


def collapse_ranges(cells: DataFrame) -> DataFrame:
    """Cells as ranges: runs of consecutive rows in one column of one sheet, ``ref`` and ``n_cells``.

    Runs end where rows do not follow each other; addresses that are no A1 stay as they are.
    """
    own = cells.select("sheet", "a1").distinct().select("sheet", "a1", a1_column(F.col("a1")).alias("letter"), a1_row(F.col("a1")).alias("r"))
    runs = numbered(own.filter("r IS NOT NULL"), ["sheet", "letter"], ["r"], "k").withColumn("island", F.col("r") - F.col("k"))
    ref = F.when(F.min("r") == F.max("r"), F.concat("letter", F.min("r").cast("string"))).otherwise(
        F.concat(F.col("letter"), F.min("r").cast("string"), F.lit(":"), F.col("letter"), F.max("r").cast("string"))
    )
    good = runs.groupBy("sheet", "letter", "island").agg(ref.alias("ref"), F.count(F.lit(1)).alias("n_cells"))
    odd = own.filter("r IS NULL").select("sheet", F.col("a1").alias("ref"), F.lit(1).cast("long").alias("n_cells"))
    return good.select("sheet", "ref", "n_cells").unionByName(odd)


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """The cells of ranges: the inverse of ``collapse_ranges``."""
    part = lambda n: F.regexp_extract("ref", r"^([A-Z]+)([0-9]+)(?::[A-Z]+([0-9]+))?$", n)
    first, last = part(2), F.when(part(3) == "", part(2)).otherwise(part(3))
    rows = F.when(part(2) != "", F.sequence(first.cast("int"), last.cast("int")))
    out = ranges.select("sheet", "ref", part(1).alias("letter"), F.explode_outer(F.when(part(2) != "", rows)).alias("r"))
    return out.select("sheet", F.coalesce(F.concat("letter", F.col("r").cast("string")), "ref").alias("a1"))


#: More cells than this are cited as ranges, for no reader goes through them one by one.
MOST_CELLS = 10_000


def spans(cells: DataFrame) -> DataFrame:
    """The least rectangle of one column that holds all cited cells of that column: a superset, one row for each sheet and column."""
    own = cells.select("sheet", a1_column(F.col("a1")).alias("letter"), a1_row(F.col("a1")).alias("r"))
    ref = F.concat(F.col("letter"), F.min("r").cast("string"), F.lit(":"), F.col("letter"), F.max("r").cast("string"))
    return own.groupBy("sheet", "letter").agg(ref.alias("ref"), F.count(F.lit(1)).alias("n_cells")).select("sheet", "ref", "n_cells")


def as_citations(cells: DataFrame) -> list[Citation]:
    """The cells of one finished value, for a reader.

    Up to ``MOST_CELLS`` cells come one by one; beyond that their ranges, and where even those are more, the span
    of each column. So what reaches the driver is bounded, whatever the value rests on.
    """
    few = cells.limit(MOST_CELLS + 1).collect()
    if len(few) <= MOST_CELLS:
        return [Citation(r["sheet"], r["a1"], r["raw_value"], r["formula"]) for r in few]
    ranges = collapse_ranges(cells).orderBy("sheet", "ref").limit(MOST_CELLS + 1).collect()
    if len(ranges) > MOST_CELLS:
        ranges = spans(cells).orderBy("sheet", "ref").collect()
    return [Citation(r["sheet"], r["ref"], None, None) for r in ranges]


def verify_cells(value: float | None, cells: DataFrame, cited: list[Citation], agg: str) -> None:
    """``verify`` for a value whose citations may be ranges: those are added up where the cells are."""
    if value is None or not any(":" in c.a1 for c in cited):
        return verify(value, cited, agg)
    row = cited_aggregate(cells).first() if agg != "count" else {"count": cells.count()}
    got = row[agg]
    if got is None or abs(got - value) > TOLERANCE * max(1.0, abs(value)):
        raise VerificationError(f"the cited cells give {got}, the answer says {value}")
    return None


def verify(value: float | None, cells: list[Citation], agg: str) -> None:
    """Raise unless the cited cells give the value; the least and greatest must be among them."""
    numbers = []
    for c in cells:
        try:
            numbers.append(float(c.raw_value))  # type: ignore[arg-type]
        except (TypeError, ValueError):
            continue
    if value is None:
        return
    if agg == "count":
        got: float | None = float(len(cells))
    elif not numbers:
        got = None
    else:
        got = {"sum": sum(numbers), "avg": sum(numbers) / len(numbers), "min": min(numbers), "max": max(numbers)}[agg]
    near = lambda x: abs(x - value) <= TOLERANCE * max(1.0, abs(value))
    ok = got is not None and (any(map(near, numbers)) if agg in ("min", "max") else near(got))
    if not ok:
        raise VerificationError(f"the cited cells give {got}, the answer says {value}")


NUMBER = re.compile(r"\d(?:[\d,\-/.]*\d)?")


def unbacked_numbers(text: str, backing: list[str]) -> list[str]:
    """Numbers of a text that occur in none of the backing strings."""
    known = {n for b in backing for n in NUMBER.findall(b)}
    return [n for n in NUMBER.findall(text) if n not in known]
