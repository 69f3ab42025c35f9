"""Profiles of sheets, straight from their cells: what is where, and where rows change shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.order import numbered, with_neighbours

# Words that mark totals and sections.
TOTAL_WORDS = r"(?i)\b(total|totals|sum|subtotal|grand|all india|overall)\b"
SECTION_HINT = r"(?i)^\s*(region|zone|area|group|category|section)\b[\s:\-–]"


def mark() -> Column:
    """One sign for a cell: # number, f formula, T text."""
    return F.when(F.col("kind") == "f", "f").when(F.col("num").isNotNull(), "#").otherwise("T")


def row_profile(cells: DataFrame) -> DataFrame:
    """Per row: filled, numeric, label (first text), merged, total, section, and marks such as ``T##.f``.

    All rows are profiled; only what is shown to a reader is cut.
    """
    by = ["file", "sheet", "r"]
    own = cells.withColumn("m", mark())
    each = own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("filled"),
        F.count_if(F.col("m") != "T").alias("numeric"),
        F.min_by("text", F.when(F.col("m") == "T", F.col("c"))).alias("label"),
        F.max("merged").alias("merged"),
        F.max("c").alias("last_c"),
        F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("at"),
    )
    marks = F.array_join(F.transform(F.sequence(F.lit(1), "last_c"), lambda c: F.coalesce(F.col("at")[c], F.lit("."))), "")
    label = F.coalesce("label", F.lit(""))
    return each.select(*by, "filled", "numeric", "label", "merged", label.rlike(TOTAL_WORDS).alias("total"), label.rlike(SECTION_HINT).alias("section"), marks.alias("marks"))


def column_profile(cells: DataFrame) -> DataFrame:
    """Per column: text and numeric cells, formulas, and the type that prevails (numbers win ties)."""
    own = cells.withColumn("m", mark())
    text, numeric = F.count_if(F.col("m") == "T"), F.count_if(F.col("m") != "T")
    out = own.groupBy("file", "sheet", "c").agg(text.alias("text"), numeric.alias("numeric"), F.count_if(F.col("m") == "f").alias("formulas"))
    return out.withColumn("type", F.when(F.col("text") > F.col("numeric"), "text").otherwise("numeric"))


def anchors(rows: DataFrame, edge: int = 4) -> DataFrame:
    """The rows that a sketch shows: the ends, both sides of each change of shape, and marked rows."""
    seen = with_neighbours(rows.withColumn("shape", F.translate("marks", "f", "#")), ["file", "sheet"], "r", "shape")
    ends = (F.col("k") <= edge) | (F.col("j") <= edge)
    changes = (F.col("before") != F.col("shape")) | (F.col("after") != F.col("shape"))
    return seen.filter(ends | F.coalesce(changes, F.lit(False)) | F.col("merged") | F.col("total") | F.col("section")).drop("before", "after", "k", "j")


def skipped_runs(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """first, last, n: the runs of rows that a sketch leaves out."""
    gone = rows.join(kept.select("file", "sheet", "r"), ["file", "sheet", "r"], "left_anti")
    island = numbered(gone, ["file", "sheet"], ["r"], "k").withColumn("k", F.col("r") - F.col("k"))
    return island.groupBy("file", "sheet", "k").agg(F.min("r").alias("first"), F.max("r").alias("last"), F.count(F.lit(1)).alias("n")).drop("k")


def grid(cells: DataFrame, sheet: str, rows: int = 30, columns: int = 12) -> str:
    """The first rows of a sheet as a person checks them: row number, shape, M where cells are merged, and the label."""
    first = row_profile(cells.filter(F.col("sheet") == sheet)).orderBy("r").limit(rows).collect()
    return "\n".join(f"{r['r']:>4} {r['marks'][:columns]:<{columns}} {'M' if r['merged'] else ' '} {(r['label'] or '')[:46]}" for r in first)


def sketch(cells: DataFrame, sheet: str, columns: int = 12, edge: int = 4, most: int = 400) -> str:
    """A sheet's structure as text for a person or a model: anchors, and how many like rows lie between."""
    rows = row_profile(cells.filter(F.col("sheet") == sheet))
    kept = anchors(rows, edge)
    shown = [(r["r"], f"{r['r']:>5} {r['marks'][:columns]:<{columns}} {r['label'] or ''}") for r in kept.orderBy("r").limit(most).collect()]
    gaps = [(r["first"], f"      … {r['n']} more rows, same shape") for r in skipped_runs(rows, kept).orderBy("first").limit(most).collect()]
    return "\n".join(line for _, line in sorted(shown + gaps))


def absent_concepts(cells: DataFrame, concepts: list[str]) -> list[str]:
    """The concepts that the file really lacks: some of their words of three letters or more occur nowhere."""
    words = {c: [w for w in c.lower().split() if len(w) >= 3] for c in concepts}
    wanted = sorted({w for ws in words.values() for w in ws})
    if not wanted:
        return []
    said = cells.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter(F.col("w").isin(wanted)).distinct()
    there = {r["w"] for r in said.collect()}
    return [c for c, ws in words.items() if not ws or any(w not in there for w in ws)]
