"""From cells to tidy rows with a receipt for every value, in the same pass.

``cells`` is the long grid that the readers make: file, sheet, sheet_idx, r, c, a1, kind, num, text, raw, formula.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.lineage import column_letter
from tracegrid.operators.order import carried, numbered
from tracegrid.plans.spec import Spec, SheetSpec, column_number, letters_of

FOOTNOTE = r"\[\d+\]|\*"


def clean_label(text: Column) -> Column:
    """A label without footnote marks."""
    return F.trim(F.regexp_replace(text, FOOTNOTE, ""))


def row_kind(label: Column, kinds: dict[str, str]) -> Column:
    """The first kind whose pattern occurs in the label, whatever its case; otherwise entity."""
    out = None
    for kind, pattern in kinds.items():
        hit = label.rlike(f"(?i){pattern}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit("entity") if out is None else out.otherwise("entity")


def dense_row_ids(rows: DataFrame, sheet: list[str], order: list[str]) -> DataFrame:
    """Adds ``__row_id``: dense from 0 in the order of sheets and, within them, of ``order``.

    Rows are numbered block by block and shifted by the rows of the blocks before; only the blocks' counts
    are ordered in one place.
    """
    return numbered(rows, sheet, order, "__row_id", whole=sheet)


@dataclass
class Tidy:
    rows: DataFrame
    receipts: DataFrame
    notes: DataFrame
    dims: list[str]
    measures: list[str]

    def counts(self) -> dict[str, int]:
        return {
            "rows": self.rows.count(),
            "receipts": self.receipts.count(),
            "notes": self.notes.count(),
            "formulas": self.receipts.filter("formula IS NOT NULL").count(),
        }


def filled_sections(labels: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the last section header above it: its text and address travel together."""
    head = F.when(F.col("row_kind") == "section_header", F.struct(F.col("section_text").alias("section"), F.col("a1").alias("section_a1")))
    return carried(labels, by, "r", head, "__head").select("*", "__head.section", "__head.section_a1").drop("__head")


def header_labels(cells: DataFrame, rows: list[int], lo: int, hi: int) -> DataFrame:
    """sheet, c, label, a1: stacked header rows joined top to bottom, citing the top row's cell."""
    top = min(rows)
    own = cells.filter(F.col("r").isin(rows) & F.col("c").between(lo, hi) & (F.trim("text") != ""))
    parts = F.array_sort(F.collect_list(F.struct("r", "text")))
    joined = own.groupBy("sheet", "c").agg(F.array_join(F.transform(parts, lambda x: F.trim(x["text"])), " ").alias("label"))
    label = F.trim(F.regexp_replace("label", r"\s+", " "))
    return joined.select("sheet", "c", label.alias("label"), F.concat(column_letter(F.col("c")), F.lit(str(top))).alias("header_a1"))


def unpivot_wide(wide: DataFrame, ids: list[str], values: list[str], variable: str, value: str) -> DataFrame:
    """Columns into rows; missing values make no row."""
    return wide.unpivot(ids, values, variable, value).filter(F.col(value).isNotNull())


def _alike(sheets: list[SheetSpec]) -> list[list[SheetSpec]]:
    """Sheets in groups that are read in one pass: all alike but for their names, notes and constants."""
    groups: dict[str, list[SheetSpec]] = {}
    for s in sheets:
        shape = (s.header_rows, s.first_data_row, s.last_data_row, s.value_columns, s.label_column, s.id_columns, list(s.row_kinds.items()))
        groups.setdefault(repr(shape), []).append(s)
    return list(groups.values())


def _crosstab_sheets(cells: DataFrame, spec: Spec, sheets: list[SheetSpec]) -> DataFrame:
    s = sheets[0]
    own = cells.filter(F.col("sheet").isin([x.sheet for x in sheets]))
    lo, hi = min(s.value_numbers), max(s.value_numbers)
    data = own.filter(F.col("r").between(s.first_data_row, s.last_data_row))
    label = data.filter((F.col("c") == column_number(s.label_column or "A")) & (F.trim("text") != ""))
    cleaned = clean_label(F.col("text"))
    section_pattern = s.row_kinds.get("section_header", "")
    labels = label.select("sheet", "r", "a1", F.col("text").alias("raw_label"), cleaned.alias("label"), row_kind(cleaned, s.row_kinds).alias("row_kind"))
    text = F.trim(F.regexp_replace("label", f"(?i){section_pattern}", "")) if section_pattern else F.lit(None).cast("string")
    labels = filled_sections(labels.withColumn("section_text", text), ["sheet"]).filter("row_kind <> 'section_header'")
    values = data.filter(F.col("c").between(lo, hi) & F.col("num").isNotNull()).select(
        "sheet", "sheet_idx", "r", "c", F.col("a1").alias("value_a1"), "num", F.col("raw").alias("value_raw"), "formula"
    )
    heads = header_labels(own, s.header_rows, lo, hi).withColumnRenamed("label", "period_label")
    joined = values.join(F.broadcast(heads), ["sheet", "c"]).join(labels, ["sheet", "r"])
    for k in sorted({k for x in spec.sheets for k in x.constants}):
        value = F.lit(None).cast("string")
        for x in sheets:
            value = F.when(F.col("sheet") == x.sheet, F.lit(x.constants.get(k)).cast("string")).otherwise(value)
        joined = joined.withColumn(f"const_{k}", value)
    return joined


def ingest_crosstab(cells: DataFrame, spec: Spec) -> Tidy:
    """One row for each number of the value block, with its period, label, section, constants and kind."""
    constants = sorted({k for s in spec.sheets for k in s.constants})
    period, section = spec.period or "period", spec.section_dimension
    dims = [spec.entity, *([section] if section else []), period, *constants, "row_kind", "row_label"]
    _check_names([*dims, spec.measure])
    joined = reduce(DataFrame.unionByName, [_crosstab_sheets(cells, spec, group) for group in _alike(spec.sheets)])
    rows = dense_row_ids(joined, ["sheet_idx", "sheet"], ["r", "c"])
    is_entity, is_grand = F.col("row_kind") == "entity", F.col("row_kind") == "grand_total"
    cell = _receipt
    found = [
        cell(spec.measure, F.col("value_a1"), F.col("value_raw"), F.col("formula")),
        cell(period, F.col("header_a1"), F.col("period_label")),
        cell("row_kind", F.col("a1"), F.col("raw_label")),
        cell(spec.entity, F.col("a1"), F.col("raw_label"), when=is_entity),
        *[cell(k, F.lit("A1"), F.col(f"const_{k}"), when=F.col(f"const_{k}").isNotNull(), synthetic=True) for k in constants],
    ]
    if section:
        found.append(cell(section, F.col("section_a1"), F.col("section"), when=~is_grand & F.col("section").isNotNull()))
    receipts = rows.select(F.col("__row_id").alias("row_id"), "sheet", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    tidy = rows.select(
        "__row_id",
        F.when(is_entity, F.col("label")).alias(spec.entity),
        *([F.when(~is_grand, F.col("section")).alias(section)] if section else []),
        F.col("period_label").alias(period),
        *[F.col(f"const_{k}").alias(k) for k in constants],
        F.col("num").alias(spec.measure),
        "row_kind",
        F.when(~is_entity, F.col("label")).alias("row_label"),
    )
    receipts = receipts.select(F.lit(spec.table).alias("table_name"), "row_id", "x.column_name", "sheet", "x.a1", "x.raw_value", "x.formula", "x.synthetic")
    return Tidy(tidy, receipts, notes(cells, spec), dims, [spec.measure])


def _receipt(name: str, a1: Column, raw: Column, formula: Column | None = None, when: Column | None = None, synthetic: bool = False) -> Column:
    """A receipt; one marked synthetic names a cell that stands for a constant of the spec, not one that holds it."""
    none = F.lit(None).cast("string")
    own = F.struct(F.lit(name).alias("column_name"), a1.alias("a1"), raw.alias("raw_value"), (none if formula is None else formula).alias("formula"), F.lit(synthetic).alias("synthetic"))
    return own if when is None else F.when(when, own)


def notes(cells: DataFrame, spec: Spec) -> DataFrame:
    """sheet, a1, text: the leftmost text of each note row, left of the value block."""
    parts = []
    for s in spec.sheets:
        lo = min(s.value_numbers)
        own = cells.filter((F.col("sheet") == s.sheet) & F.col("r").isin(s.note_rows) & (F.col("c") < lo) & (F.trim("text") != ""))
        parts.append(own.groupBy("sheet", "r").agg(F.min_by(F.struct("a1", "text"), "c").alias("n")).select("sheet", "n.a1", "n.text"))
    return reduce(DataFrame.unionByName, parts)


def ingest_record(cells: DataFrame, spec: Spec, headers: dict[str, str] | None = None) -> Tidy:
    """One row for each sheet row with some identifier; a measure without a number is null and has no receipt.

    ``headers`` gives column names by letter; by default they are read from the header row of the first sheet.
    """
    s0 = spec.sheets[0]
    letters = [*s0.id_columns, *s0.value_columns]
    if headers is None:
        top = cells.filter((F.col("sheet") == s0.sheet) & (F.col("r") == s0.header_rows[0]) & F.col("c").isin([column_number(x) for x in letters]))
        named = {r["c"]: r["name"] for r in top.select("c", clean_label(F.col("text")).alias("name")).collect()}  # one header row
        headers = {x: named.get(column_number(x)) or x for x in letters}
    names = [headers[x] for x in letters]
    _check_names([*names, "row_kind"])
    per_sheet = []
    for s in spec.sheets:
        data = cells.filter((F.col("sheet") == s.sheet) & F.col("r").between(s.first_data_row, s.last_data_row))
        pick = lambda x: F.max(F.when(F.col("c") == column_number(x), F.struct("a1", "num", "text", "raw", "formula"))).alias(x)
        per_sheet.append(data.groupBy("sheet", "sheet_idx", "r").agg(*[pick(x) for x in letters]))
    wide = reduce(DataFrame.unionByName, per_sheet)
    ids = [F.nullif(F.trim(F.col(f"{x}.text")), F.lit("")) for x in s0.id_columns]
    wide = wide.filter(reduce(lambda a, b: a | b, [i.isNotNull() for i in ids]))
    rows = dense_row_ids(wide, ["sheet_idx", "sheet"], ["r"])
    found = [_receipt(headers[x], F.col(f"{x}.a1"), F.col(f"{x}.raw"), F.col(f"{x}.formula"), i.isNotNull()) for x, i in zip(s0.id_columns, ids)]
    found += [_receipt(headers[x], F.col(f"{x}.a1"), F.col(f"{x}.raw"), F.col(f"{x}.formula"), F.col(f"{x}.num").isNotNull()) for x in s0.value_columns]
    receipts = rows.select(F.col("__row_id").alias("row_id"), "sheet", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    tidy = rows.select(
        "__row_id", *[i.alias(headers[x]) for x, i in zip(s0.id_columns, ids)], *[F.col(f"{x}.num").alias(headers[x]) for x in s0.value_columns], F.lit("entity").alias("row_kind")
    )
    receipts = receipts.select(F.lit(spec.table).alias("table_name"), "row_id", "x.column_name", "sheet", "x.a1", "x.raw_value", "x.formula", "x.synthetic")
    empty = cells.filter(F.lit(False)).select("sheet", "a1", "text")
    return Tidy(tidy, receipts, empty, [*[headers[x] for x in s0.id_columns], "row_kind"], [headers[x] for x in s0.value_columns])


def ingest(cells: DataFrame, spec: Spec) -> Tidy:
    return ingest_crosstab(cells, spec) if spec.layout == "crosstab" else ingest_record(cells, spec)


def _check_names(names: list[str]) -> None:
    if any('"' in n for n in names):
        raise ValueError("a column name may not hold a double quote")
    lower = [n.lower() for n in names]
    if len(set(lower)) != len(lower):
        raise ValueError(f"column names must differ in more than case: {sorted(names)}")


def duplicates(rows: DataFrame, grain: list[str]) -> DataFrame:
    """Groups of rows that agree in all columns of the grain, nulls included, with their count."""
    keys = [F.col("`" + g.replace("`", "``") + "`") for g in grain]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_grain(tidy: Tidy) -> None:
    """Raise if two rows say the same about the same thing, which sums would count twice."""
    if tidy.dims and (bad := duplicates(tidy.rows, tidy.dims).head(1)):
        raise ValueError(f"several rows share {bad[0].asDict()}: a dimension is missing")


def save(tidy: Tidy, path: str) -> dict[str, int]:
    """Rows (by kind), receipts (by column) and notes as Parquet under ``path``; guards run first."""
    check_grain(tidy)
    tidy.rows.write.mode("overwrite").partitionBy("row_kind").parquet(f"{path}/rows")
    tidy.receipts.write.mode("overwrite").partitionBy("column_name").parquet(f"{path}/receipts")
    tidy.notes.write.mode("overwrite").parquet(f"{path}/notes")
    return tidy.counts()


def load(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("rows", "receipts", "notes"))  # type: ignore[return-value]


__all__ = ["Tidy", "check_grain", "clean_label", "dense_row_ids", "duplicates", "filled_sections", "ingest", "letters_of", "load", "row_kind", "save", "unpivot_wide"]
