"""Workbooks and delimited files as one long table of cells.

Spark lists and reads the files; each file is parsed in a task of its own, which fits workbooks, as their
format bounds a sheet at about a million rows. Everything after is joins, windows and groupings over
(file, sheet, r, c), so an address never parts from its value.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.plans.spec import column_number, letters_of

SCHEMA = "file string, sheet string, sheet_idx int, r int, c int, a1 string, kind string, num double, text string, raw string, formula string, merged boolean"
SUFFIXES = (".csv", ".tsv", ".txt", ".xlsx", ".xlsm")
_NUMBER = re.compile(r"[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def coerced(s: str) -> int | float | str | None:
    """A delimited field as a number where it is plainly one; words such as nan and inf stay text."""
    s = s.strip()
    if not s:
        return None
    if not _NUMBER.fullmatch(s):
        return s
    x = float(s)
    return int(x) if x.is_integer() and "." not in s and "e" not in s.lower() else x


def _row(file: str, sheet: str, idx: int, r: int, c: int, value, formula: str | None = None, merged: bool = False) -> tuple | None:  # noqa: ANN001
    if value is None and formula is None:
        return None
    number = isinstance(value, (int, float))
    text = None if value is None else str(value)
    kind = "f" if formula is not None else "#" if number else "T"
    return (file, sheet, idx, r, c, f"{letters_of(c)}{r}", kind, float(value) if number else None, text, text, formula, merged)


def delimited_cells(file: str, data: bytes) -> Iterator[tuple]:
    """Cells of a delimited file; rows are counted as the format's records, as a spreadsheet shows them."""
    text = data.decode("utf-8-sig", "replace")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if file.lower().endswith(".tsv") else ",")
    for r, record in enumerate(reader, 1):
        for c, field in enumerate(record, 1):
            value = coerced(field)
            formula = value if isinstance(value, str) and value.startswith("=") else None
            if row := _row(file, "Sheet1", 0, r, c, value, formula):
                yield row


# ---------------------------------------------------------------- workbooks


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.findall(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _as_date(serial: float) -> str:
    return str(datetime(1899, 12, 30) + timedelta(days=serial))


def _shifted(formula: str, rows: int, columns: int) -> str:
    """A shared formula as it reads elsewhere: relative references move along."""

    def move(m: re.Match) -> str:
        fixed_c, letters, fixed_r, row = m.groups()
        c = letters if fixed_c else letters_of(max(1, column_number(letters) + columns))
        return f"{fixed_c}{c}{fixed_r}{row if fixed_r else max(1, int(row) + rows)}"

    return re.sub(r"(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])", move, formula)


def _value(cell: ElementTree.Element, strings: list[str], dates: set[int]):  # noqa: ANN202
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)] or None
    if kind == "b":
        return float(v.text)
    if kind in ("str", "e"):
        return v.text
    x = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return _as_date(x)
    return int(x) if x.is_integer() and "." not in v.text else x


def workbook_cells(file: str, data: bytes) -> Iterator[tuple]:
    """Cells of a workbook with cached values and formulas, read in one pass."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        strings, dates = _strings(book), _date_styles(book)
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        for idx, s in enumerate(sheets if sheets is not None else []):
            target = targets[s.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            merged: set[tuple[int, int]] = set()
            for m in root.iter(f"{_MAIN}mergeCell"):
                ends = [re.fullmatch(r"([A-Z]+)(\d+)", x) for x in m.get("ref", "").split(":")]
                (c1, r1), (c2, r2) = [(column_number(e[1]), int(e[2])) for e in (ends[0], ends[-1]) if e]
                merged |= {(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
            shared: dict[str, tuple[str, int, int]] = {}
            r = 0
            for row in root.iter(f"{_MAIN}row"):
                r, c = int(row.get("r", r + 1)), 0
                for cell in row.findall(f"{_MAIN}c"):
                    ref = re.match(r"([A-Z]+)", cell.get("r", ""))
                    c = column_number(ref[1]) if ref else c + 1
                    f, formula = cell.find(f"{_MAIN}f"), None
                    if f is not None:
                        if f.text and f.get("t") == "shared":
                            shared[f.get("si", "")] = (f.text, r, c)
                        if f.text:
                            formula = "=" + f.text
                        elif f.get("si") in shared:
                            text, r0, c0 = shared[f.get("si", "")]
                            formula = "=" + _shifted(text, r - r0, c - c0)
                    if out := _row(file, s.get("name", ""), idx, r, c, _value(cell, strings, dates), formula, (r, c) in merged):
                        yield out


def parsed(file: str, data: bytes) -> Iterator[tuple]:
    return workbook_cells(file, data) if file.lower().endswith((".xlsx", ".xlsm")) else delimited_cells(file, data)


def read_cells(spark: SparkSession, path: str | list[str], batch: int = 50_000) -> DataFrame:
    """The cells of all workbooks and delimited files at ``path``: files, folders or patterns."""
    files = spark.read.format("binaryFile").load(path)
    wanted = files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([s[1:] for s in SUFFIXES]))
    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows: list[tuple] = []
                for row in parsed(name.rsplit("/", 1)[-1], bytes(content)):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return wanted.select("path", "content").mapInPandas(run, SCHEMA)


def cells_of_table(table: DataFrame, sheet: str, header: bool = True, file: str = "table") -> DataFrame:
    """A wide table of strings and numbers as the cells of one sheet: header in row 1, rows as ``__row_id`` orders them."""
    names = [c for c in table.columns if c != "__row_id"]
    types = dict(table.dtypes)
    cells = []
    for c, name in enumerate(names, 1):
        own = F.col(f"`{name}`")
        number = own.cast("double") if types[name] != "string" else F.lit(None).cast("double")
        kind = F.lit("T" if types[name] == "string" else "#")
        cells.append(F.struct(F.lit(c).alias("c"), F.lit(letters_of(c)).alias("letter"), kind.alias("kind"), number.alias("num"), own.cast("string").alias("text")))
    long = table.select((F.col("__row_id") + (2 if header else 1)).cast("int").alias("r"), F.inline(F.array(*cells))).filter("text IS NOT NULL")
    out = long
    if header:
        top = table.sparkSession.createDataFrame([(1, c, letters_of(c), "T", None, n) for c, n in enumerate(names, 1)], "r int, c int, letter string, kind string, num double, text string")
        out = out.unionByName(top)
    return out.select(
        F.lit(file).alias("file"), F.lit(sheet).alias("sheet"), F.lit(0).alias("sheet_idx"), "r", "c", F.concat("letter", F.col("r").cast("string")).alias("a1"),
        "kind", "num", "text", F.col("text").alias("raw"), F.lit(None).cast("string").alias("formula"), F.lit(False).alias("merged"),
    )


def cells_from(rows: DataFrame, file: str, sheets: list[str]) -> DataFrame:
    """``rows(sheet, r, c, num, text)`` as cells of the given sheets; what has a number is a number, the rest is text."""
    from tracegrid.operators.lineage import column_letter

    index = F.array_position(F.array(*[F.lit(s) for s in sheets]), F.col("sheet")) - 1
    kind = F.when(F.col("num").isNull(), "T").otherwise("#")
    return rows.select(
        F.lit(file).alias("file"), "sheet", index.cast("int").alias("sheet_idx"), "r", "c", F.concat(column_letter(F.col("c")), F.col("r").cast("string")).alias("a1"),
        kind.alias("kind"), "num", "text", F.col("text").alias("raw"), F.lit(None).cast("string").alias("formula"), F.lit(False).alias("merged"),
    )


def sheets(cells: DataFrame) -> DataFrame:
    return cells.select("file", "sheet", "sheet_idx").distinct().orderBy("file", "sheet_idx")


def sheet_view(cells: DataFrame, sheet: str, rows: int = 2000, columns: int = 60) -> DataFrame:
    """The upper left part of a sheet, as a viewer shows it."""
    own = cells.filter((F.col("sheet") == sheet) & (F.col("r") <= rows) & (F.col("c") <= columns))
    return own.select("r", "c", "a1", "text", "formula").orderBy("r", "c")
