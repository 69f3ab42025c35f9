"""Line dedup over overlapping three-line windows.

Every document is cut into lines; blank lines (only spaces) hold no content and are skipped when
windows are formed. Each run of three consecutive content lines is one window. Windows are compared
over the whole corpus, documents in order of ``doc_id`` and windows in text order; every occurrence
after the first is removed. The positions covered by removed windows are merged, so a line goes if
any later occurrence covers it. Lines are compared without leading and trailing spaces.

Defined cases: a null text stays null and an empty one empty; texts with fewer than three content
lines hold no window and stay as they are; a null ``doc_id`` sorts before all others; rows that
repeat both ``doc_id`` and text are one document and each keeps its row with the same decision;
other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _content(text: Column) -> Column:
    """Array of (line number, trimmed line) for the lines that hold more than spaces."""
    numbered = F.transform(_lines(text), lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def windows(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """One row per window: document key, window number, covered line numbers and 128-bit hash."""
    starts = F.when(F.size("_c") >= size, F.sequence(F.lit(0), F.size("_c") - F.lit(size)))

    def window(i: Column) -> Column:
        part = F.slice(F.col("_c"), i + F.lit(1), size)
        key = F.concat_ws("\n", F.transform(part, lambda x: x["line"]))
        return F.struct(
            F.xxhash64(key).alias("h1"),
            F.xxhash64(F.lit(1), key).alias("h2"),
            F.transform(part, lambda x: x["at"]).alias("covers"),
        )

    return (
        docs.select(F.col("doc_id").alias("__line_id"), F.xxhash64("text").alias("__line_th"), _content(F.col("text")).alias("_c"))
        .select("__line_id", "__line_th", F.posexplode(F.transform(starts, window)).alias("_n", "_w"))
        .select("__line_id", "__line_th", "_n", "_w.h1", "_w.h2", "_w.covers")
    )


def covered_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """Per document that loses lines: ``_id``, ``_th`` and the sorted line numbers to remove."""
    found = windows(docs, size)
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("__line_id", "__line_th", "_n")).alias("first"), F.max(F.struct("__line_id", "__line_th", "_n")).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    later = found.join(first, ["h1", "h2"]).filter(~F.col("first").eqNullSafe(F.struct("__line_id", "__line_th", "_n")))
    return (
        later.select("__line_id", "__line_th", F.explode("covers").alias("at"))
        .groupBy("__line_id", "__line_th")
        .agg(F.collect_set("at").alias("__line_cut"))
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with repeated windows removed from ``text``; adds ``lines_total`` and ``lines_removed``."""
    cut = covered_lines(docs, size)
    names = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    # the lines travel in place of the text: each is looked up by its number, in time linear in the text
    own = [F.split("text", "\n", -1).alias("__line_list") if c == "text" else F.col(f"`{c}`") for c in names]
    joined = docs.select(*own, F.xxhash64("text").alias("__line_key")).join(
        cut, F.col("doc_id").eqNullSafe(F.col("__line_id")) & (F.col("__line_key") == F.col("__line_th")), "left"
    )
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__line_list") - 1), F.col("__line_cut"))
    kept = F.when(F.col("__line_cut").isNull(), F.col("__line_list")).otherwise(F.transform(numbers, lambda i: F.get(F.col("__line_list"), i)))
    text = F.when(F.col("__line_list").isNotNull(), F.concat_ws("\n", kept))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size("__line_list"), F.lit(1)).cast("long").alias("lines_total"),
        F.coalesce(F.size("__line_cut"), F.lit(0)).cast("long").alias("lines_removed"),
    )


def deduplicated(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with repeated windows removed, columns as they were; rows that lose all their content go."""
    totals = {c: f"__line_own_{c}" for c in ("lines_total", "lines_removed") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(totals), size)
    emptied = (F.col("lines_removed") > 0) & (F.trim(F.translate("text", "\n", "")) == "")
    kept = out.filter(~emptied | F.col("text").isNull())
    return kept.drop("lines_total", "lines_removed").withColumnsRenamed({v: k for k, v in totals.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


#: What ``op8_line_dedup`` returns, for DuckDB.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents),
content AS (
  SELECT doc_id, pos, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM lines WHERE trim(line, ' ') <> ''),
win AS (
  SELECT a.doc_id, a.n, a.pos AS p1, b.pos AS p2, c.pos AS p3,
         a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM content a JOIN content b ON b.doc_id = a.doc_id AND b.n = a.n + 1
  JOIN content c ON c.doc_id = a.doc_id AND c.n = a.n + 2),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, n) AS k FROM win) WHERE k > 1),
cut AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT doc_id, p1 AS pos FROM later UNION ALL SELECT doc_id, p2 FROM later UNION ALL SELECT doc_id, p3 FROM later))
SELECT l.doc_id, count(*)::BIGINT AS lines_total, count(c.pos)::BIGINT AS lines_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_md5
FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos
GROUP BY l.doc_id
"""
