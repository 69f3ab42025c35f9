"""A first reading of an unknown sheet: where its header, labels, values and totals are, and how sure that is.

All sizes come out of small aggregations over cells; only header cells, column counts and label groups that
decide the reading reach the driver. A person confirms the reading before anything is ingested.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.ingest import FOOTNOTE
from tracegrid.operators.probe import TOTAL_WORDS, absent_concepts, column_profile, mark, row_profile, sketch
from tracegrid.plans.catalog import PERIOD_PATTERNS
from tracegrid.plans.spec import SheetSpec, Spec, letters_of

# Fixed values of the reading rules.
MIN_NUMBERS = 3
LABEL_SHARE = 0.5
PERIODIC_SHARE = 0.8
ASCII_SHARE = 0.8
MIN_PREFIX = 3
MOST_TOTALS = 1000
MOST_NOTES = 10_000


@dataclass
class Reading:
    sheet: SheetSpec
    layout: str
    confidence: dict[str, str] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    gaps: list[str] = field(default_factory=list)


def value_block(columns: list[dict]) -> tuple[int, int] | None:
    """First and last column of the value block: mostly numeric columns, or a contiguous run of weaker ones."""
    strong = [c["c"] for c in columns if c["numeric"] >= MIN_NUMBERS and c["numeric"] > c["text"]]
    if strong:
        return min(strong), max(strong)
    weak = sorted(c["c"] for c in columns if c["numeric"] > 0)
    runs: list[list[int]] = []
    for c in weak:
        if runs and c == runs[-1][-1] + 1:
            runs[-1].append(c)
        else:
            runs.append([c])
    best = max(runs, key=len, default=[])
    return (best[0], best[-1]) if len(best) >= 3 else None


def common_prefix(labels: list[str]) -> str:
    """The longest common beginning, whatever the case, as the first label writes it."""
    n = 0
    first = labels[0] if labels else ""
    while n < len(first) and all(len(x) > n and x[n].lower() == first[n].lower() for x in labels):
        n += 1
    return first[:n]


def total_kinds(totals: list[dict]) -> dict[str, str]:
    """Patterns for subtotals and grand totals from (label, times) groups of labels that sound like totals."""
    repeated = sorted(x["label"] for x in totals if x["times"] > 1)
    once = sorted(x["label"] for x in totals if x["times"] == 1)
    kinds = {}
    if repeated:
        kinds["subtotal"] = f"^{re.escape(repeated[0])}$"
    if once:
        kinds["grand_total"] = f"^({'|'.join(re.escape(x) for x in once)})$"
    return kinds


def section_kinds(least: str | None, greatest: str | None, n: int) -> dict[str, str]:
    """The pattern of section headers: what all of ``n`` labels without numbers begin with.

    The labels between the least and the greatest, in order of their lower case, share those two's beginning.
    """
    prefix = common_prefix([least or "", greatest or ""])
    return {"section_header": f"^{re.escape(prefix)}"} if n >= 2 and len(prefix) >= MIN_PREFIX else {}


def _collected(rows: DataFrame, most: int, what: str) -> list:
    """The rows of a bounded result; one that is larger is no such result, and is refused rather than cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}: this is no table that can be read without a spec")
    return found


def run_above(rows: DataFrame, row: int) -> int:
    """The first row of the unbroken run of ``rows(r)`` that ends right above ``row``; ``row`` itself if there is none."""
    below = rows.select((F.col("r") + 1).alias("r"))
    starts = rows.join(below, "r", "left_anti").agg(F.max("r").alias("r"))
    one = starts.crossJoin(rows.agg(F.max("r").alias("last"))).first()  # two single rows
    return one["r"] if one["last"] == row - 1 else row


def layout_of(headers: list[str], ids: int, width: int) -> tuple[str, str]:
    """crosstab or record, and how sure: periods as headers make a cross-tab, names make a record table."""
    periodic = [any(re.search(p, h) for p in PERIOD_PATTERNS) for h in headers]
    share = sum(periodic) / len(headers) if headers else 0.0
    clean = all("\n" not in h and sum(ch.isascii() for ch in h) >= ASCII_SHARE * max(1, len(h)) for h in headers)
    if headers and share >= PERIODIC_SHARE:
        return "crosstab", "high" if share == 1 and width >= 3 else "medium"
    if headers and share == 0 and clean and ids:
        return "record", "high" if len(headers) >= 2 else "medium"
    return "crosstab", "low"


def read_sheet(cells: DataFrame, sheet: str) -> Reading | None:
    """The reading of one sheet, or None where it has no numbers to speak of."""
    own = cells.filter(F.col("sheet") == sheet)
    columns = [r.asDict() for r in column_profile(own).collect()]  # one row for each column
    block = value_block(columns)
    if block is None:
        return None
    lo, hi = block
    need = max(1, (hi - lo + 1) // 2)
    in_block = own.filter(F.col("c").between(lo, hi) & (mark() != "T")).groupBy("r").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= need)
    first, last = in_block.agg(F.min("r"), F.max("r")).first()
    if first is None:
        return None
    # label-only rows (section headers) may open the block
    above = own.filter(F.col("r") < first).groupBy("r").agg(F.count_if(F.col("c") < lo).alias("left"), F.count_if(F.col("c") >= lo).alias("right"))
    header = above.filter("right > 0").agg(F.max("r")).first()[0]
    first = run_above(above.filter(f"r > {header or 0} AND right = 0 AND left = 1").select("r"), first)
    headers = own.filter((F.col("r") == (header or 0)) & F.col("c").between(1, hi)).select("c", "text").collect()  # one row of a sheet
    named = {r["c"]: (r["text"] or "").strip() for r in headers}
    stacked = [header] if header else []
    if header and not any(re.search(p, h) for p in PERIOD_PATTERNS for c, h in named.items() if c >= lo):
        stacked = list(range(run_above(above.filter(f"r < {header} AND right >= {need}").select("r"), header), header + 1))
    data = own.filter(F.col("r").between(first, last))
    n_rows = last - first + 1
    left = data.filter((F.col("c") < lo) & (mark() == "T")).groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()
    texts = sorted((r["c"] for r in left if r["k"] >= LABEL_SHARE * n_rows), reverse=True)
    run = [c for i, c in enumerate(texts) if c == texts[0] - i][::-1]
    layout, sure = layout_of([named.get(c, "") for c in range(lo, hi + 1) if named.get(c)], len(run), hi - lo + 1)
    label = run[0] if run else 1
    labels = data.filter((F.col("c") == label) & (mark() == "T")).select("r", F.trim(F.regexp_replace("text", FOOTNOTE, "")).alias("label"))
    counts = data.filter(F.col("c").between(lo, hi) & (mark() != "T")).groupBy("r").agg(F.count(F.lit(1)).alias("k"))
    groups = labels.join(counts, "r", "left").groupBy("label").agg(F.count(F.lit(1)).alias("times"), F.sum(F.coalesce("k", F.lit(0))).alias("numeric"))
    kinds = {}
    if layout == "crosstab":
        is_total = F.col("label").rlike(TOTAL_WORDS)
        kinds = total_kinds([r.asDict() for r in _collected(groups.filter(is_total).select("label", "times"), MOST_TOTALS, "labels of totals")])
        bare = F.when(~is_total & (F.col("numeric") == 0), F.col("label"))
        kinds |= section_kinds(*groups.agg(F.min_by(bare, F.lower(bare)), F.max_by(bare, F.lower(bare)), F.count(bare)).first())
    outside = row_profile(own.filter((F.col("r") < first) | (F.col("r") > last))).filter(f"filled <= 2 AND label IS NOT NULL AND r <> {header or 0}")
    note_rows = sorted(r["r"] for r in _collected(outside.select("r"), MOST_NOTES, "rows of notes"))
    by_c = {c["c"]: c for c in columns}
    numeric = [c for c in range(lo, hi + 1) if layout == "crosstab" or (by_c.get(c) and by_c[c]["numeric"] >= by_c[c]["text"])]
    spec = SheetSpec(
        sheet, stacked or [max(1, first - 1)], first, last, [letters_of(c) for c in numeric], letters_of(label),
        [letters_of(c) for c in (run or [1])] if layout == "record" else [], note_rows, kinds,
    )
    gaps = [letters_of(c) for c in range(lo, hi + 1) if c in by_c and by_c[c]["text"] > by_c[c]["numeric"]]
    confidence = {"layout": sure, "header": "high" if header else "low", "labels": "high" if run else "low"}
    return Reading(spec, layout, confidence, {letters_of(c): re.sub(FOOTNOTE, "", h).strip() for c, h in named.items()}, gaps)


def propose(cells: DataFrame, file: str, meaning: Callable[[str], dict] | None = None, absent: list[str] | None = None) -> Spec:
    """A spec for all sheets of a file. ``meaning`` may name entity, period, measure and unit from a sketch."""
    names = [r["sheet"] for r in cells.select("sheet", "sheet_idx").distinct().orderBy("sheet_idx").collect()]
    readings = [r for s in names if (r := read_sheet(cells, s))]
    if not readings:
        raise ValueError(f"{file} holds no table of numbers")
    if len({r.layout for r in readings}) > 1:
        raise ValueError(f"{file} mixes layouts: {', '.join(f'{r.sheet.sheet} is a {r.layout}' for r in readings)}")
    first = readings[0]
    try:
        told = meaning(sketch(cells, first.sheet.sheet)) if meaning else {}
    except Exception:  # a model that fails names nothing
        told = {}
    entity, measure = told.get("entity", "entity"), told.get("measure", "value")
    if first.layout == "record":  # headers name the columns there
        entity = first.headers.get(first.sheet.id_columns[0]) or first.sheet.id_columns[0]
        measure = first.headers.get(first.sheet.value_columns[0]) or first.sheet.value_columns[0]
    table = re.sub(r"\W+", "_", file.rsplit(".", 1)[0]).strip("_").lower() or "sheet"
    table = table if table[0].isalpha() else f"t_{table}"
    lacking = absent_concepts(cells, absent or [])
    period = told.get("period", "period") if first.layout == "crosstab" else None
    return Spec(file, table, first.layout, entity, measure, period, [r.sheet for r in readings], unit=told.get("unit"), absent=lacking, confidence=first.confidence)
