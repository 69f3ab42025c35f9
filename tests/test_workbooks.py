"""Round trips: a clean table is laid out as a sheet, read, understood and ingested back with its cells."""

import csv
import io
import zipfile

import pytest

from tracegrid.operators import ingest, lineage, probe
from tracegrid.plans import geometry, present
from tracegrid.plans.ask import Fixed, Workbook
from tracegrid.plans.catalog import build_catalog
from tracegrid.plans.gates import Memory
from tracegrid.plans.model import Citation
from tracegrid.plans.spec import SheetSpec, Spec, column_number, confirmed, letters_of
from tracegrid.sources.cells import coerced, delimited_cells, read_cells, sheet_view, sheets, workbook_cells

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows(rows)


def write_xlsx(path, named, formulas=None, merges=()):
    """A small workbook: numbers, inline texts, one shared string table entry, formulas with cached values."""
    with zipfile.ZipFile(path, "w") as z:
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(named)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        own = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(named))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{own}</sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>shared text</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(named.values()):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row, 1):
                    ref = f"{letters_of(c)}{r}"
                    f = (formulas or {}).get((i, ref), "")
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f'<c r="{ref}">{f}<v>{v}</v></c>'
                    elif v == "shared text":
                        cells += f'<c r="{ref}" t="s"><v>0</v></c>'
                    elif v.startswith("date:"):
                        cells += f'<c r="{ref}" s="1"><v>{v[5:]}</v></c>'
                    else:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                body += f'<row r="{r}">{cells}</row>'
            merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData><mergeCells>{merged}</mergeCells></worksheet>")


CROSSTAB = [
    ["Fuel use (thousand tonnes)*", None, None, None],
    [None, "2019-20", "2020-21", "2021-22"],
    ["REGION - NORTH", None, None, None],
    ["Delhi[1]", 1.5, 2, 3],
    ["Punjab", 4, "..", 6],
    ["Region Total", 5.5, 2, 9],
    ["REGION - SOUTH", None, None, None],
    ["Kerala", 7, 8, 9],
    ["Goa", 1, 1, 2],
    ["Region Total", 8, 9, 11],
    ["ALL INDIA TOTAL", 13.5, 11, 20],
    ["Source: survey", None, None, None],
]
TRUTH = {
    ("Delhi", "NORTH", "2019-20", 1.5): "B4", ("Delhi", "NORTH", "2020-21", 2.0): "C4", ("Delhi", "NORTH", "2021-22", 3.0): "D4", ("Punjab", "NORTH", "2019-20", 4.0): "B5",
    ("Punjab", "NORTH", "2021-22", 6.0): "D5", ("Kerala", "SOUTH", "2019-20", 7.0): "B8", ("Kerala", "SOUTH", "2020-21", 8.0): "C8", ("Kerala", "SOUTH", "2021-22", 9.0): "D8",
    ("Goa", "SOUTH", "2019-20", 1.0): "B9", ("Goa", "SOUTH", "2020-21", 1.0): "C9", ("Goa", "SOUTH", "2021-22", 2.0): "D9",
}
RECORD = [["Name", "Symbol", "Pivot %", "DMA"], ["Alpha", "A", 59, 1.5], ["Beta", "B", 7.1, None], ["Gamma", "C", 7.1, -3], ["Delta", "D", 31, 90.9], [None, None, None, None], ["Eps", "E", "n/a", 4]]


def test_crosstab_round_trip(spark, tmp_path):
    write_csv(tmp_path / "fuel.csv", CROSSTAB)
    cells = read_cells(spark, str(tmp_path / "fuel.csv")).cache()
    spec = geometry.propose(cells, "fuel.csv", absent=["tax revenue", "survey"])
    s = spec.sheets[0]
    assert (spec.layout, spec.absent) == ("crosstab", ["tax revenue"])
    assert (s.header_rows, s.first_data_row, s.last_data_row, s.label_column) == ([2], 3, 11, "A")
    assert set(s.row_kinds) == {"subtotal", "grand_total", "section_header"} and 12 in s.note_rows
    tidy = ingest.ingest(cells, spec)
    ingest.check_grain(tidy)
    rows = {r["__row_id"]: r for r in tidy.rows.collect()}
    assert sorted(rows) == list(range(len(rows)))
    got = {}
    for r in tidy.receipts.filter("column_name = 'value'").collect():
        x = rows[r["row_id"]]
        if x["row_kind"] == "entity":
            got[x["entity"], x["section"], x["period"], x["value"]] = r["a1"]
    assert got == TRUTH
    kinds = {k: sum(r["row_kind"] == k for r in rows.values()) for k in ("entity", "subtotal", "grand_total")}
    assert kinds == {"entity": 11, "subtotal": 6, "grand_total": 3}
    heads = {(r["raw_value"], r["a1"]) for r in tidy.receipts.filter("column_name = 'section'").collect()}
    assert heads == {("NORTH", "A3"), ("SOUTH", "A7")}
    assert all(r["section"] is None for r in rows.values() if r["row_kind"] == "grand_total")
    assert {r["text"] for r in tidy.notes.collect()} >= {"Source: survey"}
    out = ingest.save(tidy, str(tmp_path / "store"))
    assert out["rows"] == 20 and ingest.load(spark, str(tmp_path / "store"))[1].count() == out["receipts"]


def test_ask_over_crosstab(spark, tmp_path):
    write_csv(tmp_path / "fuel.csv", CROSSTAB)
    cells = read_cells(spark, str(tmp_path / "fuel.csv"))
    spec = geometry.propose(cells, "fuel.csv")
    tidy = ingest.ingest(cells, spec)
    catalog = build_catalog(tidy.rows, spec.table, spec.measure, defaults=spec.defaults, absent=("tax",))
    assert [c.name for c in catalog.scopes] == ["period"] and catalog.labels_for("value") == []
    f = lambda **k: [{"column": c, "op": "=", "value": v} for c, v in k.items()]
    m = lambda n, **k: {"name": n, "agg": "sum", "column": "value", "filters": f(**k)}
    plan = lambda by=(), sort="none", limit=0, text="{v1}", agg="sum", **k: {"kind": "query", "metric": {"agg": agg, "column": "value"}, "filters": f(**k), "group_by": list(by), "sort": sort, "limit": limit, "narration": text}
    p = Fixed(
        {
            "Kerala in 2019-20?": plan(entity="Kerala", period="2019-20", text="Kerala used {v1}."),
            "Which entity was highest in 2021-22?": plan(("entity",), "desc", 1, "{v1} used {v2}.", period="2021-22"),
            "NORTH in 2019-20?": plan(section="NORTH", period="2019-20"),
            "Kerala's share in 2019-20?": {"kind": "derived", "measures": [m("m1", entity="Kerala", period="2019-20"), m("m2", period="2019-20")], "derive": {"op": "divide", "of": "m1", "by": "m2", "scale": 100}, "narration": "{v1}"},
            "Kerala?": plan(entity="Kerala"),
            "Which by entity in 2019-20?": plan(("entity",), text="{v1} {v2}", period="2019-20"),
            "Kerala in 2030?": plan(entity="Kerala", period="2020-21", text="{v1}"),
            "how many Kerala rows in 2019-20?": plan(agg="count", entity="Kerala", period="2019-20"),
        },
        {"median value?": {"sql": f"SELECT median(value) AS v FROM {spec.table} WHERE row_kind = 'entity' AND period = '2019-20'"}},
    )
    book = Workbook(tidy.rows, tidy.receipts, catalog)
    ask = lambda text, memory=None: book.ask(text, [p], memory)
    memory = Memory()
    a = ask("Kerala in 2019-20?", memory)
    assert a.text == "Kerala used 7.00." and [c.a1 for c in a.citations()] == ["B8"] and memory.previous is not None
    a = ask("Which entity was highest in 2021-22?")
    assert a.text == "Kerala used 9.00." and [c.a1 for c in a.citations()] == ["A8", "D8"]
    a = ask("NORTH in 2019-20?")
    assert a.text == "5.50" and present.cell_ranges(a.citations()) == ["Sheet1!B4:B5"]
    a = ask("Kerala's share in 2019-20?")
    assert a.text == "51.85" and len(a.citations()) == 5 and present.answer_json(a)["slots"]["v1"]["derivation"] == "m1 / m2 x 100"
    assert ask("how much tax?").status == "abstained" and ask("Kerala?").options[0] == "all periods"
    assert ask("Which by entity in 2019-20?").status == "clarify" and ask("hello there?").status == "abstained"
    assert ask("Kerala in 2030?").status == "clarify"
    a = ask("median value?")
    assert a.text == "2.75" and len(a.citations()) == 4
    assert ask("how many Kerala rows in 2019-20?").text == "1.00"
    assert present.starter_questions(catalog, "entity", "period")[0] == "What was Delhi in 2021-22?"


def test_record_round_trip(spark, tmp_path):
    write_csv(tmp_path / "climb.csv", RECORD)
    cells = read_cells(spark, str(tmp_path / "climb.csv"))
    spec = geometry.propose(cells, "climb.csv")
    assert (spec.layout, spec.entity, spec.measure) == ("record", "Name", "Pivot %")
    tidy = ingest.ingest(cells, spec)
    rows = [tuple(r)[1:5] for r in tidy.rows.orderBy("__row_id").collect()]
    assert rows == [("Alpha", "A", 59.0, 1.5), ("Beta", "B", 7.1, None), ("Gamma", "C", 7.1, -3.0), ("Delta", "D", 31.0, 90.9), ("Eps", "E", None, 4.0)]
    at = {(r["row_id"], r["column_name"]): r["a1"] for r in tidy.receipts.collect()}
    assert at[0, "Pivot %"] == "C2" and at[3, "DMA"] == "D5" and (1, "DMA") not in at and at[4, "Name"] == "A7" and (4, "Pivot %") not in at


def test_workbook_reader(spark, tmp_path):
    shared = {(0, "B2"): '<f t="shared" si="0" ref="B2:B3">A2*$C$1+A1</f>', (0, "B3"): '<f t="shared" si="0"/>', (0, "A3"): "<f>SUM(A1:A2)</f>"}
    write_xlsx(tmp_path / "b.xlsx", {"One": [[1, "text", 2.5], [2, 5, True], [3, 6, "shared text"], ["date:43831", None, "x"]], "Two": [["only", 1]]}, shared, ["C3:D4"])
    got = {(c[1], c[5]): c for c in workbook_cells("b.xlsx", (tmp_path / "b.xlsx").read_bytes())}
    assert got["One", "B2"][10] == "=A2*$C$1+A1" and got["One", "B3"][10] == "=A3*$C$1+A2" and got["One", "A3"][6] == "f"
    assert got["One", "C2"][7] == 1.0 and got["One", "A4"][8] == "2020-01-01 00:00:00" and got["One", "C3"][8] == "shared text"
    assert got["One", "C3"][11] and not got["One", "A1"][11] and got["Two", "B1"][7] == 1.0
    cells = read_cells(spark, str(tmp_path / "b.xlsx"))
    assert [r["sheet"] for r in sheets(cells).collect()] == ["One", "Two"] and sheet_view(cells, "One", rows=2, columns=2).count() == 4


def test_stacked_headers_constants_and_guard(spark, tmp_path):
    sheet = lambda k: [["title", None, None], [None, "Budget", "Budget"], [None, "2023-24", "2024-25"], ["Income", 10 * k, 20 * k], ["Costs", 1 * k, 2 * k]]
    write_xlsx(tmp_path / "c.xlsx", {"ALL": sheet(3), "MS": sheet(1)})
    cells = read_cells(spark, str(tmp_path / "c.xlsx"))
    one = lambda n: SheetSpec(n, [2, 3], 4, 5, ["B", "C"], "A", constants={"product": f" {n} "})
    spec = confirmed(Spec("c.xlsx", "c", "crosstab", "item", "value", "year", [one("ALL"), one("MS")]))
    assert spec.defaults == {"product": "ALL"}
    spec.save(tmp_path / "c.yaml")
    assert Spec.load(tmp_path / "c.yaml") == spec
    tidy = ingest.ingest(cells, spec)
    got = {(r["item"], r["year"], r["product"]): r["value"] for r in tidy.rows.collect()}
    assert got["Income", "Budget 2024-25", "MS"] == 20.0 and len(got) == 8
    heads = {r["a1"] for r in tidy.receipts.filter("column_name = 'year'").collect()}
    assert heads == {"B2", "C2"}
    ingest.check_grain(tidy)
    for s in spec.sheets:
        s.constants = {}
    with pytest.raises(ValueError):
        ingest.check_grain(ingest.ingest(cells, spec))


def test_small_parts(spark):
    assert [coerced(x) for x in ("5", "5.0", "1_000", "1,234", "2008-09", "nan", "", "5d", "-3e2")] == [5, 5.0, 1000, "1,234", "2008-09", "nan", None, "5d", -300.0]
    assert [letters_of(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and column_number("AAA") == 703
    assert [c[5] for c in delimited_cells("x.tsv", b'a\t"b\nc"\n\n1\t2')] == ["A1", "B1", "A3", "B3"]
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.range(1, 704).select(lineage.column_letter(F.col("id").cast("int"))).collect()] == [letters_of(n) for n in range(1, 704)]
    for bad in ({"table": "a b"}, {"file": "../x.csv"}, {"layout": "cube"}):
        with pytest.raises(ValueError):
            Spec(**({"file": "x.csv", "table": "x", "layout": "record", "entity": "e", "measure": "m", "period": None, "sheets": []} | bad))
    cells = [("S", "A1"), ("S", "A2"), ("S", "A4"), ("S", "B2"), ("S", "odd")]
    df = spark.createDataFrame(cells, "sheet string, a1 string")
    ranges = lineage.collapse_ranges(df)
    assert {r["ref"] for r in ranges.collect()} == {"A1:A2", "A4", "B2", "odd"}
    assert {tuple(r) for r in lineage.expand_ranges(ranges).collect()} == set(cells)
    assert present.cell_ranges([Citation(*c, None) for c in cells]) == ["S!A1:A2", "S!A4", "S!B2", "S!odd"]
    assert present.footnote([Citation("S", f"A{i}", None) for i in range(5)]) == "S!A0, S!A1, S!A2 +2 more"
    deck = present.slides("t", [{"text": "x", "value": 1, "cells": []}, {"text": "y", "rows": []}], "end")
    assert [s["kind"] for s in deck] == ["cover", "stat", "leaderboard", "closing"] and present.pretty_sql("select a from t where b").count("\n") == 2


def test_sketch(spark, tmp_path):
    rows = [["title", None], ["k", "v"], *[[f"n{i}", i] for i in range(40)], ["Total", 780]]
    write_csv(tmp_path / "s.csv", rows)
    text = probe.sketch(read_cells(spark, str(tmp_path / "s.csv")), "Sheet1")
    assert "more rows, same shape" in text and "Total" in text and len(text.splitlines()) < 14


def test_long_preambles_and_many_totals(spark, tmp_path, monkeypatch):
    """Nothing above the data is cut off, however far up it stands; what is no table is refused, not read in part."""
    notes = [[f"remark {i}", None, None] for i in range(1, 71)]
    parts = [[f"PART - {x}", None, None] for x in "ab"]
    body = [parts[0], ["one", 1, 2], ["two", 3, 4], ["Total of a", 4, 6], parts[1], ["three", 5, 6], ["Total of b", 5, 6]]
    write_csv(tmp_path / "l.csv", [*notes, [None, "2023-24", "2024-25"], *body])
    cells = read_cells(spark, str(tmp_path / "l.csv")).cache()
    s = geometry.read_sheet(cells, "Sheet1").sheet
    assert (s.header_rows, s.first_data_row, s.last_data_row, s.note_rows) == ([71], 72, 78, list(range(1, 71)))
    assert set(s.row_kinds) == {"section_header", "grand_total"} and s.row_kinds["section_header"] == r"^PART\ \-\ "
    assert len(probe.grid(cells, "Sheet1", rows=75).splitlines()) == 75
    monkeypatch.setattr(geometry, "MOST_TOTALS", 1)
    with pytest.raises(ValueError, match="labels of totals"):
        geometry.read_sheet(cells, "Sheet1")


def test_constants_are_marked_as_such(spark, tmp_path):
    write_csv(tmp_path / "k.csv", [["title", None], [None, "2023-24"], ["Income", 10]])
    spec = Spec("k.csv", "k", "crosstab", "item", "value", "year", [SheetSpec("Sheet1", [2], 3, 3, ["B"], "A", constants={"unit": "k"})])
    got = {r["column_name"]: (r["a1"], r["raw_value"], r["synthetic"]) for r in ingest.ingest(read_cells(spark, str(tmp_path / "k.csv")), spec).receipts.collect()}
    assert got == {"value": ("B3", "10", False), "year": ("B2", "2023-24", False), "row_kind": ("A3", "Income", False), "item": ("A3", "Income", False), "unit": ("A1", "k", True)}


def test_wide_layouts(spark, tmp_path):
    quarters = [f"Q{i % 4 + 1}-{2020 + i // 4}" for i in range(10)]
    write_csv(tmp_path / "q.csv", [["co", *quarters], ["A", *range(10)], [None] * 11, ["B", *range(10, 20)], ["C", *range(5, 15)]])
    spec = geometry.propose(read_cells(spark, str(tmp_path / "q.csv")), "q.csv")
    assert spec.layout == "crosstab" and spec.confidence["layout"] == "high"
    assert ingest.ingest(read_cells(spark, str(tmp_path / "q.csv")), spec).rows.count() == 30
    assert io is not None
