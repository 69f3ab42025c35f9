"""Upload, propose, confirm, ask, survey and delete."""

import pytest

from tests.test_workbooks import CROSSTAB, RECORD, write_csv
from tracegrid.plans import geometry, story
from tracegrid.plans.ask import Fixed, trace
from tracegrid.plans.model import Aggregate, Condition, QueryPlan
from tracegrid.sources.cells import read_cells
from tracegrid.sources.registry import Registry


def test_life_of_a_workbook(spark, tmp_path):
    write_csv(tmp_path / "fuel.csv", CROSSTAB)
    reg = Registry(spark, tmp_path / "reg")
    with pytest.raises(ValueError):
        reg.upload("../x.csv", b"")
    with pytest.raises(ValueError):
        reg.upload("x.exe", b"")
    path = reg.upload("fuel.csv", (tmp_path / "fuel.csv").read_bytes())
    assert reg.files() == ["fuel.csv"] and reg.specs() == {}
    seen = []
    spec = geometry.propose(read_cells(spark, str(path)), "fuel.csv", lambda text: seen.append(text) or {"entity": "state", "measure": "tonnes", "period": "year", "unit": "kt"})
    assert "T###" in seen[0] and (spec.entity, spec.measure, spec.unit) == ("state", "tonnes", "kt")
    assert reg.confirm(spec)["rows"] == 20
    (tmp_path / "reg/specs/bad.yaml").write_text("table: [")
    (tmp_path / "reg/specs/odd.yaml").write_text("table: 1 2\n")
    assert list(reg.specs()) == ["fuel"]
    book = reg.workbook()
    assert book.catalog.unit == "kt" and reg.workbook("fuel").catalog is book.catalog
    a = book.answer_query("Kerala?", QueryPlan(Aggregate("sum", "tonnes"), (Condition("state", "=", "Kerala"), Condition("year", "=", "2019-20")), narration="Kerala used {v1}."))
    assert a.text == "Kerala used 7.00 kt." and '"cells": 1' in trace(str(tmp_path / "t.jsonl"), a, 0.5)
    found = story.survey(book.table, book.cell_map, book.catalog, "state", "year")
    assert [f["kind"] for f in found] == ["trend", "leaderboard", "share", "growth"] and all(f["cells"] for f in found)
    assert found[1]["rows"][0] == ("Kerala", 9.0) and found[2]["value"] == pytest.approx(45.0)
    assert [s["kind"] for s in story.deck("Fuel", found, lambda texts: [2, 0])] == ["cover", "stat", "trend"]
    assert len(story.deck("Fuel", found, lambda texts: [99])) == 5
    reg.memory("s", "fuel").remember("q", a.plan)
    reg.clear_session("s")
    assert reg.memory("s", "fuel").previous is None
    assert book.ask("x", [Fixed({})]).status == "abstained"
    reg.delete("fuel")
    assert reg.specs() == {} and reg.files() == []
    with pytest.raises(KeyError):
        reg.resolve("fuel")


def test_survey_of_a_record(spark, tmp_path):
    write_csv(tmp_path / "climb.csv", RECORD)
    reg = Registry(spark, tmp_path / "reg")
    path = reg.upload("climb.csv", (tmp_path / "climb.csv").read_bytes())
    reg.confirm(geometry.propose(read_cells(spark, str(path)), "climb.csv"))
    book = reg.workbook()
    found = story.survey(book.table, book.cell_map, book.catalog, "Name", None)
    assert [f["kind"] for f in found] == ["count", "leaderboard", "leader"] and found[0]["value"] == 5
    assert found[2]["text"] == "Delta leads by DMA with 90.90" and [c.a1 for c in found[2]["cells"]] == ["D5"]
