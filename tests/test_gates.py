"""Two-sided gate tests: each gate must fire where it should and stay quiet where it should not."""

import pytest

from tracegrid.plans import gates
from tracegrid.plans.catalog import Catalog, Column, looks_periodic
from tracegrid.plans.model import Abstain, Aggregate, Answer, Condition, DerivedPlan, Part, PlanFailure, QueryPlan, Value, VerificationError, plan_from_dict
from tracegrid.plans.validate import check_query, derivation_problem
from tracegrid.operators.lineage import unbacked_numbers, verify
from tracegrid.plans.model import Citation

LANDS = "BADEN WUERTTEMBERG;BAYERN;BERLIN;BRANDENBURG;BREMEN;HAMBURG;HESSEN;MECKLENBURG VORPOMMERN;NIEDERSACHSEN;NORDRHEIN WESTFALEN;RHEINLAND PFALZ;SAARLAND;SACHSEN ANHALT;SCHLESWIG & HOLSTEIN;THUERINGEN;ULM".split(";")
SEASONS = [f"20{y:02d}-{y + 1:02d}" for y in range(8, 26)]
CAT = Catalog(
    "harvest",
    [
        Column("land", "string", labels=LANDS), Column("side", "string", labels=["EAST", "MIDDLE", "NORTH", "SOUTH", "WEST"]),
        Column("season", "string", labels=SEASONS, scope=True), Column("crop", "string", labels=["ALL", "BRL", "WHT"], aliases={"barley": "BRL", "wheat": "WHT"}),
        Column("value", "double"), Column("row_kind", "string", labels=["entity", "grand_total", "subtotal"]),
    ],
    "value", "tonnes", file_defaults={"crop": "ALL"}, absent=("rent", "rainfall", "price", "machinery"),
)


def q(narration="{v1}", by=(), agg="sum", sort="none", limit=0, column="value", **equal):
    return QueryPlan(Aggregate(agg, column), tuple(Condition(k, "=", v) for k, v in equal.items()), by, sort, limit, narration)


def d(of, by, op="divide"):
    part = lambda n, f: Part(n, Aggregate("sum", "value"), tuple(Condition(k, "=", v) for k, v in f.items()))
    return DerivedPlan((part("m1", of), part("m2", by)), op, "m1", "m2", 100)


HESSE = {"land": "HESSEN", "crop": "WHT", "season": "2021-22"}
WHEAT = {"crop": "WHT", "season": "2021-22"}
CASES = [
    ("the file has no rent", True, lambda: gates.absent_concept("what rent do Hessen's farms pay?", CAT)),
    ("nor rainfall", True, lambda: gates.absent_concept("rainfall of Bremen?", CAT)),
    ("it has harvests", False, lambda: gates.absent_concept("Hessen's wheat harvest of 2021-22?", CAT)),
    ("parents are no rent", False, lambda: gates.absent_concept("do parents farm in Bremen?", CAT)),
    ("a rate by heads", True, lambda: gates.unsupported_operation("wheat per capita in Bremen?")),
    ("a median", True, lambda: gates.unsupported_operation("the median of all lands?")),
    ("a part of the whole", False, lambda: gates.unsupported_operation("what part of the wheat is Hessen's?")),
    ("a rise", False, lambda: gates.unsupported_operation("how did barley rise in Bayern?")),
    ("before what", True, lambda: gates.unanchored_period("how far above last  period was it?", CAT)),
    ("seen from today", True, lambda: gates.unanchored_period("Bremen's barley this year?", CAT)),
    ("before a named one", False, lambda: gates.unanchored_period("2020-21 set against the previous year", CAT)),
    ("last of a ranking", False, lambda: gates.unanchored_period("who came last in 2020-21?", CAT)),
    ("a river in two names", True, lambda: gates.ambiguities("Rhein's wheat in 2018-19?", CAT)),
    ("an ending of three", True, lambda: gates.ambiguities("which burg reaped most?", CAT)),
    ("one holder of the word", False, lambda: gates.ambiguities("how much barley in Pfalz in 2018-19?", CAT)),
    ("a name in full", False, lambda: gates.ambiguities("Sachsen Anhalt's barley in 2021-22?", CAT)),
    ("a slip of the pen", False, lambda: gates.ambiguities("Brandenbrug's barley in 2021-22?", CAT)),
    ("a word near a short label", False, lambda: gates.ambiguities("which side reaped the least wheat?", CAT)),
    ("labels of row kinds", False, lambda: gates.ambiguities("Bremen's total harvest", CAT)),
    ("three letters", False, lambda: gates.ambiguities("Ulm's barley?", CAT)),
    ("season and crop forgotten", True, lambda: gates.dropped_filters("Hamburg's wheat in 2018-19?", q(land="HAMBURG"), CAT)),
    ("nothing forgotten", False, lambda: gates.dropped_filters("Hamburg's wheat in 2018-19?", q(land="HAMBURG", crop="WHT", season="2018-19"), CAT)),
    ("a ranking names no land", False, lambda: gates.dropped_filters("who reaped most wheat in 2021-22?", q(by=("land",), **WHEAT), CAT)),
    ("a refusal drops nothing", False, lambda: gates.dropped_filters("Hamburg?", Abstain("no_such_column"), CAT)),
    ("season out of thin air", True, lambda: gates.invented_filters("Hessen's part of the wheat?", q(**HESSE), CAT)),
    ("letters swapped", False, lambda: gates.invented_filters("Brandenbrug's wheat in 2021-22?", q(land="BRANDENBURG", **WHEAT), CAT)),
    ("letter missing", False, lambda: gates.invented_filters("Thuringen's wheat in 2021-22?", q(land="THUERINGEN", **WHEAT), CAT)),
    ("set against the season before", False, lambda: gates.invented_filters("Hessen's wheat in 2022-23 versus the one before", q(**HESSE), CAT)),
    ("a crop by its other name", False, lambda: gates.invented_filters("Hessen's wheat in 2021-22?", q(**HESSE), CAT)),
    ("what every plan gets", False, lambda: gates.invented_filters("Hessen in 2021-22?", q(land="HESSEN", crop="ALL", row_kind="entity", season="2021-22"), CAT)),
    ("the other Rhein", True, lambda: gates.invented_filters("Rheinland Pfalz wheat in 2021-22?", q(land="NORDRHEIN WESTFALEN", **WHEAT), CAT)),
    ("the same Rhein", False, lambda: gates.invented_filters("Rheinland Pfalz wheat in 2021-22?", q(land="RHEINLAND PFALZ", **WHEAT), CAT)),
    ("Bremen is not Berlin", True, lambda: gates.invented_filters("Bremen's wheat in 2021-22?", q(land="BERLIN", **WHEAT), CAT)),
    ("a short name", False, lambda: gates.invented_filters("Ulm's wheat in 2021-22?", q(land="ULM", **WHEAT), CAT)),
    ("half a name", False, lambda: gates.invented_filters("anhalt wheat in 2021-22?", q(land="SACHSEN ANHALT", **WHEAT), CAT)),
    ("a sign within a name", False, lambda: gates.invented_filters("Schleswig & Holstein's wheat in 2021-22?", q(land="SCHLESWIG & HOLSTEIN", **WHEAT), CAT)),
    ("barley for wheat", True, lambda: gates.invented_filters("Hessen's wheat in 2021-22?", q(land="HESSEN", crop="BRL", season="2021-22"), CAT)),
    ("another season", True, lambda: gates.invented_filters("Hessen's wheat in 2021-22?", q(land="HESSEN", crop="WHT", season="2011-12"), CAT)),
    ("kept from the turn before", False, lambda: gates.invented_filters("and Bayern?", q(land="BAYERN", **WHEAT), CAT, q(**HESSE))),
    ("season left open", True, lambda: gates.scope_gap("Hessen's harvest?", q(land="HESSEN"), CAT)),
    ("season given", False, lambda: gates.scope_gap("Hessen's wheat of 2021-22?", q(**HESSE), CAT)),
    ("all seasons on purpose", False, lambda: gates.scope_gap("Hessen's harvest, all seasons?", q(land="HESSEN"), CAT)),
    ("one value a season", False, lambda: gates.scope_gap("Hessen's wheat season by season?", q(by=("season",), land="HESSEN"), CAT)),
    ("part and whole of unlike seasons", True, lambda: derivation_problem(d(HESSE | {"season": "2022-23"}, WHEAT), CAT)),
    ("part of its whole", False, lambda: derivation_problem(d(HESSE, WHEAT), CAT)),
    ("one season on another", False, lambda: derivation_problem(d(HESSE | {"season": "2022-23"}, HESSE, "percent_change"), CAT)),
    ("change from land to land", True, lambda: derivation_problem(d(HESSE, HESSE | {"land": "BAYERN"}, "percent_change"), CAT)),
    ("change from part to whole", True, lambda: derivation_problem(d(HESSE, WHEAT, "percent_change"), CAT)),
    ("two readings of the whole", True, lambda: gates.denominator_gap(d(HESSE, {"season": "2021-22"}))),
    ("one reading of the whole", False, lambda: gates.denominator_gap(d(HESSE, WHEAT))),
]


@pytest.mark.parametrize("name,fires,run", CASES, ids=[c[0] for c in CASES])
def test_gate(name, fires, run):
    assert bool(run()) is fires


COMPILE = [
    ("no such measure", True, lambda: q(column="rent")),
    ("one land's wheat", False, lambda: q(**HESSE)),
    ("which group has the least of its own leasts", True, lambda: q("{v1} {v2}", ("side",), "min", "asc", 1, **WHEAT)),
    ("which group has the least sum", False, lambda: q("{v1} {v2}", ("side",), "sum", "asc", 1, **WHEAT)),
    ("a land among grand totals", True, lambda: q(land="HESSEN", row_kind="grand_total")),
    ("the grand total itself", False, lambda: q(row_kind="grand_total", season="2021-22")),
    ("more holes than values", True, lambda: q("{v1} and {v2}", **HESSE)),
    ("adding up names", True, lambda: q(column="land")),
    ("the latest season", False, lambda: q(column="season", agg="max")),
    ("a number with a letter", True, lambda: QueryPlan(Aggregate("sum", "value"), (Condition("value", ">", "5d"),))),
]


@pytest.mark.parametrize("name,fails,make", COMPILE, ids=[c[0] for c in COMPILE])
def test_compile(name, fails, make):
    if fails:
        with pytest.raises(PlanFailure):
            check_query(make(), CAT)
    else:
        assert check_query(make(), CAT)


def test_likeness_of_slips():
    for word, label in (("brandenbrug", "BRANDENBURG"), ("thuringen", "THUERINGEN"), ("saarlnd", "SAARLAND")):
        m = gates.match(word, [label, "ULM"])
        assert m.labels == (label,) and gates.FUZZY <= m.score < 1
    assert gates.match("least", ["EAST"]).kind == "none" and gates.match("copenhagen", LANDS).kind == "none" and gates.match("rhein", LANDS).kind == "many"


def test_memory_and_sources():
    first = q(land="HAMBURG", crop="WHT", season="2018-19")
    src = lambda question, plan, prev: gates.sources_of_filters(question, plan, prev, CAT)
    assert set(src("Hamburg's wheat in 2018-19?", first, None).values()) == {gates.STATED}
    assert src("And Bremen?", q(land="BREMEN", crop="WHT", season="2018-19"), first) == {"land": "stated", "crop": "inherited", "season": "inherited"}
    assert src("The barley too?", q(land="HAMBURG", crop="BRL", season="2018-19"), first)["crop"] == "stated"
    assert src("And Bremen?", q(land="BREMEN", crop="ALL", row_kind="entity"), first) == {"land": "stated", "crop": "default", "row_kind": "default"}
    assert src("And Bremen?", q(land="BREMEN", crop="WHT"), None)["crop"] == "invented"
    m = gates.Memory()
    for _ in range(3):
        m.remember("q", first)
    m.remember("q", Abstain("empty_result"))
    assert len(m.turns) == 2 and m.previous == first
    m.clear()
    assert m.previous is None
    assert gates.reworded("Rhein's wheat?", 'By "rhein" did you mean A or B?', "RHEINLAND PFALZ") == "RHEINLAND PFALZ's wheat?"


def test_examples_are_plans_of_the_own_file():
    """Every example parses and compiles against the catalog it was made of."""
    from tracegrid.plans.examples import examples, examples_text
    from tracegrid.plans.validate import check_derived

    record = Catalog("t", [Column("Name", "string", labels=['A "quoted" one']), Column("Height", "double"), Column("row_kind", "string")], "Height", layout="record", entity="Name")
    for catalog, n in ((CAT, 6), (record, 2), (Catalog("t", [Column("x", "double")], "x"), 1)):
        found = examples(catalog)
        assert len(found) == n and examples_text(catalog).count("Question:") == n
        for _, raw in found:
            plan = plan_from_dict(raw)
            if isinstance(plan, QueryPlan):
                assert check_query(plan, catalog)
            elif isinstance(plan, DerivedPlan):
                check_derived(plan, catalog)


def test_measures():
    c = Catalog("s", [Column("Pump", "string"), Column("load (kW)", "double"), Column("flow at 40 bar", "double"), Column("flow at 160 bar", "double")], "load (kW)", layout="record")
    plan = QueryPlan(Aggregate("max", "flow at 40 bar"))
    assert gates.measure_gap("which pump is best?", plan, c) and gates.measure_gap("the flow at its bar", plan, c)
    assert not gates.measure_gap("the greatest flow at 40?", plan, c) and not gates.measure_gap("how many?", QueryPlan(Aggregate("count", "Pump")), c)


def test_digits_and_lineage():
    a = Answer("who led in 2021-22?", "answered", "BREMEN reaped {v1}.", {"v1": Value(1.0, "4,106.50", "100 tonnes")})
    assert unbacked_numbers(a.text, [a.question, "4,106.50", "100 tonnes"]) == []
    assert unbacked_numbers("up from 812.25 to 4,106.50", ["4,106.50"]) == ["812.25"]
    cells = [Citation("S", "A1", "1.5"), Citation("S", "A2", "2.5"), Citation("S", "A3", "n/a")]
    verify(4.0, cells, "sum"), verify(2.5, cells, "max"), verify(2.0, cells, "avg")
    with pytest.raises(VerificationError):
        verify(5.0, cells, "sum")
    with pytest.raises(VerificationError):
        verify(2.0, cells, "min")


def test_periods_and_json():
    assert looks_periodic(["2015-16", "2016-17", "2017-18"]) and looks_periodic(["Q1-2024", "Q2-2024", "Q3-2024"])
    assert not looks_periodic(["2015", "2016"]) and not looks_periodic(["a", "b", "2015"])
    p = plan_from_dict({"plan": {"kind": "query", "metric": {"agg": "sum", "column": "value"}, "filters": [{"column": "land", "op": "=", "value": "HESSEN"}], "narration": "{v1}"}})
    assert p == q(land="HESSEN")
    for bad in ({"kind": "query"}, {"kind": "other"}, {"kind": "query", "metric": {"agg": "median", "column": "value"}, "narration": ""}):
        with pytest.raises(PlanFailure):
            plan_from_dict(bad)
