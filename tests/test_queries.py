"""Every query with SQL gives DuckDB's rows; the others run and keep a stable schema."""

import datetime
import decimal

import duckdb
import pytest

from tests.conftest import SF
from tracegrid.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_gate_refuses_all_but_queries(spark):
    got = {r["statement"]: r["problems"] for r in QUERIES["q65_sql_gate_verdicts"](spark, SF).collect()}
    harmless = {s for s, p in got.items() if not p}
    assert len(got) == 18 and len(harmless) == 4 and all(s.startswith(("SELECT sum(value) FROM", "SELECT count(*)", "WITH a AS")) for s in harmless)


def test_statements_see_no_other_table(spark):
    """Each statement is analysed in a session of its own: views of the caller's session are out of sight and stay as they are."""
    from tracegrid.plans.sqlgate import gated, problems

    one, two = spark.range(3).withColumnRenamed("id", "value"), spark.range(5).withColumnRenamed("id", "value")
    spark.range(7).createOrReplaceTempView("facts")
    first, second = gated(one, "facts", "SELECT count(*) AS n FROM facts"), gated(two, "facts", "SELECT count(*) AS n FROM facts")
    assert (first.first()["n"], second.first()["n"], spark.table("facts").count()) == (3, 5, 7)
    assert problems(one, "other", "SELECT count(*) FROM facts")
    spark.catalog.dropTempView("facts")


@pytest.mark.parametrize(
    "where,kind",
    [
        ("upper(section) = 'ASIA'", "flat"), ("CAST(period AS INT) + 1 = 1998 AND section LIKE '%s.value%'", "flat"),
        ("value > (SELECT avg(value) FROM sales)", "approximate"), ("rank_ < 3", "approximate"),
    ],
)
def test_lineage_of_conditions(spark, where, kind):
    """What can be asked of the base table names its rows exactly; anything else is called approximate, never exact."""
    from tracegrid.plans.demo import sales
    from tracegrid.plans.sqldag import build

    table = sales(spark, SF)
    inner = "(SELECT *, length(section) AS rank_ FROM sales)" if "rank_" in where else "sales"
    dag = build(table, "sales", f"SELECT sum(value) FROM {inner} s WHERE {where}")
    assert dag.classify() == kind
    exact = table.filter(where).count() if kind == "flat" else table.count()
    assert dag.root_rows().distinct().count() == exact


def test_blocks_number_and_carry_as_one_sequence(spark, monkeypatch):
    """Small blocks give what one window over the whole sheet gives."""
    from pyspark.sql import functions as F

    from tracegrid.operators import order

    monkeypatch.setattr(order, "BLOCK_ROWS", 3)
    data = [(s, r, f"v{r % 4}" if r % 5 == 0 else None) for s in ("a", "b") for r in range(1, 30) if r % 7]
    df = spark.createDataFrame(data, "sheet string, r int, v string")
    got = order.carried(order.with_neighbours(order.numbered(df, ["sheet"], ["r"], "n", whole=["sheet"]), ["sheet"], "r", "r"), ["sheet"], "r", F.col("v"), "last").orderBy("sheet", "r").collect()
    last = {"a": None, "b": None}
    for i, ((sheet, r, v), row) in enumerate(zip(data, got)):
        last[sheet] = v or last[sheet]
        near = [x[1] for x in data if x[0] == sheet]
        k = near.index(r)
        assert (row["n"], row["last"], row["k"], row["j"]) == (i, last[sheet], k + 1, len(near) - k)
        assert (row["before"], row["after"]) == (near[k - 1] if k else None, near[k + 1] if k + 1 < len(near) else None)


def test_citations_stay_bounded(spark, monkeypatch):
    from tracegrid.operators import lineage

    cells = spark.createDataFrame([("S", f"B{r}", str(r), None, r) for r in (*range(2, 30), 40, 42)], "sheet string, a1 string, raw_value string, formula string, row_id long")
    monkeypatch.setattr(lineage, "MOST_CELLS", 5)
    cited = lineage.as_citations(cells)
    assert [c.a1 for c in cited] == ["B2:B29", "B40", "B42"]
    total = float(sum(range(2, 30)) + 82)
    lineage.verify_cells(total, cells, cited, "sum")
    lineage.verify_cells(30.0, cells, cited, "count")
    with pytest.raises(lineage.VerificationError):
        lineage.verify_cells(total + 1, cells, cited, "sum")
    monkeypatch.setattr(lineage, "MOST_CELLS", 2)
    assert [c.a1 for c in lineage.as_citations(cells)] == ["B2:B42"]


def test_dag_shares_common_tables(spark):
    nodes = {r["id"]: r for r in QUERIES["q66_sql_dag_nodes"](spark, SF).collect()}
    cte = [i for i, n in nodes.items() if n["kind"] == "cte"]
    assert len(cte) == 1 and sum(str(cte[0]) in n["inputs"] for n in nodes.values()) == 2


def test_plans_push_filters_down(spark):
    """The scan behind a filtered plan gets its predicate and only the columns it needs."""
    from tracegrid.operators.execute import compile_query
    from tracegrid.plans.catalog import Catalog, Column
    from tracegrid.plans.model import Aggregate, Condition, QueryPlan

    c = Catalog("part", [Column("p_brand", "string"), Column("p_size", "int"), Column("p_retailprice", "double")], "p_retailprice", layout="record")
    table = spark.read.parquet(f"{SF}/part.parquet")
    made = compile_query(QueryPlan(Aggregate("sum", "p_retailprice"), (Condition("p_brand", "=", "Brand#11"),)), c, table)
    text = made.value._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#11)" in text and "p_name" not in text
