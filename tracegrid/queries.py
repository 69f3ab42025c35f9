"""The engine's queries over the driver's tables, each with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.functions import sqlsubset
from tracegrid.operators import execute, findings, ingest, lineage, probe
from tracegrid.plans import catalog as cat
from tracegrid.plans.demo import SALES_SQL, read, sales, sales_catalog, sales_cells, sales_receipts, sales_spec
from tracegrid.plans.model import Aggregate, Condition, DerivedPlan, MultiStepPlan, Part, QueryPlan
from tracegrid.sources.cells import cells_of_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL unless there is none."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def on_sales(select: str) -> str:
    return f"WITH {SALES_SQL} {select}"


def _filters(**equal: str) -> tuple[Condition, ...]:
    return tuple(Condition(k, "=", v) for k, v in equal.items())


ONE = {"entity": "NATION_11", "status": "F", "period": "1997"}
ONE_SQL = "entity = 'NATION_11' AND status = 'F' AND period = '1997'"


def _value(spark: SparkSession, sf: str, plan: QueryPlan, *names: str) -> DataFrame:
    """A plan's value with its slots named for the reader."""
    out = execute.compile_query(plan, sales_catalog(), sales(spark, sf)).value
    return out.withColumnsRenamed({f"v{i}": n for i, n in enumerate(names, 1)})


def _plan(agg: str = "sum", filters: tuple[Condition, ...] = (), by: tuple[str, ...] = (), sort: str = "none", limit: int = 0, column: str = "value") -> QueryPlan:
    return QueryPlan(Aggregate(agg, column), filters, by, sort, limit, " ".join("{v%d}" % (i + 1) for i in range(len(by) + 1)))


# ---------------------------------------------------------------- aggregates and filters


def _register_simple() -> None:
    for k, agg in enumerate(("sum", "avg", "min", "max", "count"), 1):
        where = _filters(section="AFRICA", status="F")

        def run(spark: SparkSession, sf: str, agg: str = agg, where: tuple[Condition, ...] = where) -> DataFrame:
            out = _value(spark, sf, _plan(agg, where), "v")
            return out if agg == "count" else out.select(F.round("v", 4).alias("v"))

        run.__name__ = f"q{k:02d}_{agg}_filtered"
        query(on_sales(f"SELECT {'count(value)' if agg == 'count' else f'round({agg}(value), 4)'} AS v FROM sales WHERE section = 'AFRICA' AND status = 'F'"))(run)


_register_simple()


@query(on_sales("SELECT count(value) AS v FROM sales WHERE entity = 'NOWHERE' AND status = 'ALL'"))
def q06_count_empty(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan("count", _filters(entity="NOWHERE")), "v")


@query(on_sales("SELECT sum(value) AS v FROM sales WHERE entity = 'NOWHERE' AND status = 'ALL'"))
def q07_sum_empty(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan("sum", _filters(entity="NOWHERE")), "v")


OPS_SQL = " UNION ALL ".join(f"SELECT '{op}' AS op, count(value) AS n FROM sales WHERE value {op.replace('!=', '<>')} 20000000 AND status = 'ALL'" for op in ("=", "!=", ">", "<", ">=", "<="))


@query(on_sales(OPS_SQL))
def q08_filter_ops(spark, sf):  # noqa: ANN001, ANN201
    table, c = sales(spark, sf), sales_catalog()
    own = table.filter(execute.all_of(_filters(status="ALL"), c))
    counts = [F.count_if(execute.predicate(Condition("value", op, "20000000"), c)).alias(f"n{i}") for i, op in enumerate(("=", "!=", ">", "<", ">=", "<="))]
    rows = F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"n{i}").alias("n")) for i, op in enumerate(("=", "!=", ">", "<", ">=", "<="))])
    return own.agg(*counts).select(F.inline(rows))


NULLS = "SELECT c_mktsegment AS seg, o_orderkey AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"


@query(f"SELECT count(*) AS n FROM ({NULLS}) WHERE k <> 1")
def q09_null_filter(spark, sf):  # noqa: ANN001, ANN201
    joined = read(spark, sf, "customer").join(read(spark, sf, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    c = cat.Catalog("t", [cat.Column("k", "bigint")], "k", layout="record")
    return joined.select(F.col("o_orderkey").alias("k")).filter(execute.predicate(Condition("k", "!=", "1"), c)).agg(F.count(F.lit(1)).alias("n"))


@query(on_sales("SELECT round(sum(value), 2) AS v FROM sales WHERE period > '1997' AND status = 'ALL'"))
def q10_string_range(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan("sum", (Condition("period", ">", "1997"),)), "v").select(F.round("v", 2).alias("v"))


@query(on_sales("SELECT round(sum(value), 2) AS v FROM sales WHERE section = 'ASIA' AND status = 'ALL' AND row_kind = 'entity'"))
def q11_default_injected(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan("sum", _filters(section="ASIA")), "v").select(F.round("v", 2).alias("v"))


@query(on_sales("SELECT section, round(sum(value), 2) AS v FROM sales WHERE status = 'ALL' GROUP BY section"))
def q12_group_sum(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan(by=("section",)), "section", "v").withColumn("v", F.round("v", 2))


@query(on_sales("SELECT section, period, round(sum(value), 2) AS v FROM sales WHERE status = 'ALL' GROUP BY section, period"))
def q13_group_two_columns(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan(by=("section", "period")), "section", "period", "v").withColumn("v", F.round("v", 2))


def _top(sort: str, limit: int) -> str:
    return on_sales(f"SELECT entity, round(sum(value), 2) AS v FROM sales WHERE period = '1997' AND status = 'F' GROUP BY entity ORDER BY sum(value) {sort} NULLS LAST, entity LIMIT {limit}")


@query(_top("DESC", 1))
def q14_top1(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan(filters=_filters(period="1997", status="F"), by=("entity",), sort="desc", limit=1), "entity", "v").withColumn("v", F.round("v", 2))


@query(_top("ASC", 1))
def q15_bottom1(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan(filters=_filters(period="1997", status="F"), by=("entity",), sort="asc", limit=1), "entity", "v").withColumn("v", F.round("v", 2))


@query(_top("DESC", 10))
def q16_topk(spark, sf):  # noqa: ANN001, ANN201
    return _value(spark, sf, _plan(filters=_filters(period="1997", status="F"), by=("entity",), sort="desc", limit=10), "entity", "v").withColumn("v", F.round("v", 2))


# ---------------------------------------------------------------- derived measures


def _derived(spark: SparkSession, sf: str, op: str, of: tuple[Condition, ...], by: tuple[Condition, ...], scale: float = 1.0) -> DataFrame:
    plan = DerivedPlan((Part("m1", Aggregate("sum", "value"), of), Part("m2", Aggregate("sum", "value"), by)), op, "m1", "m2", scale)
    out = execute.compile_derived(plan, sales_catalog(), sales(spark, sf)).value
    return out.select(F.round("of", 2).alias("of"), F.round("by", 2).alias("by"), F.round("v1", 6).alias("v"))


def _two(of: str, by: str, expr: str) -> str:
    return on_sales(f"SELECT round(a, 2) AS of, round(b, 2) AS by, round({expr}, 6) AS v FROM (SELECT sum(value) FILTER (WHERE {of}) AS a, sum(value) FILTER (WHERE {by}) AS b FROM sales WHERE status = 'ALL')")


@query(_two("section = 'ASIA' AND period = '1997'", "period = '1997'", "a / b * 100"))
def q17_share(spark, sf):  # noqa: ANN001, ANN201
    return _derived(spark, sf, "divide", _filters(section="ASIA", period="1997"), _filters(period="1997"), 100)


@query(_two("section = 'ASIA' AND period = '2000'", "section = 'ASIA' AND period = '1997'", "(a - b) / b * 100"))
def q18_growth(spark, sf):  # noqa: ANN001, ANN201
    return _derived(spark, sf, "percent_change", _filters(section="ASIA", period="2000"), _filters(section="ASIA", period="1997"), 100)


@query(_two("section = 'ASIA' AND period = '2000'", "section = 'ASIA' AND period = '1997'", "a - b"))
def q19_difference(spark, sf):  # noqa: ANN001, ANN201
    return _derived(spark, sf, "subtract", _filters(section="ASIA", period="2000"), _filters(section="ASIA", period="1997"))


@query(on_sales("SELECT period, entity, round(value, 2) AS value, round(sum(value) OVER (PARTITION BY period), 2) AS total, round(value / sum(value) OVER (PARTITION BY period) * 100, 6) AS share FROM (SELECT period, entity, sum(value) AS value FROM sales WHERE status = 'ALL' GROUP BY ALL)"))
def q20_share_per_entity(spark, sf):  # noqa: ANN001, ANN201
    base = sales(spark, sf).filter("status = 'ALL'")
    out = execute.share_of_whole(base, "value", ["entity"], ["period"])
    return out.select("period", "entity", F.round("value", 2).alias("value"), F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("SELECT s_nationkey AS k, round(sum(s_acctbal) / nullif(sum(CASE WHEN s_nationkey < 3 THEN 0.0 ELSE s_acctbal END), 0), 6) AS v FROM supplier GROUP BY 1")
def q21_zero_denominator(spark, sf):  # noqa: ANN001, ANN201
    each = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("a"), F.sum(F.when(F.col("s_nationkey") < 3, 0.0).otherwise(F.col("s_acctbal"))).alias("b"))
    return each.select("k", F.round(execute.combine("divide", F.col("a"), F.col("b"), 1.0), 6).alias("v"))


# ---------------------------------------------------------------- lineage


@query(on_sales(f"SELECT __row_id FROM sales WHERE {ONE_SQL}"))
def q22_provenance_rows(spark, sf):  # noqa: ANN001, ANN201
    return execute.compile_query(_plan(filters=_filters(**ONE)), sales_catalog(), sales(spark, sf)).provenance()


@query(on_sales("SELECT __row_id FROM sales WHERE period = '1997' AND status = 'F' AND entity = (SELECT entity FROM sales WHERE period = '1997' AND status = 'F' GROUP BY entity ORDER BY sum(value) DESC, entity LIMIT 1)"))
def q23_provenance_group(spark, sf):  # noqa: ANN001, ANN201
    made = execute.compile_query(_plan(filters=_filters(period="1997", status="F"), by=("entity",), sort="desc", limit=1), sales_catalog(), sales(spark, sf))
    return made.provenance((made.value.first()["v1"],))  # one row


@query(on_sales(f"SELECT 'value' AS part, sheet, a1, raw_value FROM cell_map WHERE column_name = 'value' AND row_id IN (SELECT __row_id FROM sales WHERE section = 'ASIA' AND period = '1997' AND status = 'F') UNION ALL SELECT * FROM (SELECT 'label', sheet, a1, raw_value FROM cell_map WHERE column_name = 'section' AND row_id = (SELECT min(__row_id) FROM sales WHERE section = 'ASIA' AND period = '1997' AND status = 'F'))"))
def q24_citations(spark, sf):  # noqa: ANN001, ANN201
    table = sales(spark, sf)
    made = execute.compile_query(_plan(filters=_filters(section="ASIA", period="1997", status="F")), sales_catalog(), table)
    receipts = sales_receipts(table)
    cells = lineage.citations(made.provenance(), receipts, "value").select(F.lit("value").alias("part"), "sheet", "a1", "raw_value")
    label = lineage.first_citation(made.provenance(), receipts, "section").select(F.lit("label").alias("part"), "sheet", "a1", "raw_value")
    return cells.unionByName(label)


def _check(spark: SparkSession, sf: str, agg: str) -> DataFrame:
    table = sales(spark, sf)
    made = execute.compile_query(_plan(agg, _filters(section="ASIA", period="1997")), sales_catalog(), table)
    cells = lineage.citations(made.provenance(), sales_receipts(table), "value")
    return lineage.lineage_check(made.value, cells, agg).select(F.round("value", 4).alias("value"), F.round("cited", 4).alias("cited"), "ok")


def _check_sql(agg: str) -> str:
    where = "section = 'ASIA' AND period = '1997' AND status = 'ALL'"
    return on_sales(f"SELECT round(v, 4) AS value, round(c, 4) AS cited, abs(v - c) <= 1e-6 * greatest(1, abs(v)) AS ok FROM (SELECT {agg}(value)::DOUBLE AS v FROM sales WHERE {where}), (SELECT {agg}(CAST(raw_value AS DOUBLE))::DOUBLE AS c FROM cell_map WHERE column_name = 'value' AND row_id IN (SELECT __row_id FROM sales WHERE {where}))")


def _register_checks() -> None:
    for k, agg in ((25, "sum"), (26, "avg"), (27, "max"), (27, "min"), (27, "count")):

        def run(spark: SparkSession, sf: str, agg: str = agg) -> DataFrame:
            return _check(spark, sf, agg)

        run.__name__ = f"q{k}_lineage_check_{agg}"
        query(_check_sql(agg))(run)


_register_checks()


@query(on_sales("SELECT round(a, 2) AS part_of, round(b, 2) AS part_by, round((a - b) / b * 100, 6) AS recomputed FROM (SELECT sum(CAST(raw_value AS DOUBLE)) FILTER (WHERE period = '2000') AS a, sum(CAST(raw_value AS DOUBLE)) FILTER (WHERE period = '1997') AS b FROM cell_map JOIN sales ON row_id = __row_id WHERE column_name = 'value' AND section = 'ASIA' AND status = 'ALL')"))
def q28_derived_check(spark, sf):  # noqa: ANN001, ANN201
    table = sales(spark, sf)
    receipts = sales_receipts(table)
    parts = (Part("m1", Aggregate("sum", "value"), _filters(section="ASIA", period="2000")), Part("m2", Aggregate("sum", "value"), _filters(section="ASIA", period="1997")))
    made = execute.compile_derived(DerivedPlan(parts, "percent_change", "m1", "m2", 100), sales_catalog(), table)
    a, b = (lineage.cited_aggregate(lineage.citations(made.provenance(p), receipts, "value")).select(F.col("sum").alias(n)) for p, n in (("m1", "a"), ("m2", "b")))
    both = a.crossJoin(b)  # two single rows
    return both.select(F.round("a", 2).alias("part_of"), F.round("b", 2).alias("part_by"), F.round(execute.combine("percent_change", F.col("a"), F.col("b"), 100), 6).alias("recomputed"))


RANGES = "SELECT sheet, letter || min(r) || CASE WHEN min(r) < max(r) THEN ':' || letter || max(r) ELSE '' END AS ref, count(*) AS n_cells FROM (SELECT sheet, regexp_extract(a1, '^([A-Z]+)', 1) AS letter, r, r - row_number() OVER (PARTITION BY sheet, regexp_extract(a1, '^([A-Z]+)', 1) ORDER BY r) AS island FROM sales WHERE period = '1997' AND status IN ('F', 'ALL')) GROUP BY sheet, letter, island"


@query(on_sales(RANGES))
def q29_ranges(spark, sf):  # noqa: ANN001, ANN201
    return lineage.collapse_ranges(sales(spark, sf).filter("period = '1997' AND status IN ('F', 'ALL')").select("sheet", "a1"))


@query(on_sales("SELECT sheet, a1 FROM sales WHERE period = '1997'"))
def q29_range_expansion(spark, sf):  # noqa: ANN001, ANN201
    return lineage.expand_ranges(lineage.collapse_ranges(sales(spark, sf).filter("period = '1997'").select("sheet", "a1")))


@query(on_sales("SELECT entity, count(*) AS n_cites FROM sales JOIN cell_map ON row_id = __row_id AND column_name = 'value' WHERE status = 'ALL' GROUP BY entity"))
def q30_citation_counts(spark, sf):  # noqa: ANN001, ANN201
    table = sales(spark, sf)
    return lineage.citation_counts(table.filter("status = 'ALL'"), sales_receipts(table), ["entity"], "value")


# ---------------------------------------------------------------- ingest


WIDE = "SELECT s_suppkey AS k, s_acctbal AS bal, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal * 2 END AS twice FROM supplier"


@query(f"SELECT k, variable, value FROM (UNPIVOT ({WIDE}) ON bal, twice INTO NAME variable VALUE value)")
def q31_unpivot(spark, sf):  # noqa: ANN001, ANN201
    wide = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") * 2).alias("twice"))
    return ingest.unpivot_wide(wide, ["k"], ["bal", "twice"], "variable", "value")


# The sales sheets as cells, read by the real ingest: titles, notes, two header rows, sections, subtotals, constants.
CROSSTAB = """
crosstab AS (
  SELECT row_number() OVER (ORDER BY sheet, r, c) - 1 AS row_id, * FROM (
    SELECT sheet, r, c, header_r, entity AS label, entity, section, 'Year ' || period AS period, status, value, 'entity' AS row_kind, entity || ' [1]' AS raw_label FROM sales UNION ALL
    SELECT sheet, (SELECT max(r) + 1 FROM placed p WHERE p.section = sales.section), c, header_r, 'Region Total', NULL, section, 'Year ' || period, status,
           CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 'subtotal', 'Region Total*'
    FROM sales GROUP BY sheet, section, c, header_r, period, status))
"""


def on_crosstab(select: str) -> str:
    return f"WITH {SALES_SQL}, {CROSSTAB} {select}"


def _crosstab(spark: SparkSession, sf: str) -> ingest.Tidy:
    return ingest.ingest_crosstab(sales_cells(spark, sf), sales_spec(spark, sf))


@query(on_crosstab("SELECT row_id, entity, section, period, status, value, row_kind, CASE WHEN row_kind <> 'entity' THEN label END AS row_label FROM crosstab"))
def q31_crosstab_ingest(spark, sf):  # noqa: ANN001, ANN201
    return _crosstab(spark, sf).rows.withColumnRenamed("__row_id", "row_id")


AT = "chr((64 + c)::INT)"


@query(
    on_crosstab(
        f"SELECT row_id, 'value' AS column_name, sheet, {AT} || r AS a1, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS raw_value, false AS synthetic FROM crosstab UNION ALL "
        f"SELECT row_id, 'period', sheet, {AT} || '6', period, false FROM crosstab UNION ALL SELECT row_id, 'row_kind', sheet, 'A' || r, raw_label, false FROM crosstab UNION ALL "
        "SELECT row_id, 'entity', sheet, 'A' || r, raw_label, false FROM crosstab WHERE row_kind = 'entity' UNION ALL "
        "SELECT row_id, 'section', sheet, 'A' || header_r, section, false FROM crosstab UNION ALL SELECT row_id, 'status', sheet, 'A1', status, true FROM crosstab"
    )
)
def q35_crosstab_receipts(spark, sf):  # noqa: ANN001, ANN201
    return _crosstab(spark, sf).receipts.select("row_id", "column_name", "sheet", "a1", "raw_value", "synthetic")


@query(on_sales(f"SELECT DISTINCT sheet, c::INT AS c, 'Year ' || period AS label, {AT} || '6' AS header_a1 FROM sales"))
def q31_stacked_headers(spark, sf):  # noqa: ANN001, ANN201
    spec = sales_spec(spark, sf)
    numbers = spec.sheets[0].value_numbers
    return ingest.header_labels(sales_cells(spark, sf), spec.sheets[0].header_rows, min(numbers), max(numbers))


@query("SELECT s AS sheet, 'A' || r AS a1, t AS text FROM (VALUES ('ALL'), ('F'), ('O'), ('P')) x(s), (VALUES (3, 'Orders by nation and year'), (4, 'Figures in currency [1]')) y(r, t)")
def q35_notes(spark, sf):  # noqa: ANN001, ANN201
    return ingest.notes(sales_cells(spark, sf), sales_spec(spark, sf))


@query("SELECT 'crosstab' AS layout, 8 AS first_row, (SELECT max(r) + 1 FROM (SELECT 8 + row_number() OVER (ORDER BY r_name, n_name) + 2 * (dense_rank() OVER (ORDER BY r_name) - 1) AS r FROM nation JOIN region ON n_regionkey = r_regionkey))::INT AS last_row, 'B' AS first_column, 'A' AS label_column, '7' AS headers, 'section_header,subtotal' AS kinds")
def q31_geometry(spark, sf):  # noqa: ANN001, ANN201
    """How an unseen sheet is read: the block, its headers, labels and row kinds."""
    from tracegrid.plans.geometry import read_sheet

    got = read_sheet(sales_cells(spark, sf), "ALL")
    x = got.sheet
    row = (got.layout, x.first_data_row, x.last_data_row, x.value_columns[0], x.label_column, ",".join(map(str, x.header_rows)), ",".join(sorted(x.row_kinds)))
    return spark.createDataFrame([row], "layout string, first_row int, last_row int, first_column string, label_column string, headers string, kinds string")


PLACES = "(SELECT n_name, r_name, 8 + row_number() OVER (ORDER BY r_name, n_name) + 2 * (dense_rank() OVER (ORDER BY r_name) - 1) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT r::INT AS r, n_name AS label, r_name AS section, 'A' || (min(r) OVER (PARTITION BY r_name) - 1) AS section_a1 FROM {PLACES}")
def q32_section_ffill(spark, sf):  # noqa: ANN001, ANN201
    return ingest.filled_sections(_labels(spark, sf), ["sheet"]).filter("row_kind = 'entity'").select("r", "label", "section", "section_a1")


def _label_column(spark: SparkSession, sf: str) -> DataFrame:
    """The label column of the sales sheet as text: section headers, nations and subtotals, by row."""
    places = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ranked = places.select("n_name", "r_name", F.row_number().over(Window.orderBy("r_name", "n_name")).alias("k"), F.dense_rank().over(Window.orderBy("r_name")).alias("s"))
    ranked = ranked.withColumn("r", 8 + F.col("k") + 2 * (F.col("s") - 1))
    ends = ranked.groupBy("r_name").agg((F.min("r") - 1).alias("head"), (F.max("r") + 1).alias("foot"))
    out = ranked.select("r", F.concat("n_name", F.lit(" [1]")).alias("text"))
    out = out.unionByName(ends.select(F.col("head").alias("r"), F.concat(F.lit("REGION - "), "r_name").alias("text")))
    return out.unionByName(ends.select(F.col("foot").alias("r"), F.lit("Region Total*").alias("text")))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"subtotal": r"^Region\ Total$", "section_header": r"^REGION\ \-\ "}
    label = ingest.clean_label(F.col("text"))
    out = _label_column(spark, sf).select(F.lit("ALL").alias("sheet"), F.col("r").cast("int").alias("r"), F.concat(F.lit("A"), F.col("r").cast("string")).alias("a1"), label.alias("label"))
    return out.withColumn("row_kind", ingest.row_kind(F.col("label"), kinds)).withColumn("section_text", F.trim(F.regexp_replace("label", "^REGION - ", "")))


@query(f"SELECT row_kind, count(*) AS n FROM (SELECT 'entity' AS row_kind FROM {PLACES} UNION ALL SELECT 'subtotal' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'section_header' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)) GROUP BY 1")
def q33_row_kind(spark, sf):  # noqa: ANN001, ANN201
    return _labels(spark, sf).groupBy("row_kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS k, trim(regexp_replace(p_name || ' [' || p_size || ']*', '\\[\\d+\\]|\\*', '', 'g')) AS label FROM part")
def q34_clean_label(spark, sf):  # noqa: ANN001, ANN201
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), ingest.clean_label(F.concat("p_name", F.lit(" ["), F.col("p_size").cast("string"), F.lit("]*"))).alias("label"))


@query(on_sales("SELECT row_id, column_name, sheet, a1, raw_value FROM cell_map"))
def q35_receipts_long(spark, sf):  # noqa: ANN001, ANN201
    return sales_receipts(sales(spark, sf)).drop("formula")


@query("SELECT c_nationkey AS c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def q36_grain_guard(spark, sf):  # noqa: ANN001, ANN201
    return ingest.duplicates(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


def _supplier_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("__row_id"), F.col("s_name").alias("Name"), F.when(F.col("s_nationkey") != 3, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("Nation"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("Balance"),
    )
    return cells_of_table(rows, "Sheet1")


def _supplier_spec(n: int):  # noqa: ANN202
    from tracegrid.plans.spec import SheetSpec, Spec

    return Spec("suppliers.csv", "suppliers", "record", "Name", "Balance", None, [SheetSpec("Sheet1", [1], 2, n + 1, ["C"], id_columns=["A", "B"])])


RECORD = "SELECT s_suppkey AS k, s_name, CASE WHEN s_nationkey <> 3 THEN 'N' || s_nationkey END AS nation, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS bal FROM supplier"


@query(f'SELECT row_number() OVER (ORDER BY k) - 1 AS row_id, s_name AS "Name", nation AS "Nation", bal AS "Balance" FROM ({RECORD})')
def q37_record_ingest(spark, sf):  # noqa: ANN001, ANN201
    n = read(spark, sf, "supplier").count()
    rows = ingest.ingest_record(_supplier_cells(spark, sf), _supplier_spec(n)).rows
    return rows.select(F.col("__row_id").alias("row_id"), "Name", "Nation", "Balance")


@query(f"SELECT column_name, count(*) AS n, min(a1) AS least FROM (SELECT 'Name' AS column_name, 'A' || (k + 2) AS a1 FROM ({RECORD}) UNION ALL SELECT 'Nation', 'B' || (k + 2) FROM ({RECORD}) WHERE nation IS NOT NULL UNION ALL SELECT 'Balance', 'C' || (k + 2) FROM ({RECORD}) WHERE bal IS NOT NULL) GROUP BY 1")
def q37_record_receipts(spark, sf):  # noqa: ANN001, ANN201
    n = read(spark, sf, "supplier").count()
    receipts = ingest.ingest_record(_supplier_cells(spark, sf), _supplier_spec(n)).receipts
    return receipts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.min("a1").alias("least"))


@query(on_sales("SELECT __row_id, sheet, r::INT AS r, c::INT AS c FROM sales"))
def q38_row_id(spark, sf):  # noqa: ANN001, ANN201
    return sales(spark, sf).select("__row_id", "sheet", "r", "c")


# ---------------------------------------------------------------- profiling and catalog


def _nullable(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice")).alias("price"), F.year("o_orderdate").cast("string").alias("period"))


NULLABLE = "(SELECT o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS price, CAST(year(o_orderdate) AS VARCHAR) AS period FROM orders)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM {NULLABLE}" for c in ("o_orderstatus", "priority", "price", "period")))
def q39_null_distinct_profile(spark, sf):  # noqa: ANN001, ANN201
    return cat.column_statistics(_nullable(spark, sf))


@query(" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS label FROM {NULLABLE} WHERE {c} IS NOT NULL" for c in ("o_orderstatus", "priority", "period")))
def q40_labels(spark, sf):  # noqa: ANN001, ANN201
    return cat.label_listing(_nullable(spark, sf), ["o_orderstatus", "priority", "period"])


def _periodic(c: str) -> str:
    hits = ", ".join(f"count(*) FILTER (WHERE regexp_matches(l, '{p}'))" for p in cat.PERIOD_PATTERNS)
    return f"SELECT '{c}' AS column_name, count(*) >= 3 AND greatest({hits}) >= 0.8 * count(*) AS periodic FROM (SELECT DISTINCT {c} AS l FROM {NULLABLE} WHERE {c} IS NOT NULL)"


@query(" UNION ALL ".join(_periodic(c) for c in ("o_orderstatus", "priority", "period")))
def q41_periodic_columns(spark, sf):  # noqa: ANN001, ANN201
    labels = cat.label_listing(_nullable(spark, sf), ["o_orderstatus", "priority", "period"])
    hits = [F.count_if(F.col("label").rlike(p)) for p in cat.PERIOD_PATTERNS]
    return labels.groupBy("column_name").agg(((F.count(F.lit(1)) >= 3) & (F.greatest(*hits) >= 0.8 * F.count(F.lit(1)))).alias("periodic"))


@query(f"SELECT c::INT AS c, text, numeric, CASE WHEN text > numeric THEN 'text' ELSE 'numeric' END AS type FROM (SELECT 1 AS c, count(*) + 1 AS text, 0 AS numeric FROM ({RECORD}) UNION ALL SELECT 2, count(nation) + 1, 0 FROM ({RECORD}) UNION ALL SELECT 3, 1, count(bal) FROM ({RECORD}))")
def q42_column_types(spark, sf):  # noqa: ANN001, ANN201
    return probe.column_profile(_supplier_cells(spark, sf)).select("c", "text", "numeric", "type")


SHAPES = f"(SELECT k + 2 AS r, 'T' || CASE WHEN nation IS NULL THEN '.' ELSE 'T' END || '#' AS full_, bal, nation FROM ({RECORD}) UNION ALL SELECT 1, 'TTT', 0, '')"
MARKS = f"(SELECT r, CASE WHEN bal IS NOT NULL THEN full_ WHEN nation IS NOT NULL THEN 'TT' ELSE 'T' END AS marks FROM {SHAPES})"


@query(f"SELECT r::INT AS r, marks, length(replace(marks, '.', '')) AS filled FROM {MARKS}")
def q43_row_shape(spark, sf):  # noqa: ANN001, ANN201
    return probe.row_profile(_supplier_cells(spark, sf)).select("r", "marks", "filled")


@query(f"SELECT r::INT AS r, marks FROM (SELECT *, lag(marks) OVER w AS b, lead(marks) OVER w AS a, row_number() OVER w AS k, count(*) OVER () AS n FROM {MARKS} WINDOW w AS (ORDER BY r)) WHERE k <= 4 OR k > n - 4 OR b <> marks OR a <> marks")
def q44_shape_changes(spark, sf):  # noqa: ANN001, ANN201
    return probe.anchors(probe.row_profile(_supplier_cells(spark, sf))).select("r", "marks")


@query(on_sales("SELECT round(sum(value), 2) AS naive, round(sum(value) FILTER (WHERE status = 'ALL'), 2) AS correct FROM sales"))
def q45_overlap_trap(spark, sf):  # noqa: ANN001, ANN201
    table = sales(spark, sf)
    naive = table.agg(F.round(F.sum("value"), 2).alias("naive"))
    return naive.crossJoin(_value(spark, sf, _plan(), "v").select(F.round("v", 2).alias("correct")))  # two single rows


# ---------------------------------------------------------------- statistics, groups and SQL shapes


@query("SELECT event_type, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stddev, round(var_samp(value), 6) AS variance, round(quantile_cont(value, 0.9), 6) AS p90, quantile_disc(value, 0.5) AS p50_disc FROM events GROUP BY event_type")
def q46_statistics(spark, sf):  # noqa: ANN001, ANN201
    return sqlsubset.statistics(read(spark, sf, "events"), ["event_type"], "value")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_discount), 6) AS covar, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def q50_correlation(spark, sf):  # noqa: ANN001, ANN201
    one = read(spark, sf, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("corr"), F.covar_samp("l_quantity", "l_discount").alias("covar"), F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def _multi(spark: SparkSession, sf: str, operation: str, outer: str):  # noqa: ANN202
    plan = MultiStepPlan("value", "entity", operation, outer, _filters(period="2000"), _filters(period="1997") if operation != "level" else ())
    return execute.compile_multi_step(plan, sales_catalog(), sales(spark, sf))


def _multi_sql(expr: str, outer: str) -> str:
    return on_sales(f"SELECT round({outer}({expr}), 6) AS v FROM (SELECT entity, sum(value) FILTER (WHERE period = '2000') AS a, sum(value) FILTER (WHERE period = '1997') AS b FROM sales WHERE status = 'ALL' GROUP BY entity)")


def _register_multi() -> None:
    for operation, expr in (("level", "a"), ("difference", "a - b"), ("ratio", "a / b"), ("percent_change", "(a - b) / b * 100")):

        def run(spark: SparkSession, sf: str, operation: str = operation) -> DataFrame:
            return _multi(spark, sf, operation, "avg").value.select(F.round("v1", 6).alias("v"))

        run.__name__ = f"q51_avg_{operation}_over_groups"
        query(_multi_sql(expr, "avg"))(run)


_register_multi()


@query(on_sales("SELECT __row_id FROM sales WHERE status = 'ALL' AND period IN ('1997', '2000') AND entity IN (SELECT entity FROM sales WHERE status = 'ALL' GROUP BY entity HAVING count(*) FILTER (WHERE period = '1997') > 0 AND count(*) FILTER (WHERE period = '2000') > 0)"))
def q51_multi_step_lineage(spark, sf):  # noqa: ANN001, ANN201
    return _multi(spark, sf, "percent_change", "avg").rows


def _sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """SQL over the sales table alone, through the gate."""
    from tracegrid.plans.sqlgate import gated

    return gated(sales(spark, sf), "sales", text)


def _register_sql() -> None:
    shapes = {
        "q52_above_average": "SELECT count(*) AS n FROM (SELECT entity, sum(value) AS v FROM sales WHERE status = 'ALL' GROUP BY entity) WHERE v > (SELECT avg(v) FROM (SELECT sum(value) AS v FROM sales WHERE status = 'ALL' GROUP BY entity))",
        "q53_count_having": "SELECT count(*) AS n FROM (SELECT entity FROM sales WHERE status = 'ALL' GROUP BY entity HAVING sum(value) > 100000000)",
        "q54_case_pivot": "SELECT section, round(sum(CASE WHEN period = '1996' THEN value END), 2) AS y1996, round(sum(CASE WHEN period = '1997' THEN value END), 2) AS y1997 FROM sales WHERE status = 'ALL' GROUP BY section",
        "q55_filter_clause": "SELECT section, round(sum(value) FILTER (WHERE period > '1997'), 2) AS late, count(*) FILTER (WHERE period <= '1997') AS early FROM sales WHERE status = 'ALL' GROUP BY section",
        "q56_join_ctes": "WITH a AS (SELECT entity, sum(value) AS v FROM sales WHERE status = 'F' GROUP BY entity), b AS (SELECT entity, sum(value) AS v FROM sales WHERE status = 'O' GROUP BY entity) SELECT a.entity, round(a.v / b.v, 6) AS ratio FROM a JOIN b ON a.entity = b.entity",
        "q63_rank_window": "SELECT section, entity, CAST(rank() OVER (PARTITION BY section ORDER BY v DESC) AS BIGINT) AS k, round(v - lag(v) OVER (PARTITION BY section ORDER BY v DESC), 2) AS gap FROM (SELECT section, entity, sum(value) AS v FROM sales WHERE status = 'ALL' GROUP BY section, entity)",
        "q63_set_operations": "SELECT period, section FROM sales WHERE status = 'F' EXCEPT SELECT period, section FROM sales WHERE status = 'P' AND period < '1997'",
        "q63_grouping_sets": "SELECT section, period, round(sum(value), 2) AS v FROM sales WHERE status = 'ALL' GROUP BY ROLLUP (section, period)",
        "q63_string_functions": "SELECT DISTINCT upper(substr(entity, 1, 3)) AS a, replace(section, 'A', '-') AS b, CAST(length(section) AS BIGINT) AS n, section LIKE 'A%' AS starts FROM sales",
        "q63_math_functions": "SELECT entity, period, round(sqrt(value), 4) AS s, round(ln(value), 6) AS l, CAST(greatest(floor(value), 5) AS BIGINT) AS f FROM sales WHERE status = 'ALL' AND section = 'ASIA'",
    }
    for name, text in shapes.items():

        def run(spark: SparkSession, sf: str, text: str = text) -> DataFrame:
            return _sql(spark, sf, text)

        run.__name__ = name
        query(f"WITH {SALES_SQL} " + (", " + text[5:] if text.startswith("WITH ") else text))(run)


_register_sql()

# Statements whose words differ between engines: Spark's, and the same for DuckDB.
BOTH = {
    "q63_dates": (
        "SELECT DISTINCT period, year(make_date(CAST(period AS INT), 3, 1)) AS y, CAST(date_diff(make_date(CAST(period AS INT), 12, 31), make_date(CAST(period AS INT), 1, 1)) AS BIGINT) AS days, CAST(date_trunc('month', make_date(CAST(period AS INT), 3, 15)) AS DATE) AS m, CAST(quarter(make_date(CAST(period AS INT), 8, 1)) AS BIGINT) AS q FROM sales",
        "SELECT DISTINCT period, year(make_date(CAST(period AS INT), 3, 1))::INT AS y, date_diff('day', make_date(CAST(period AS INT), 1, 1), make_date(CAST(period AS INT), 12, 31)) AS days, CAST(date_trunc('month', make_date(CAST(period AS INT), 3, 15)) AS DATE) AS m, quarter(make_date(CAST(period AS INT), 8, 1)) AS q FROM sales",
    ),
    "q63_arg_max": (
        "SELECT section, max_by(entity, value) AS best, min_by(entity, value) AS worst FROM sales WHERE status = 'ALL' AND period = '1997' GROUP BY section",
        "SELECT section, arg_max(entity, value) AS best, arg_min(entity, value) AS worst FROM sales WHERE status = 'ALL' AND period = '1997' GROUP BY section",
    ),
    "q63_regression": (
        "SELECT round(regr_intercept(value, CAST(period AS DOUBLE)) / 1e6, 4) AS intercept, round(regr_r2(value, CAST(period AS DOUBLE)), 6) AS r2, regr_count(value, CAST(period AS DOUBLE)) AS n FROM sales WHERE status = 'ALL'",
        "SELECT round(regr_intercept(value, CAST(period AS DOUBLE)) / 1e6, 4) AS intercept, round(regr_r2(value, CAST(period AS DOUBLE)), 6) AS r2, regr_count(value, CAST(period AS DOUBLE))::BIGINT AS n FROM sales WHERE status = 'ALL'",
    ),
    "q63_division_by_zero": (
        "SELECT section, try_divide(sum(value), count_if(entity = 'NOWHERE')) AS v, round(try_divide(sum(value), count(*)), 2) AS mean FROM sales GROUP BY section",
        "SELECT section, sum(value) / nullif(count(*) FILTER (WHERE entity = 'NOWHERE'), 0) AS v, round(sum(value) / count(*), 2) AS mean FROM sales GROUP BY section",
    ),
}


def _register_both() -> None:
    for name, (own, theirs) in BOTH.items():

        def run(spark: SparkSession, sf: str, text: str = own) -> DataFrame:
            return _sql(spark, sf, text)

        run.__name__ = name
        query(on_sales(theirs))(run)


_register_both()


@query("SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY event_type")
def q46_median_absolute_deviation(spark, sf):  # noqa: ANN001, ANN201
    return sqlsubset.median_absolute_deviation(read(spark, sf, "events"), ["event_type"], "value").withColumn("mad", F.round("mad", 6))


@query("SELECT event_type, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM events GROUP BY event_type")
def q46_skewness_kurtosis(spark, sf):  # noqa: ANN001, ANN201
    return sqlsubset.shape(read(spark, sf, "events"), ["event_type"], "value")


@query("SELECT o_orderstatus, arg_max(o_orderpriority, (n, o_orderpriority)) AS mode FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def q46_mode(spark, sf):  # noqa: ANN001, ANN201
    return sqlsubset.most_frequent(read(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority", "mode")


FLAT_FUNCTIONS = "upper(section) = 'ASIA' AND length(entity) = 9 AND CAST(period AS INT) % 2 = 1 AND status IN ('F', 'O')"


@query(on_sales(f"SELECT __row_id FROM sales WHERE {FLAT_FUNCTIONS}"))
def q64_function_lineage(spark, sf):  # noqa: ANN001, ANN201
    """Functions and arithmetic in WHERE name their rows as plain comparisons do."""
    from tracegrid.plans.sqldag import build

    return build(sales(spark, sf), "sales", f"SELECT sum(s.value) AS v FROM (SELECT * FROM sales) s WHERE {FLAT_FUNCTIONS}").root_rows()


# ---------------------------------------------------------------- findings


@query(on_sales("SELECT row_number() OVER (ORDER BY v DESC, entity)::INT AS rank, entity, round(v, 2) AS value FROM (SELECT entity, sum(value) AS v FROM sales WHERE status = 'ALL' GROUP BY entity ORDER BY v DESC, entity LIMIT 5)"))
def q57_leaderboard(spark, sf):  # noqa: ANN001, ANN201
    return findings.leaderboard(sales(spark, sf).filter("status = 'ALL'"), "entity", "value").withColumn("value", F.round("value", 2))


@query(on_sales("SELECT t.entity, c.sheet, c.a1, c.raw_value FROM (SELECT entity FROM sales WHERE status = 'ALL' GROUP BY entity ORDER BY sum(value) DESC, entity LIMIT 5) t JOIN sales s ON s.entity = t.entity AND s.status = 'ALL' JOIN cell_map c ON c.row_id = s.__row_id AND c.column_name = 'value'"))
def q57_leaderboard_cells(spark, sf):  # noqa: ANN001, ANN201
    table = sales(spark, sf)
    out = findings.leaderboard_cells(table.filter("status = 'ALL'"), sales_receipts(table), "entity", "value")
    return out.select("entity", "sheet", "a1", "raw_value")


@query(on_sales("SELECT period, round(v, 2) AS value, round((v - lag(v) OVER (ORDER BY period)) / lag(v) OVER (ORDER BY period) * 100, 6) AS change FROM (SELECT period, sum(value) AS v FROM sales WHERE status = 'ALL' GROUP BY period)"))
def q58_trend(spark, sf):  # noqa: ANN001, ANN201
    return findings.trend(sales(spark, sf).filter("status = 'ALL'"), "period", "value").select("period", F.round("value", 2).alias("value"), F.round("change", 6).alias("change"))


@query(on_sales("SELECT count(*) AS periods, min(period) AS first, max(period) AS last, round((arg_max(v, period) - arg_min(v, period)) / arg_min(v, period) * 100, 6) AS pct, arg_max(v, period) > arg_min(v, period) AS risen FROM (SELECT period, sum(value) AS v FROM sales WHERE status = 'ALL' GROUP BY period)"))
def q58_trend_summary(spark, sf):  # noqa: ANN001, ANN201
    return findings.trend_summary(sales(spark, sf).filter("status = 'ALL'"), "period", "value").select("periods", "first", "last", F.round("pct", 6).alias("pct"), "risen")


@query(on_sales("SELECT entity, period, round(v, 2) AS value, round(t, 2) AS total, round(v / t * 100, 6) AS share FROM (SELECT entity, period, sum(value) AS v, sum(sum(value)) OVER () AS t FROM sales WHERE status = 'ALL' AND period = (SELECT max(period) FROM sales WHERE status = 'ALL') GROUP BY entity, period) ORDER BY v DESC, entity DESC LIMIT 1"))
def q59_leader_share(spark, sf):  # noqa: ANN001, ANN201
    out = findings.leader_share(sales(spark, sf).filter("status = 'ALL'"), "entity", "period", "value")
    return out.select("entity", "period", F.round("value", 2).alias("value"), F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query(on_sales("SELECT entity, round(a, 2) AS first, round(b, 2) AS last, round((b - a) / a * 100, 6) AS pct FROM (SELECT entity, sum(value) FILTER (WHERE period = '1996') AS a, sum(value) FILTER (WHERE period = '2000') AS b FROM sales WHERE status = 'ALL' AND period IN ('1996', '2000') GROUP BY entity)"))
def q60_entity_growth(spark, sf):  # noqa: ANN001, ANN201
    out = findings.entity_growth(sales(spark, sf).filter("status = 'ALL'"), "entity", "period", "value", "1996", "2000")
    return out.select("entity", F.round("first", 2).alias("first"), F.round("last", 2).alias("last"), F.round("pct", 6).alias("pct"))


@query("SELECT count(s_name) AS n FROM supplier")
def q61_entity_count(spark, sf):  # noqa: ANN001, ANN201
    return findings.entity_count(read(spark, sf, "supplier"), "s_name")


@query("SELECT * FROM (SELECT 'p_size' AS measure, p_name AS entity, p_size::DOUBLE AS value FROM part ORDER BY p_size DESC, p_name DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'p_retailprice', p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_name DESC LIMIT 1)")
def q62_measure_leaders(spark, sf):  # noqa: ANN001, ANN201
    return findings.measure_leaders(read(spark, sf, "part"), "p_name", ["p_size", "p_retailprice"])


@query(on_sales("SELECT section AS parent, count(*) AS n, min(__row_id) AS least, max(__row_id) AS most FROM sales WHERE status = 'ALL' AND period = '1997' GROUP BY section"))
def q64_group_lineage(spark, sf):  # noqa: ANN001, ANN201
    edges = lineage.lineage_edges(sales(spark, sf).filter("status = 'ALL' AND period = '1997'"), ["section"]).filter("parent <> 'total'")
    ids = edges.select("parent", F.substring_index("child", ":", -1).cast("long").alias("id"))
    return ids.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query(on_sales("SELECT __row_id FROM sales WHERE (status = 'F' AND period = '1997') OR (status = 'O' AND section = 'ASIA')"))
def q64_flat_lineage(spark, sf):  # noqa: ANN001, ANN201
    from tracegrid.plans.sqldag import build

    text = "SELECT (SELECT sum(value) FROM sales WHERE status = 'F' AND period = '1997') / (SELECT sum(value) FROM sales WHERE status = 'O' AND section = 'ASIA') AS v"
    return build(sales(spark, sf), "sales", text).root_rows()


@query()
def q65_sql_gate_verdicts(spark, sf):  # noqa: ANN001, ANN201
    from tracegrid.plans.sqlgate import CORPUS, problems

    table = sales(spark, sf)
    return spark.createDataFrame([(s, "; ".join(problems(table, "sales", s))) for s in CORPUS], "statement string, problems string")


@query()
def q66_sql_dag_nodes(spark, sf):  # noqa: ANN001, ANN201
    from tracegrid.plans.sqldag import build

    text = "WITH a AS (SELECT entity, sum(value) AS v FROM sales WHERE status = 'F' GROUP BY entity) SELECT avg(v) AS v FROM a WHERE v > (SELECT min(v) FROM a)"
    g = build(sales(spark, sf), "sales", text)
    return spark.createDataFrame([(n.id, n.kind, n.predicate, [str(i) for i in n.inputs], g.classify()) for n in g.nodes], "id int, kind string, predicate string, inputs array<string>, class string")
