"""A worksheet-like view of the star schema: orders by nation, region, year and status, with cell addresses.

One sheet for each order status and one, ``ALL``, for their sum. Regions are sections: a header row, one row
for each nation, a subtotal row. Years are columns from B on. The overlap of ``ALL`` with the other sheets is
the trap that default filters exist for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.operators.ingest import dense_row_ids
from tracegrid.operators.lineage import column_letter
from tracegrid.plans.catalog import Catalog, Column
from tracegrid.plans.spec import SheetSpec, Spec, letters_of
from tracegrid.sources.cells import cells_from
from tracegrid.sources.store import stored

FIRST_ROW = 8
HEADER_ROW = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, section, period, status, value; money is added up exactly, as decimals."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # nation and region are of fixed size, so the planner broadcasts them; orders move once, by customer
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = [F.col("n_name").alias("entity"), F.col("r_name").alias("section"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderstatus").alias("status")]
    return joined.groupBy(*keys).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def places_of(nation: DataFrame, region: DataFrame) -> DataFrame:
    """entity, section and the row of each nation; both tables are of fixed size, so their ranks need no partitioning."""
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("section"))
    placed = places.withColumn("k", F.row_number().over(Window.orderBy("section", "entity"))).withColumn("s", F.dense_rank().over(Window.orderBy("section")))
    return placed.select("entity", "section", (F.lit(FIRST_ROW) + F.col("k") + 2 * (F.col("s") - 1)).alias("r"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidy table, ingested once and asked many times, as any workbook is."""
    return stored(spark, f"sales of {sf_dir}", lambda: ingested_sales(spark, sf_dir))


def ingested_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidy table with ``__row_id``, ``row_kind`` and the address of each value cell."""
    facts = sales_facts(spark, sf_dir)
    total = facts.groupBy("entity", "section", "period").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    both = facts.unionByName(total.withColumn("status", F.lit("ALL")))
    placed = places_of(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"))
    heads = placed.groupBy("section").agg((F.min("r") - 1).alias("header_r"))
    periods = read(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("period")).distinct()
    columns = periods.withColumn("c", F.row_number().over(Window.orderBy("period")) + 1)
    whole = both.join(placed, ["entity", "section"]).join(heads, "section").join(F.broadcast(columns), "period")
    whole = whole.withColumn("row_kind", F.lit("entity")).withColumn("sheet", F.col("status"))
    out = dense_row_ids(whole, ["sheet"], ["r", "c"])
    return out.withColumn("a1", F.concat(column_letter(F.col("c")), F.col("r").cast("string"))).select(
        "__row_id", "entity", "section", "period", "status", "value", "row_kind", "sheet", "r", "c", "header_r", "a1"
    )


def sales_receipts(tidy: DataFrame) -> DataFrame:
    """row_id, column_name, sheet, a1, raw_value, formula: a receipt for each value, label and constant."""
    letter = column_letter(F.col("c"))
    cell = lambda name, a1, raw: F.struct(F.lit(name).alias("column_name"), a1.alias("a1"), raw.alias("raw_value"))
    at = lambda r: F.concat(F.lit("A"), r.cast("string"))
    cells = F.array(
        cell("value", F.col("a1"), F.col("value").cast("decimal(18,2)").cast("string")),
        cell("entity", at(F.col("r")), F.col("entity")),
        cell("section", at(F.col("header_r")), F.col("section")),
        cell("period", F.concat(letter, F.lit(str(HEADER_ROW))), F.col("period")),
        cell("status", F.lit("A1"), F.col("status")),
        cell("row_kind", at(F.col("r")), F.col("entity")),
    )
    return tidy.select(F.col("__row_id").alias("row_id"), "sheet", F.explode(cells).alias("x")).select(
        "row_id", "x.column_name", "sheet", "x.a1", "x.raw_value", F.lit(None).cast("string").alias("formula")
    )


SHEETS = ("ALL", "F", "O", "P")
KINDS = {"subtotal": r"^Region\ Total$", "section_header": r"^REGION\ \-\ "}
NOTES = {3: "Orders by nation and year", 4: "Figures in currency [1]"}


def sales_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the sales sheets, as a reader gives them, kept as a file would keep them."""
    return stored(spark, f"sales cells of {sf_dir}", lambda: written_cells(spark, sf_dir))


def written_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets that the sales table would be read from: titles, notes, stacked headers, sections, values and subtotals."""
    tidy = sales(spark, sf_dir)
    one = lambda r, c, num, text: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), num.cast("double").alias("num"), text.alias("text"))
    none, at = F.lit(None), F.lit(1)
    money = lambda v: v.cast("decimal(18,2)").cast("string")
    values = tidy.select("sheet", one(F.col("r"), F.col("c"), F.col("value"), money(F.col("value"))).alias("x"))
    headers = tidy.select("sheet", "c", "period").distinct().select("sheet", F.explode(F.array(one(F.lit(HEADER_ROW - 1), F.col("c"), none, F.lit(" Year  ")), one(F.lit(HEADER_ROW), F.col("c"), none, F.col("period")))).alias("x"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    placed = places_of(nation, region)
    ends = placed.groupBy("section").agg((F.min("r") - 1).alias("head"), (F.max("r") + 1).alias("foot"))
    names = spark.createDataFrame([(s,) for s in SHEETS], "sheet string")
    labels = placed.select(one(F.col("r"), at, none, F.concat("entity", F.lit(" [1]"))).alias("x"))
    labels = labels.unionByName(ends.select(F.explode(F.array(one(F.col("head"), at, none, F.concat(F.lit("REGION - "), "section")), one(F.col("foot"), at, none, F.lit("Region Total*")))).alias("x")))
    labels = labels.crossJoin(F.broadcast(names))  # four sheets
    sums = tidy.groupBy("sheet", "section", "c").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v")).join(ends, "section")
    subtotals = sums.select("sheet", one(F.col("foot"), F.col("c"), F.col("v"), money(F.col("v"))).alias("x"))
    notes = names.select("sheet", F.explode(F.array(one(F.lit(1), at, none, F.concat(F.lit("Status "), "sheet")), *[one(F.lit(r), at, none, F.lit(t)) for r, t in NOTES.items()])).alias("x"))
    whole = values.unionByName(headers).unionByName(labels.select("sheet", "x")).unionByName(subtotals).unionByName(notes)
    return cells_from(whole.select("sheet", "x.*"), "sales.xlsx", list(SHEETS))


def sales_spec(spark: SparkSession, sf_dir: str) -> Spec:
    """How ``sales_cells`` are to be read."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    last = places_of(nation, region).agg(F.max("r") + 1).first()[0]  # one row
    wide = read(spark, sf_dir, "orders").select(F.year("o_orderdate")).distinct().count()
    columns = [letters_of(c) for c in range(2, wide + 2)]
    sheets = [SheetSpec(s, [HEADER_ROW - 1, HEADER_ROW], FIRST_ROW, last, columns, "A", [], list(NOTES), KINDS, {"status": s}) for s in SHEETS]
    return Spec("sales.xlsx", "sales", "crosstab", "entity", "value", "period", sheets, "section", "currency", {"status": "ALL"})


def sales_catalog() -> Catalog:
    text = lambda n, **k: Column(n, "string", **k)
    columns = [text("entity"), text("section"), text("period", scope=True), text("status"), Column("value", "double", unit="currency"), text("row_kind")]
    return Catalog("sales", columns, "value", "currency", file_defaults={"status": "ALL"})


#: The same tables for DuckDB, as common table expressions.
SALES_SQL = """
facts AS (
  SELECT n_name AS entity, r_name AS section, CAST(year(o_orderdate) AS VARCHAR) AS period, o_orderstatus AS status,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
both_ AS (
  SELECT entity, section, period, status, value FROM facts UNION ALL
  SELECT entity, section, period, 'ALL', CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM facts GROUP BY ALL),
placed AS (
  SELECT n_name AS entity, r_name AS section,
         8 + row_number() OVER (ORDER BY r_name, n_name) + 2 * (dense_rank() OVER (ORDER BY r_name) - 1) AS r
  FROM nation JOIN region ON n_regionkey = r_regionkey),
heads AS (SELECT section, min(r) - 1 AS header_r FROM placed GROUP BY section),
cols AS (SELECT period, row_number() OVER (ORDER BY period) + 1 AS c FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS period FROM orders)),
sales AS (
  SELECT row_number() OVER (ORDER BY status, r, c) - 1 AS __row_id, b.entity, b.section, b.period, status, value, 'entity' AS row_kind,
         status AS sheet, r, c, header_r, chr((64 + c)::INT) || r AS a1
  FROM both_ b JOIN placed p ON p.entity = b.entity AND p.section = b.section JOIN heads h ON h.section = b.section
  JOIN cols k ON k.period = b.period),
cell_map AS (
  SELECT __row_id AS row_id, 'value' AS column_name, sheet, a1, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS raw_value FROM sales UNION ALL
  SELECT __row_id, 'entity', sheet, 'A' || r, entity FROM sales UNION ALL
  SELECT __row_id, 'section', sheet, 'A' || header_r, section FROM sales UNION ALL
  SELECT __row_id, 'period', sheet, chr((64 + c)::INT) || '7', period FROM sales UNION ALL
  SELECT __row_id, 'status', sheet, 'A1', status FROM sales UNION ALL
  SELECT __row_id, 'row_kind', sheet, 'A' || r, entity FROM sales)
"""
