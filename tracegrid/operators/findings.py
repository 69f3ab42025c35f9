"""Findings: leaderboards, trends, growth, shares and leaders, each with the cells it rests on, in one job each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.operators.execute import quoted


def leaderboard(base: DataFrame, entity: str, measure: str, n: int = 5) -> DataFrame:
    """rank, entity, value: the n entities with the greatest sums; names break ties. Null entities stay out."""
    top = base.filter(quoted(entity).isNotNull()).groupBy(quoted(entity).alias("entity")).agg(F.sum(quoted(measure)).alias("value"))
    best = top.orderBy(F.desc_nulls_last("value"), "entity").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("value"), "entity"))).select("rank", "entity", "value")


def leaderboard_cells(base: DataFrame, cell_map: DataFrame, entity: str, measure: str, n: int = 5) -> DataFrame:
    """rank, entity and each cell behind the entity's value, a row for each: one join of the leaders' rows with their receipts."""
    best = leaderboard(base, entity, measure, n).select("rank", "entity")
    rows = base.select(quoted(entity).alias("entity"), "__row_id").join(F.broadcast(best), "entity")  # n rows
    cells = cell_map.filter(F.col("column_name") == measure).select(F.col("row_id").alias("__row_id"), "sheet", "a1", "raw_value", "formula")
    return rows.join(cells, "__row_id").select("rank", "entity", "sheet", "a1", "raw_value", "formula")


def trend(base: DataFrame, period: str, measure: str) -> DataFrame:
    """period, value, change: the sum of each period in label order and its percent change on the one before."""
    each = base.filter(quoted(period).isNotNull()).groupBy(quoted(period).alias("period")).agg(F.sum(quoted(measure)).alias("value"))
    before = F.lag("value").over(Window.orderBy("period"))  # one row for each period
    return each.withColumn("change", F.try_divide(F.col("value") - before, before) * 100)


def trend_summary(base: DataFrame, period: str, measure: str) -> DataFrame:
    """First and last period, their values, the percent change and whether it has risen; none below three periods."""
    each = trend(base, period, measure)
    ends = each.agg(
        F.count(F.lit(1)).alias("periods"), F.min("period").alias("first"), F.max("period").alias("last"),
        F.min_by("value", "period").alias("first_value"), F.max_by("value", "period").alias("last_value"),
    )
    pct = F.try_divide(F.col("last_value") - F.col("first_value"), "first_value") * 100
    return ends.filter("periods >= 3").withColumn("pct", pct).withColumn("risen", F.coalesce(F.col("pct") > 0, F.lit(False)))


def entity_growth(base: DataFrame, entity: str, period: str, measure: str, first: str, last: str) -> DataFrame:
    """entity, first, last, pct between two periods, from conditional sums over one scan."""
    at = lambda p: F.sum(F.when(quoted(period) == p, quoted(measure)))
    each = base.filter(quoted(period).isin(first, last)).groupBy(quoted(entity).alias("entity")).agg(at(first).alias("first"), at(last).alias("last"))
    return each.withColumn("pct", F.try_divide(F.col("last") - F.col("first"), "first") * 100)


def leader_share(base: DataFrame, entity: str, period: str, measure: str) -> DataFrame:
    """The leading entity of the latest period and its share of the whole."""
    latest = base.agg(F.max(quoted(period)).alias("__latest"))
    own = base.join(F.broadcast(latest), quoted(period) == F.col("__latest"))  # one row
    each = own.groupBy(quoted(entity).alias("entity"), "__latest").agg(F.sum(quoted(measure)).alias("value"))
    whole = each.groupBy("__latest").agg(F.sum("value").alias("total"), F.max_by("entity", F.struct("value", "entity")).alias("entity"), F.max("value").alias("value"))
    return whole.select("entity", F.col("__latest").alias("period"), "value", "total", (F.try_divide("value", "total") * 100).alias("share"))


def measure_leaders(table: DataFrame, entity: str, measures: list[str]) -> DataFrame:
    """measure, entity, value: the row with the greatest value of each measure, in one aggregation."""
    key = lambda m: F.struct(quoted(m).cast("double").alias("value"), quoted(entity).alias("entity"))
    best = table.agg(*[F.max(F.when(quoted(m).isNotNull(), key(m))).alias(f"m{i}") for i, m in enumerate(measures)])
    rows = [F.struct(F.lit(m).alias("measure"), F.col(f"m{i}.entity").alias("entity"), F.col(f"m{i}.value").alias("value")) for i, m in enumerate(measures)]
    return best.select(F.inline(F.array(*rows)))


def entity_count(base: DataFrame, entity: str) -> DataFrame:
    return base.agg(F.count(quoted(entity)).alias("n"))
