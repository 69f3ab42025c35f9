"""Statistics and small functions whose names or values differ between engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(table: DataFrame, keys: list[str], column: str, digits: int = 6) -> DataFrame:
    """median, stddev, variance (sample), p90 (interpolated) and p50_disc (a value that occurs) for each group."""
    c = F.col(column)
    out = table.groupBy(*keys).agg(
        F.median(c).alias("median"), F.stddev(c).alias("stddev"), F.variance(c).alias("variance"), F.percentile(c, F.lit(0.9)).alias("p90"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)").alias("p50_disc"),
    )
    return out.select(*keys, *[F.round(x, digits).alias(x) for x in ("median", "stddev", "variance", "p90")], "p50_disc")


def median_absolute_deviation(table: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The median distance from the median, in two aggregations."""
    middle = table.groupBy(*keys).agg(F.median(column).alias("__m"))
    apart = F.abs(F.col(column) - F.col("__m"))
    return table.join(middle, keys).groupBy(*keys).agg(F.median(apart).alias("mad"))


def shape(table: DataFrame, keys: list[str], column: str, digits: int = 6) -> DataFrame:
    """skewness and excess kurtosis of a sample, corrected for its size; null below three or four values.

    Spark's own functions are those of a whole population.
    """
    n = F.col("n").cast("double")
    each = table.groupBy(*keys).agg(F.count(column).alias("n"), F.skewness(column).alias("s"), F.kurtosis(column).alias("k"))
    skew = F.when(n > 2, F.col("s") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    return each.select(*keys, F.round(skew, digits).alias("skewness"), F.round(kurt, digits).alias("kurtosis"))


def most_frequent(table: DataFrame, keys: list[str], column: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, the greatest of equally frequent ones; nulls do not count."""
    counts = table.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", column)).alias("x")).select(*keys, F.col(f"x.{column}").alias(name))


def formatted_number(c: Column) -> Column:
    """Two decimals with thousands separators, as answers print numbers."""
    return F.format_number(c, 2)
