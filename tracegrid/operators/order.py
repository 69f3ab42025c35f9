"""Row numbers and neighbours along a long sequence, without sorting all of it in one task.

A sequence (the rows of a sheet, the cells of a column) is cut into blocks of ``BLOCK_ROWS`` row numbers. Work
inside a block is one window; what crosses blocks is a handful of values for each block, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 65_536


def block_of(place: str) -> Column:
    return F.floor(F.col(place) / F.lit(BLOCK_ROWS)).cast("long")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, whole: list[str] | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of ``order``, whose first column is a row number, within ``by``.

    With ``whole``, the groups follow each other in that order and are numbered through.
    """
    own = rows.withColumn("__block", block_of(order[0]))
    inner = own.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__block").orderBy(*order)))
    counts = own.groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each block of a sheet
    lead = Window.orderBy(*whole, "__block") if whole else Window.partitionBy(*by).orderBy("__block")
    before = F.coalesce(F.sum("__n").over(lead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(*by, "__block", before.alias("__before"))
    return inner.join(shift, [*by, "__block"]).withColumn(name, (F.col("__before") + F.col("__k") - 1).cast("long")).drop("__k", "__before", "__block")


def carried(rows: DataFrame, by: list[str], place: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` at or above each row within ``by``, in the order of ``place``."""
    own = rows.withColumn("__v", value).withColumn("__block", block_of(place))
    inside = Window.partitionBy(*by, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    inner = own.withColumn("__own", F.last("__v", ignorenulls=True).over(inside))
    ends = own.groupBy(*by, "__block").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(place))).alias("__end"))
    above = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__above", F.last("__end", ignorenulls=True).over(above)).drop("__end")
    return inner.join(ends, [*by, "__block"]).withColumn(name, F.coalesce("__own", "__above")).drop("__v", "__own", "__above", "__block")


def with_neighbours(rows: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """Adds ``before`` and ``after``, the values of the rows next to each, and its place ``k`` from the top and ``j`` from the end (from 1)."""
    own = rows.withColumn("__block", block_of(place))
    inside = Window.partitionBy(*by, "__block").orderBy(place)
    inner = own.withColumn("__b", F.lag(value).over(inside)).withColumn("__a", F.lead(value).over(inside)).withColumn("__k", F.row_number().over(inside))
    ends = own.groupBy(*by, "__block").agg(F.min_by(value, place).alias("__first"), F.max_by(value, place).alias("__last"), F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*by).orderBy("__block")
    ends = ends.select(
        *by, "__block", "__n", F.lag("__last").over(over).alias("__from"), F.lead("__first").over(over).alias("__to"),
        F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__all"),
    )
    out = inner.join(ends, [*by, "__block"]).withColumn("k", F.col("__before") + F.col("__k"))
    out = out.withColumn("before", F.when(F.col("__k") == 1, F.col("__from")).otherwise(F.col("__b"))).withColumn("after", F.when(F.col("__k") == F.col("__n"), F.col("__to")).otherwise(F.col("__a")))
    return out.withColumn("j", F.col("__all") - F.col("k") + 1).drop("__block", "__b", "__a", "__k", "__n", "__from", "__to", "__before", "__all")
