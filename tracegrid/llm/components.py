"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.runtime import hot_keys, materialised, salted_join

MAX_ROUNDS = 60


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows(u, v)`` with ``m``, the least v of each u; the rows of a node with very many are spread over tasks."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return salted_join(rows, least.drop("n"), ["u"], ["v"], hot_keys(least, ["u"], "n", n))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = _with_least(both, 2 * n).withColumn("m", F.least("u", "m"))
    return known.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    others = _with_least(down, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(down.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)`` with u <> v; the component is its least node."""
    current = materialised(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), name)
    n, seen = current.count(), None
    for _ in range(MAX_ROUNDS if n else 0):
        large = materialised(_large_star(current, n), name)
        current = materialised(_small_star(large, n), name)
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, n = mark, max(1, mark[0])
    else:
        if n:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
