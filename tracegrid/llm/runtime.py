"""Session helpers shared by the corpus operators: materialised tables and table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SHARES = 200
HOT_ROWS = 200


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local session may go without the setting; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-tracegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The written table survives the loss of any executor, prunes columns and carries sizes that the
    planner can use.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough for rows that carry long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def text_key(text) -> list:
    """Two independent 64-bit hashes of a text: 128 bits that stand for it in joins and groups."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame | None:
    """``keys`` and ``salts`` of the keys that hold more than one part in ``SHARES`` of ``total`` rows; None without any.

    There are fewer than ``SHARES`` such keys, whatever the data, so they may be collected and broadcast.
    """
    if total <= HOT_ROWS:
        return None
    found = counts.filter(F.col(n) > max(total / SHARES, HOT_ROWS)).select(*keys, F.ceil(F.col(n) / F.lit(max(total / SHARES, HOT_ROWS))).cast("int").alias("salts"))
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], hot: DataFrame | None, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``rows`` joined with ``lookup``, unique on ``keys``; rows of hot keys are dealt over salts by the hash of ``spread``.

    With ``parts`` the result comes in that many partitions.
    """
    on = keys
    if hot is not None:
        rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        lookup = lookup.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        on = [*keys, "_salt"]
    if parts:
        rows = rows.repartition(parts, *on)
    return rows.join(lookup, on, how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
