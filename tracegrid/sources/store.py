"""Where tables that were made once are kept: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without it, and then gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-tracegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(spark: SparkSession, name: str, make) -> DataFrame:  # noqa: ANN001
    """The table that ``make()`` gives, written once by this application under ``name`` and read from there ever after."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])
