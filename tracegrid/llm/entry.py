"""The queries of the corpus operators: each runs its operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import ann, decontaminate, line_dedup, minhash, packing, quality, sharding, suffix_dedup, toxicity, warc
from tracegrid.llm.runtime import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op7_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_total", "lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op9_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_order_minhash,
        op2_warc_transactions,
        op3_simhash_decontamination,
        op4_suffix_dedup,
        op5_counterfactual_toxicity,
        op6_bestfit_packing,
        op7_pruned_graph_search,
        op8_line_dedup,
        op9_gam_quality,
        op10_minimax_sharding,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_transactions": warc.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL}
