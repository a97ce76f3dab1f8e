"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, chat, decontaminate, embedding_dedup, packing, quality, substring_trees, suffix_array, toxicity, url_filter
from .oracles import SQL
from .workspace import Workspace


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(_read(spark, sf_dir, "documents"), Workspace(spark, "op1")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(_read(spark, sf_dir, "embeddings"), Workspace(spark, "op2"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), Workspace(spark, "op3"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3, but each word of a window may stand one word off its place; n_hit counts places of windows' rarest words."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), Workspace(spark, "near"), slop=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), Workspace(spark, "op6"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_read(spark, sf_dir, "documents"), Workspace(spark, "op7"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), outcomes, Workspace(spark, "op8"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_trees.remove_repeats(_read(spark, sf_dir, "documents"), Workspace(spark, "op9")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.sql(f"select cast(-1 as bigint) conv_id, cast(t as bigint) turn, r role, '{probe}' text from values (0, 'user'), (1, 'assistant') as v(t, r)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.expand_targets(turns))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_embedding_near_dedup, op3_benchmark_decontamination, op4_toxicity, op5_quality_classifier, op6_best_fit_packing, op7_minhash_near_dedup, op8_url_filters, op9_substring_dedup, op10_chat_formatting, benchmark_proximity)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
