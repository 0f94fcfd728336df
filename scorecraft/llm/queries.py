"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import (decontamination, hard_negatives, jaccard_join, langid, line_dedup, merge_dropout, oracles,
                            quality_rules, sharding, site_quality, spelling, storage, substring_dedup, token_counts,
                            toxicity)

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    state = token_counts.build(docs.withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.col("text"))))
    before = state.withColumn("n_tokens_before", F.col("n_tokens"))
    return token_counts.update(before).select(
        "doc_id", "n_tokens_before", "n_tokens", F.element_at("tree_chars", 2).alias("n_chars"), "n_encoded_chars",
        F.size("edits").alias("n_edits"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.settled(lambda: site_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return storage.settled(lambda: decontamination.digest(decontamination.find(docs, benchmark)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.settled(lambda: jaccard_join.link(_table(spark, sf_dir, "documents")))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, toxicity.with_low_quality(_table(spark, sf_dir, "labels")), ["low_quality", "toxic"])
    return toxicity.predict(docs, chain)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.assign(docs, "doc_id", SHARDS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.settled(lambda: substring_dedup.digest(substring_dedup.remove(_table(spark, sf_dir, "documents"))))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(_table(spark, sf_dir, "embeddings"), moved)
    return storage.settled(lambda: hard_negatives.mine(rows, F.col("id") % 100 == 0))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.settled(lambda: line_dedup.digest(line_dedup.dedup(_table(spark, sf_dir, "documents"))))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.settled(lambda: spelling.group(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_quality_rules, op3_token_counts, op4_quality_classifier,
        op5_benchmark_decontamination, op6_jaccard_join, op7_merge_dropout, op8_toxicity, op9_sharding, op10_substring_dedup,
        op11_hard_negatives, op12_line_dedup, op13_spelling_groups)}


def oracle_sql() -> dict[str, str]:
    return {"op5_benchmark_decontamination": oracles.OP5, "op6_jaccard_join": oracles.OP6,
            "op11_hard_negatives": oracles.OP11, "op12_line_dedup": oracles.OP12}
