"""Queries of the operators of this folder over the whole tables of a data folder.

SQL expresses ranked search, repeated passages and hard negatives. It cannot express the others (hash
fingerprints, tokenizers, trained models, greedy maps), which have tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listweave.llm import (
    decontam,
    embeddings,
    hard_negatives,
    langid,
    lm_scoring,
    mixing,
    quality,
    ranked_search,
    repeats,
    sharding,
    simhash,
    sql,
    token_counts,
    tokens,
)
from listweave.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary of the public tokenizers, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=40)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=20
    )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_simhash,
        op2_token_output,
        op3_lm_scoring,
        op4_token_counts,
        op5_sharding,
        op6_language,
        op7_embeddings,
        op8_quality,
        op9_decontamination,
        op10_mixing,
        op11_ranked_search,
        op12_suffix_dedup,
        op13_hard_negatives,
    )
}
SQL: dict[str, str] = {
    "op11_ranked_search": sql.OP11,
    "op12_suffix_dedup": sql.OP12,
    "op13_hard_negatives": sql.OP13,
}
