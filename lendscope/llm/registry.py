"""Registered queries of the text operators, each over its whole table, and the DuckDB SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, dac, decontam, frames, jaccard, licenses, nskmeans, packing, pii, rules, snapshots, substring,
               toxicity)
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matched")


#: The conversation that the formatting query adds: both turns look like another template's control strings.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digest(chat.format_turns(turns.unionByName(probe)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Setting with the secret of the pseudonyms; the public default is for tests.
PII_KEY = "spark.lendscope.pseudonymKey"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"),
                            spark.conf.get(PII_KEY, pii.DEFAULT_KEY))


def op11_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nskmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.digests(frames.fill_in_middle(frames.store(table(spark, sf_dir, "documents"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.SQL, "op5_chat_formatting": chat.SQL, "op6_substring_dedup": substring.SQL,
            "op8_jaccard_join": jaccard.SQL, "op11_ns_bounds": nskmeans.sql(), "op12_fill_in_middle": frames.SQL,
            "op13_exact_dedup": snapshots.SQL}
