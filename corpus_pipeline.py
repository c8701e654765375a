"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes all rows its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces.  Null texts are dropped by the quality rules (no words).  A null ``doc_id`` is an id like others, the smallest;
rows that repeat an id are judged each by its own text, and of exact copies, also of a whole row, one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import decontam, jaccard, packing, pii, registry, rules
from lendscope.llm.common import scratch, shared_dir, stored, table
from lendscope.llm.tokens import SMALL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the base rules or the learned decision list reject go."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of their own for each row, stored, and the name of that column.

    Stored, as a number must not change when a lost task is repeated; no column of the documents has that name.  The copy
    stays beside all tables of the operator, so its texts are compressed well."""
    name = "_row"
    while name in docs.columns:
        name = "_" + name
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows", compression="zstd"), name


def without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """Rows whose number is not in ``gone``: its keys are broadcast under a checked bound, else shuffled."""
    return rows.join(decontam.small(gone.select(row)), row, "left_anti").drop(row)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of linked documents the row with the smallest id (then row number) stays."""
    rows, row = numbered(docs)
    path = shared_dir(spark, "pipeline-copies")
    with scratch(spark):
        groups = stored(jaccard.jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text"))
                        .select(F.col("doc_id").alias(row), "component_id"), "pipeline-groups")
        # a group of one needs no look at its id
        shared = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
        members = groups.join(shared, "component_id").join(rows.select(row, "doc_id"), row)
        first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(f"first.{row}")
        gone = stored(members.select(row).join(first, row, "left_anti"), "pipeline-copies", path)
    return without(rows, gone, row).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: contaminated documents go."""
    rows, row = numbered(docs)
    path = shared_dir(spark, "pipeline-contaminated")
    with scratch(spark):
        judged = decontam.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        gone = stored(judged.where("contaminated").select(F.col("doc_id").alias(row)), "pipeline-contaminated", path)
    return without(rows, gone, row).select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: personal data becomes pseudonyms; ``n_chars`` follows the text."""
    out = pii.pseudonymize(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: best-fit packing of what is left; its workers keep small memos, as the executors' heap has grown by now."""
    return packing.pack(docs, registry.vocabulary("word_bpe_49k.json"), memos=SMALL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot learn rules or tokenize; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
