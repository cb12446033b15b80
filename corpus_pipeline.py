"""The training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it as the next
stage's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeline.llm.decontaminate import drop_leaks
from gradeline.llm.exact_dedup import drop_exact_copies
from gradeline.llm.jaccard_join import keep_one_of_each
from gradeline.llm.quality import keep_good, train_quality
from gradeline.llm.sentencepiece_bpe import encode_decode
from gradeline.llm.shared import Tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it is fitted on labelled rows of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train_quality(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each text."""
    return drop_exact_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of similar ones."""
    return keep_one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each document."""
    return encode_decode(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", tokenize_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.

    Defined results: null and empty texts are equal to each other, so the one with the smallest id stays if the
    quality model accepts it, and it has no tokens; null ids come first, stay apart in the Jaccard join and come
    back null; rows that repeat id and text leave one row; other columns pass through to the last stage; an empty
    table gives an empty result, without labels every document scores 0.5 and stays.
    """
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, edit distances and merge rounds can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None
