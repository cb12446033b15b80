"""Training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; a row takes part by the hash of its id.
SAMPLE_ROWS = 20_000


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts)


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int = SAMPLE_ROWS, text_col: str = "text"
) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents for which ``usable`` holds."""
    chosen = (
        labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "label")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), texts["_doc"] == chosen["_id"]).select("text", "label")
