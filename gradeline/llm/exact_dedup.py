"""Exact deduplication by a stateful stream with disk-backed keyed state.

Every row is landed once: its text, digest, stable identifier and a locator, which stays with the row
from then on. A Structured Streaming query reads the narrow columns of the landing files; its RocksDB
state keeps, for each digest and without expiry, the smallest identifier with its locator and the
number of rows, so that later landings could be added to the same state. Digests that several rows
have are checked on full bytes: only their texts are taken from the landing table (where they are
few by broadcast, else by shuffle behind a Bloom filter of 8 bits or more for each hit), copies collapse in each task, and
if different texts ever share a digest, these rows are grouped again by their whole text. The state has as many partitions
as the landing table's size asks for, so a store stays about as large as 128 MB of input make it.

Only DataFrame operations run on the executors. Defined results: a null text counts as empty,
empty texts are equal to each other, null identifiers come first, of rows that repeat both
identifier and text one (by locator, the first in the input's order) stays with all its columns,
other columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.buckets import partitions
from gradeline.llm.shared import TIDY, free_name, join_by_key, new_dir, settings, write, written

_WHITE = r"[\x20\x09-\x0D]+"
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store is open only while its task runs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated logs
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
}

#: Least hits that a Bloom filter is made for, and its bits for each.
_LEAST_HITS, _BITS = 4_000_000, 8


def _bloom(hits: int) -> dict[str, str]:
    """Settings for a Bloom filter of so many hits, which keeps other texts from the shuffle. It takes a byte for each hit in each task that makes it."""
    items = max(hits, _LEAST_HITS)
    bits = 1 << (items * _BITS - 1).bit_length()
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    values = {
        "enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "64g", "expectedNumItems": items, "maxNumItems": items, "numBits": bits, "maxNumBits": bits,
    }
    return {prefix + k: str(v) for k, v in values.items()}


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")


def sha256(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex."""
    return F.sha2(text.cast("binary"), 256)


def _stream_state(spark: SparkSession, landing: str, schema, name: dict[str, str], files_per_batch: int, parts: int) -> DataFrame:
    """Run the stream over all landing files, its state in so many partitions, and return the newest state row of each digest."""
    out, progress = new_dir(spark, "dedup-state"), new_dir(spark, "dedup-progress")

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, _ROCKSDB | TIDY | {"spark.sql.shuffle.partitions": str(parts)}):
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
        landed = landed.select(*(F.col(name[c]).alias(c) for c in ("digest", "row_id", "locator")))
        state = landed.groupBy("digest").agg(
            F.min(F.struct("row_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size")
        )
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(emit)
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        batches = {p["batchId"] for p in query.recentProgress if p["numInputRows"]}
    if not batches:
        return spark.createDataFrame(
            [], "digest string, first struct<row_id: bigint, locator: bigint>, group_size bigint"
        )
    rows = spark.read.parquet(out)
    if len(batches) > 1:  # an updated digest appears once for each batch that touched it
        newest = F.max_by(F.struct("first", "group_size"), "batch")
        rows = rows.groupBy("digest").agg(newest.alias("s")).select("digest", "s.first", "s.group_size")
    return rows.select("digest", "first", "group_size")


#: Columns of a landing table besides those of the input.
_OWN = ("row_id", "digest", "text_sha256", "locator", "body")


def _landed(docs: DataFrame, id_col: str, text_col: str, digest, whole: bool) -> tuple[DataFrame, dict[str, str], str]:
    """The landing table, with the input's columns if ``whole``; the names of its own columns; its folder."""
    spark = docs.sparkSession
    text = normalised(F.col(text_col))
    name = {c: free_name(docs, f"_{c}") for c in _OWN}
    landed = docs.select(
        *([F.col(f"`{c}`") for c in docs.columns] if whole else []),
        F.col(id_col).cast("long").alias(name["row_id"]), digest(text).alias(name["digest"]), sha256(text).alias(name["text_sha256"]),
        F.monotonically_increasing_id().alias(name["locator"]), text.alias(name["body"]),
    )
    if digest is sha256:  # stored once
        landed = landed.drop(name["text_sha256"])
        name["text_sha256"] = name["digest"]
    if whole:  # the text is there already
        landed = landed.drop(name["body"])
    path = new_dir(spark, "dedup-landing")
    write(landed, path)
    return spark.read.schema(landed.schema).parquet(path), name, path


def _resolved(landing: DataFrame, name: dict[str, str], path: str, body: Column, files_per_batch: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator of every row of a landing table."""
    spark = landing.sparkSession
    rows = landing.select(*(F.col(name[c]).alias(c) for c in _OWN[:4]))
    state = _stream_state(spark, path, landing.schema, name, files_per_batch, partitions(landing))

    # Full bytes: a digest that stands for two texts shows up twice. Copies collapse before the shuffle.
    hits = written(state.where("group_size > 1").select("digest", "group_size"), "dedup-hits")
    count = hits.count()
    hits = hits.where("group_size > 1")  # Spark makes a Bloom filter only of what a filter has chosen
    texts = landing.select(F.col(name["digest"]).alias("digest"), body.alias("norm"))
    mixed = texts.join(hits, "digest", "left_semi").distinct().groupBy("digest").count().where("count > 1").select("digest")
    with settings(spark, _bloom(count)):
        mixed = written(mixed, "dedup-mixed")

    result = join_by_key(rows, state.select("digest", "first", "group_size"), "digest", state.select("digest", "group_size"), rows.count())
    own = F.col("row_id").eqNullSafe(F.col("first.row_id")) & (F.col("locator") == F.col("first.locator"))
    result = result.select("digest", "row_id", "locator", "text_sha256", F.col("first.row_id").alias("keep_id"), own.alias("kept"), "group_size")
    found = result.select("digest", F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256", "locator")
    if not mixed.isEmpty():
        rows = landing.select(*(F.col(name[c]).alias(c) for c in _OWN[:4]), body.alias("norm")).join(mixed, "digest", "left_semi")
        groups = rows.groupBy("digest", "norm").agg(F.min(F.struct("row_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        again = rows.join(groups, ["digest", "norm"]).select(
            "digest", F.col("row_id").alias("doc_id"), F.col("first.row_id").alias("keep_id"), "group_size", own.alias("kept"), "text_sha256", "locator"
        )
        found = found.join(mixed, "digest", "left_anti").unionByName(again)
    return found.drop("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps a normalised text to the state key; tests pass a weak one to force hits
    between different texts.
    """
    landing, name, path = _landed(docs, id_col, text_col, digest, False)
    return _resolved(landing, name, path, F.col(name["body"]), files_per_batch).drop("locator")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    landing, name, path = _landed(docs, id_col, text_col, digest, True)
    found = _resolved(landing, name, path, normalised(F.col(text_col)), files_per_batch)
    gone = written(found.where("not kept").select(F.col("locator").alias(name["locator"])), "dedup-gone")
    return landing.join(gone, name["locator"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
