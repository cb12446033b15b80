"""Line deduplication over levelled, sorted runs of line hashes.

Each text is cut into lines, and each line has a key: without white space at both ends, A-Z in lower case. Keys of at
least LEAST_LENGTH characters count. An index holds each such key's hash (128 bits of MD5) once, with the document that
keeps the line. It consists of runs, tables that are bucketed and sorted by the hash. A batch of new documents joins
its distinct keys against the runs by an anti-join of sorted buckets, so runs are merged with the batch and never moved
or sorted again; what is new becomes a run of level 0. Once FAN_IN runs share a level they are compacted to one run of
the next level, so a key is rewritten once for each level, and a batch meets a few runs a level.

``dedup_lines`` deals a table into batches of rising identifiers, so the first batch with a key also has its smallest
document. It then marks the lines whose key another document keeps: lines of very frequent keys by a broadcast of these
keys (fewer than 1000 can each have a thousandth of all lines), all others by a shuffle of hashes and line numbers.

Only DataFrame operations run on the executors. Defined results: a null or empty text is one empty line, null
identifiers are one document before all others, rows that share an identifier are one document, an empty table gives an
empty result, other columns don't matter; very long texts are rows like others, and their lines spread over all tasks.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.buckets import NULL_ID, partitions
from gradeline.llm.shared import TIDY, Tables, delete, join_by_key, new_dir, settings

LEAST_LENGTH = 10
#: Batches that a whole table is dealt into, and runs of a level that are compacted to one.
BATCHES, FAN_IN = 8, 4
_ENDS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_ENDS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


class LineIndex:
    """Keys and who keeps them, as sorted runs on levels below one shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = FAN_IN):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.path = new_dir(spark, "line-runs")
        self.levels: list[list[str]] = []
        # Buckets have one file each, so their order can be relied on and the runs are merged as they lie.
        self.conf = TIDY | {
            "spark.sql.shuffle.partitions": str(buckets),
            "spark.sql.sources.bucketing.maxBuckets": str(max(buckets, 100_000)),
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        }

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        target = rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key")
        target.option("compression", "zstd").option("path", f"{self.path}/{level}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str, level: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.path}/{level}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (key, first) that no run has."""
        return reduce(lambda left, run: left.join(run.select("key").hint("merge"), "key", "left_anti"), self.runs(), keys)

    def add(self, lines: DataFrame) -> None:
        """Add the new keys of a batch's ``lines`` (key, id), which its smallest document keeps; full levels are compacted."""
        with settings(self.spark, self.conf):
            self._write(self.fresh(lines.groupBy("key").agg(F.min("id").alias("first"))), 0)
            level = 0
            while len(self.levels[level]) >= self.fan_in:
                full, self.levels[level] = self.levels[level], []
                self._write(reduce(DataFrame.unionByName, map(self.spark.table, full)).repartition(self.buckets, "key"), level + 1)
                for name in full:
                    self._drop(name, level)
                level += 1

    def owners(self) -> DataFrame:
        """(key, first) of all keys."""
        return reduce(DataFrame.unionByName, self.runs())

    def close(self) -> None:
        for level, names in enumerate(self.levels):
            for name in names:
                self._drop(name, level)
        self.levels = []
        delete(self.spark, self.path)


def _batch(docs: DataFrame, batches: int) -> Column:
    """The batch of each row: identifiers are cut at approximate quantiles, so later batches have larger ones."""
    found = docs.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    return reduce(lambda n, cut: n + (F.col("id") > cut).cast("int"), sorted(set(found or [])), F.lit(0))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each text without the lines that a document with a smaller identifier has."""
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # A row is known by its identifier and text again; rows that repeat both have the same result.
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("print"), F.split("text", "\n").alias("lines"))
    each = rows.select("id", "print", F.posexplode("lines").alias("at", "line")).select("id", "print", "at", line_key(F.col("line")).alias("key"))
    each = each.where(F.char_length("key") >= LEAST_LENGTH).withColumn("key", F.unhex(F.md5("key")))
    lines = tables.keep(each.withColumn("batch", _batch(rows.select("id"), batches)), "lines")
    index = LineIndex(spark, partitions(docs), fan_in)
    for number in range(batches):
        index.add(lines.where(F.col("batch") == number))
    sizes = lines.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"))
    with settings(spark, index.conf):
        marked = join_by_key(lines, index.owners(), "key", sizes, lines.count()).where("id <> first")
        lost = tables.keep(marked.groupBy("id", "print").agg(F.collect_set("at").alias("lost")), "lines-lost")
    index.close()
    tables.drop(lines)
    found = rows.join(lost, ["id", "print"], "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    return found.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n").alias("kept"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
    k AS (
        SELECT doc_id, line, place, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ),
    o AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.first < doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE o.first IS NULL OR o.first = doc_id), '')) AS kept_sha256
    FROM k LEFT JOIN o USING (key) GROUP BY doc_id
"""
