"""Packed exchanges: many small entries travel as a few binary rows for each task and partition.

A task turns texts into arrays of entries, merges those of one key as far as it can see, cuts them by
target partition and emits one row of packed columns for each. The rows go to the partition they
name (``repartitionById``), where one task sees the entries of its keys as arrays. As each task merges
first, a key of very many documents sends one entry for every few million entries of a task, not one
for each document. Partitions grow in number with the input, without a limit; where they are many,
entries take two hops of about the square root as many targets, so rows don't get small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Input bytes for each partition, where that asks for more than spark.sql.shuffle.partitions.
PARTITION_BYTES = 128 << 20
#: Estimates from here on mean that Spark does not know.
UNKNOWN_BYTES = 1 << 60
#: What a null id counts as; it sorts before all others.
NULL_ID = -(1 << 63)
#: Entries that a task gathers before it merges and sends them.
FLUSH = 1_000_000
#: Partitions from which on entries take two hops.
HOPS_FROM = 4096

Entries = dict[str, np.ndarray]


def partitions(df: DataFrame) -> int:
    """Number of partitions for exchanges of what ``df`` holds, by the sizes of the tables that it reads.

    Sizes that Spark doesn't know (as of local rows) don't count, and no join's estimate does.
    """
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(conf, sum(x for x in sizes if x < UNKNOWN_BYTES) // PARTITION_BYTES)


def with_part(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) with the partition that each row belongs to, by identifier and text."""
    return docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts).cast("long")).cast("int"))


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NULL_ID)).astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def hash_bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def cut(bucket: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (stable) and the bounds of each bucket in it."""
    small = bucket.astype(np.uint16) if parts <= 65_536 else bucket.astype(np.uint32)
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(parts + 1))


def packed(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of each 64-bit value; with a negative width the distinct values and small numbers for them."""
    values = np.ascontiguousarray(values).astype(np.int64).view(np.uint64) if values.dtype.kind == "i" else values.astype(np.uint64)
    if width < 0:
        distinct, number = np.unique(values, return_inverse=True)
        short = "<u2" if len(distinct) <= 1 << 16 else "<u4"
        return len(distinct).to_bytes(8, "little") + packed(distinct, -width) + number.astype(short).tobytes()
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes, width: int = 8) -> np.ndarray:
    if width < 0:
        n = int.from_bytes(data[:8], "little")
        end = 8 - n * width
        return unpacked(data[8:end], -width)[np.frombuffer(data[end:], "<u2" if n <= 1 << 16 else "<u4")]
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries; rows are few and large here."""
    for batch in batches:
        yield from batch.to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], widths: dict[str, int], most: int | None = None) -> Iterator[Entries]:
    """The entries of packed rows as whole columns: all at once, or about ``most`` of them at a time."""
    held: dict[str, list[np.ndarray]] = {n: [] for n in widths}
    seen = 0

    def taken() -> Entries:
        out = {n: np.concatenate(c) for n, c in held.items()}
        for c in held.values():
            c.clear()
        return out

    for r in rows_of(batches):
        for n, width in widths.items():
            held[n].append(unpacked(r[n], width))
        seen += len(held[n][-1])
        if most and seen >= most:
            yield taken()
            seen = 0
    if seen:
        yield taken()


def exchange(
    source: DataFrame,
    scan: Callable[[Iterator[pa.RecordBatch]], Iterator[Entries]],
    widths: dict[str, int],
    bucket: Callable[[Entries], np.ndarray],
    parts: int,
    hops_from: int | None = None,
) -> DataFrame:
    """(part, packed columns): what ``scan`` makes of ``source``, in the partitions that ``bucket`` names."""
    schema = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in widths)])
    sql = "part int, " + ", ".join(f"{n} binary" for n in widths)
    side = math.ceil(math.sqrt(parts))
    two_hops = parts > (HOPS_FROM if hops_from is None else hops_from)

    def emitted(entries: Entries, at: np.ndarray, targets: int) -> pa.RecordBatch:
        order, bounds = cut(at, targets)
        some = np.flatnonzero(np.diff(bounds))
        columns = [pa.array(some, pa.int32())]
        for n, width in widths.items():
            values = entries[n][order]
            columns.append(pa.array([packed(values[bounds[p] : bounds[p + 1]], width) for p in some], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        for number, entries in enumerate(scan(batches)):
            at = bucket(entries)
            if two_hops:
                yield emitted(entries, at // side * side + (lane + number) % side, side * side)
            else:
                yield emitted(entries, at, parts)

    def send_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in gathered(batches, widths, 2 * FLUSH):
            yield emitted(entries, bucket(entries), parts)

    sent = source.mapInArrow(send, sql)
    if two_hops:
        sent = sent.repartitionById(side * side, "part").mapInArrow(send_on, sql)
    return sent.repartitionById(parts, "part")


def stored(entries: Callable[[Iterator[pa.RecordBatch]], Iterator[Entries]], widths: dict[str, int]) -> tuple[Callable, str]:
    """A function for mapInArrow that packs what ``entries`` makes into one row each, and its SQL schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in entries(batches):
            yield pa.RecordBatch.from_arrays([pa.array([packed(e[n], w)], pa.binary()) for n, w in widths.items()], names=list(widths))

    return run, ", ".join(f"{n} binary" for n in widths)


def met(docs: DataFrame, packs: DataFrame, names: list[str], parts: int) -> DataFrame:
    """Texts (with their ``part``) and packed rows of the same part in one partition, the packed rows first."""
    texts = docs.select("part", F.lit(1).alias("kind"), "doc_id", "text", *[F.lit(None).cast("binary").alias(n) for n in names])
    other = packs.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *names)
    return texts.unionByName(other).repartitionById(parts, "part").sortWithinPartitions("kind")


def split_met(batches: Iterator[pa.RecordBatch], take: Callable[[dict], None]) -> Iterator[pa.RecordBatch]:
    """Hand packed rows to ``take`` and give the batches of texts."""
    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        first = int(np.searchsorted(kind, 1))
        if first:
            for r in batch.slice(0, first).to_pylist():
                take(r)
        if first < batch.num_rows:
            yield batch.slice(first).select(["part", "doc_id", "text"])
