"""Importance resampling towards a target, with a dictionary of distinct n-grams.

A feature is a word or two words in a row. Tasks turn blocks of texts into numbers for their words once; the stored
blocks keep these sequences. Each block sends every distinct feature of its own, with its count, to the feature's home,
as strings. There all blocks' strings meet in one dictionary, so each distinct string of the corpus is counted globally
and hashed once. The homes add up the hash buckets and answer each block with the buckets of its features, two bytes
each, so no string travels back. The totals of all buckets (as many as BUCKETS) give each bucket's gain,
floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for s of S features of the corpus and t of T of the target. The gains are
joined to the features of each document through its block's answers, and the floored mean is the document's weight.

A block has each feature once, so a frequent word costs its home one entry for each block and not one for each
occurrence. Documents with enough words compete by weight plus Gumbel noise, made from a hash of the identifier;
the draw is a global order by ranges, in which only the sizes of the ranges are added up.

Defined results: null or empty texts have no features and weight 0; a null identifier makes noise as an empty one and
goes first of equal scores; rows that repeat count each time; an empty corpus gives an empty result; an empty target
leaves all gains to the corpus; other columns don't matter; a very long text makes a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm.buckets import cut, hash_bucket, id_array, ids_of, partitions, rows_of
from gradeline.llm.shared import Tables, prepare, settings
from gradeline.llm.textops import SpanHash, column_bytes, lower_ascii, mixed, span_array, word_spans

BUCKETS = 10_000
#: Text bytes of a block; homes for each partition of an exchange.
BLOCK_BYTES, HOMES = 8 << 20, 2
#: Documents with fewer words are never drawn; percent of the others that are drawn; seed of the noise.
LEAST_WORDS, SHARE, SEED = 20, 25, 7
_HASH = SpanHash(13)
#: Bytes that are in no word: ASCII but for digits and letters.
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:128] = True
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = False
_STORED = "block long, target boolean, ids binary, sizes binary, words binary, letters binary, lengths binary"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short(data: bytes) -> bytes:
    """Compressed bytes behind their length, so that rows are small on disk and in shuffles, whatever Spark's codec is."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _long(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0 on as compressed bytes of the least width that holds them; the first byte is the width."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + _short(values.astype(f"<u{width}").tobytes())


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(_long(data[1:]), f"<u{data[0]}").astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        row = 0
        _, offsets = column_bytes(batch.column("text"))
        while row < batch.num_rows:
            room = offsets[row] + most - size
            end = min(max(int(np.searchsorted(offsets, room, side="right")) - 1, row + 1), batch.num_rows)
            held.append(batch.slice(row, end - row))
            size += int(offsets[end] - offsets[row])
            row = end
            if size >= most or row < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _stored(texts: DataFrame, target: bool, most: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of (doc_id, text): identifiers, words of each text, the words as numbers, and what the numbers mean."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        for number, block in enumerate(_blocks(batches, most)):
            data, offsets = column_bytes(block.column("text"))
            data = lower_ascii(data)
            starts, ends, first = word_spans(data, offsets, _OUTSIDE)
            coded = span_array(data, starts, ends).dictionary_encode()
            letters, bounds = column_bytes(coded.dictionary)
            row = {
                "block": (lane << 24 | number) << 1 | target, "target": target, "ids": ids_of(block.column("doc_id")).tobytes(), "sizes": _small(np.diff(first)),
                "words": _small(np.asarray(coded.indices)), "letters": _short(letters.tobytes()), "lengths": _small(np.diff(bounds)),
            }
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("target", pa.bool_()), *((n, pa.binary()) for n in ("ids", "sizes", "words", "letters", "lengths"))]))

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, _STORED)


class Block:
    """The features of a stored block: its distinct words and then its distinct pairs of words, and how they are dealt to homes."""

    def __init__(self, row: dict, homes: int):
        self.sizes, self.words, self.lengths = _large(row["sizes"]), _large(row["words"]), _large(row["lengths"])
        self.letters = np.frombuffer(_long(row["letters"]), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        n, self.v = len(self.words), len(self.lengths)
        self.paired = np.ones(n, bool)  # words with a next word in their text
        self.paired[self.first[1:][self.sizes > 0] - 1] = False
        at = np.flatnonzero(self.paired)
        self.pairs, self.pair, times = np.unique(self.words[at] * self.v + self.words[at + 1], return_inverse=True, return_counts=True)
        self.counts = np.concatenate([np.bincount(self.words, minlength=self.v), times])
        ends = np.cumsum(self.lengths)
        self.spans = ends - self.lengths, ends
        h = _HASH.words(self.letters, *self.spans)
        left, right = self.pairs // max(self.v, 1), self.pairs % max(self.v, 1)
        homes_of = np.concatenate([h, mixed(h[left] * np.uint64(_HASH.odd[0]) + h[right])])
        self.order, self.bounds = cut(hash_bucket(homes_of, homes), homes)

    def strings(self) -> pa.Array:
        """All features as strings, in the order in which they are dealt."""
        words = span_array(self.letters, *self.spans)
        pairs = pc.binary_join_element_wise(words.take(pa.array(self.pairs // max(self.v, 1))), words.take(pa.array(self.pairs % max(self.v, 1))), pa.scalar(b" ", pa.large_binary()))
        return pa.concat_arrays([words, pairs]).take(pa.array(self.order))

    def sums(self, buckets: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text's features, from the buckets of the dealt features."""
        gain = np.empty(len(self.order), np.int64)
        gain[self.order] = gains[buckets]
        each = gain[self.words]
        each[self.paired] += gain[self.v + self.pair]
        total = np.concatenate([[0], np.cumsum(each)])
        return total[self.first[1:]] - total[self.first[:-1]]


def _sent(stored: DataFrame, homes: int) -> DataFrame:
    """(home, block, target, letters, lengths, counts): the distinct features of each block, in the partition of their home."""
    names = ("letters", "lengths", "counts")
    schema = pa.schema([("home", pa.int32()), ("block", pa.int64()), ("target", pa.bool_()), *((n, pa.binary()) for n in names)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row, homes)
            letters, offsets = column_bytes(block.strings())
            counts, lengths = block.counts[block.order], np.diff(offsets)
            some = np.flatnonzero(np.diff(block.bounds))
            spans = [(block.bounds[h], block.bounds[h + 1]) for h in some]
            columns = [
                pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([row["target"]] * len(some), pa.bool_()),
                pa.array([_short(letters[offsets[a] : offsets[b]].tobytes()) for a, b in spans], pa.binary()),
                pa.array([_small(lengths[a:b]) for a, b in spans], pa.binary()), pa.array([_small(counts[a:b]) for a, b in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return stored.mapInArrow(send, "home int, block long, target boolean, letters binary, lengths binary, counts binary").repartitionById(homes, "home")


def _answered(sent: DataFrame, buckets: int) -> DataFrame:
    """Rows with a bucket and its counts (s, t), and rows with the buckets of a block's features of one home."""
    schema = pa.schema([("bucket", pa.int32()), ("s", pa.int64()), ("t", pa.int64()), ("block", pa.int64()), ("home", pa.int32()), ("answer", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows_of(batches))
        if not rows:
            return
        letters = b"".join(_long(r.pop("letters")) for r in rows)
        lengths = [_large(r.pop("lengths")) for r in rows]
        sizes = [len(x) for x in lengths]
        counts = np.concatenate([_large(r.pop("counts")) for r in rows])
        target = np.repeat([r["target"] for r in rows], sizes)
        ends = np.cumsum(np.concatenate(lengths))
        strings = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(letters)])
        coded = strings.dictionary_encode()
        which = np.asarray(coded.indices)
        distinct, bounds = column_bytes(coded.dictionary)
        view, bounds = memoryview(distinct), bounds.tolist()
        bucket = np.array([zlib.crc32(view[a:b]) % buckets for a, b in zip(bounds, bounds[1:], strict=False)], np.int64)
        of = bucket[which]
        total = [np.bincount(of, weights=np.where(side, counts, 0), minlength=buckets).astype(np.int64) for side in (~target, target)]
        some = np.flatnonzero(total[0] + total[1])
        none = lambda kind, n=len(some): pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some]), none(pa.int64()), none(pa.int32()), none(pa.binary())], schema=schema)
        at = np.concatenate([[0], np.cumsum(sizes)])
        back = [(i, r) for i, r in enumerate(rows) if not r["target"]]
        none = lambda kind: pa.nulls(len(back), kind)
        answers = pa.array([_small(of[at[i] : at[i + 1]]) for i, _ in back], pa.binary())
        yield pa.RecordBatch.from_arrays([none(pa.int32()), none(pa.int64()), none(pa.int64()), pa.array([r["block"] for _, r in back], pa.int64()), pa.array([r["home"] for _, r in back], pa.int32()), answers], schema=schema)

    return sent.mapInArrow(answer, "bucket int, s long, t long, block long, home int, answer binary")


def bucket_gains(answered: DataFrame, buckets: int) -> DataFrame:
    """(bucket, s, t, gain) of every bucket."""
    counts = answered.where("bucket is not null").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = answered.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("_all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("_all_t"))
    filled = every.join(counts, "bucket", "left").fillna(0, ["s", "t"]).crossJoin(F.broadcast(total))  # one row of totals
    real = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.log((real("t") + 1) * (real("_all_s") + buckets) / ((real("s") + 1) * (real("_all_t") + buckets))))
    return filled.select("bucket", "s", "t", gain.alias("gain"))


def _weighed(stored: DataFrame, answered: DataFrame, gains: np.ndarray, homes: int, parts: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document, where its block meets the answers."""
    names = ("ids", "sizes", "words", "letters", "lengths")
    blocks = stored.where("not target").select("block", F.lit(-1).alias("home"), *names, F.lit(None).cast("binary").alias("answer"))
    answers = answered.where("block is not null").select("block", "home", *[F.lit(None).cast("binary").alias(n) for n in names], "answer")
    met = blocks.unionByName(answers).repartition(parts, "block").sortWithinPartitions("block", "home")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def result(row: dict, answers: list[bytes]) -> pa.RecordBatch:
        block = Block(row, homes)
        buckets = np.concatenate([np.zeros(0, np.int64), *map(_large, answers)])
        n = block.sizes
        features = n + np.maximum(n - 1, 0)
        weight = block.sums(buckets, gains) // np.maximum(features, 1)
        return pa.RecordBatch.from_arrays([id_array(np.frombuffer(row["ids"], np.int64)), pa.array(n), pa.array(features), pa.array(weight)], schema=schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []
        for row in rows_of(batches):
            if row["home"] < 0:
                if held:
                    yield result(held, answers)
                held, answers = row, []
            else:
                answers.append(row["answer"])
        if held:
            yield result(held, answers)

    return met.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, parts: int, tables: Tables) -> DataFrame:
    """``rows`` with their rank (1, 2, ...) in a global order: sorted ranges are numbered inside, and only their sizes are added up."""
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = tables.keep(placed, "ranked")
    lane = F.shiftright("_place", 33)
    sizes = placed.groupBy(lane.alias("_lane")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_lane", (F.sum("_n").over(Window.orderBy("_lane")) - F.col("_n")).alias("_before"))
    joined = placed.withColumn("_lane", lane).join(F.broadcast(before), "_lane")
    return joined.withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_lane", "_before", "_place")


def importance_resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: ``share`` percent of those with enough words are drawn and have a rank.

    ``docs`` has doc_id and text, ``target`` has text.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark)
    parts = partitions(docs)
    homes = parts * HOMES
    with settings(spark, {_BATCH: "32"}):  # rows are large here
        corpus = _stored(docs.select("doc_id", "text"), False, block_bytes)
        stored = tables.keep(corpus.unionByName(_stored(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), True, block_bytes)), "resample-blocks")
        answered = tables.keep(_answered(_sent(stored, homes), buckets), "resample-answers")
        gains = np.zeros(buckets, np.int64)
        for bucket, gain in bucket_gains(answered, buckets).select("bucket", "gain").collect():
            gains[bucket] = gain
        weighed = _weighed(stored, answered, gains, homes, parts)
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
        noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
        scored = tables.keep(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")
    tables.drop(stored, answered)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    found = ranked(able, order, parts, tables).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return found.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
