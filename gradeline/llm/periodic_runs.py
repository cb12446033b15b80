"""Runs of repeated words, by Lyndon arrays after Ellert and Fischer.

A run is a longest stretch of words with some smallest period. The words of a text become numbers that are
equal for equal words only, and any order of these numbers will do. For that order and for its reverse, one
pass from left to right finds for each place the next place with a smaller suffix (the Lyndon array) and how
far the two suffixes agree. A comparison never reads again what an earlier one has matched: inside of the
stretch that reaches furthest to the right the answer is copied from its first half, or the comparison goes
on at the end of the stretch, and along a chain of compared places the shorter of two agreements is the
answer. So all comparisons together read each word a few times at most, however periodic the text is, and
neither suffix arrays nor trees nor fingerprints are made. Each run shows as a place whose next smaller
suffix is one period away; from the first such place of a run, less than a period is left to its start.

Texts are independent of each other, so Spark deals them to its tasks and nothing is shuffled. A text of n
words needs some 100 bytes for each of them while it is worked on.

Defined results: a null or empty text has no words and no run; null identifiers and repeated rows are
rows like others; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.shared import prepare
from gradeline.llm.textops import blocks, column_bytes, span_array, word_spans

#: Runs have this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_WHITE = r"[\x20\x09-\x0D]+"
_SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def smaller_suffixes(words: list[int]) -> tuple[list[int], array]:
    """For each place, the next place with a smaller suffix (the end if there is none), and how many words both have in common.

    ``words`` are numbers from 0 on; a suffix that ends is smaller than one that goes on.
    """
    n = len(words)
    w = [*words, -1]  # the end; as w[-1], it also ends the walk to the left
    after, before = [n] * n, [-1] * n
    after_same, before_same = array("i", bytes(4 * n)), array("i", bytes(4 * n))
    reach = shift = start = 0  # w[start:reach] equals the stretch that begins shift words earlier
    for r in range(1, n):
        c, x, popped, had = w[r], r - 1, -1, 0
        while True:
            a = w[x]
            if a > c:
                after[x] = r
                popped, had, x = x, 0, before[x]
                continue
            if a < c:
                before[r] = x
                break
            # x is before[popped], so both suffixes have been compared with that of popped.
            known, same = 0, -1
            if popped >= 0:
                known = had
                if known != before_same[popped]:
                    same = min(known, before_same[popped])
            if same < 0 and r + known < reach:
                known = reach - r
                if x >= start:
                    i, j = x - shift, r - shift
                    copied = after_same[i] if after[i] == j else before_same[j] if before[j] == i else known
                    if copied < known:
                        same = copied
            if same < 0:
                i, j = x + known, r + known
                while w[i] == w[j]:
                    i += 1
                    j += 1
                same = j - r
                if j > reach:
                    reach, shift, start = j, r - x, r
            if w[x + same] < w[r + same]:
                before[r], before_same[r] = x, same
                break
            after[x], after_same[x] = r, same
            popped, had, x = x, same, before[x]
    return after, after_same


def runs_of(words: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of all runs of at least ``least`` words and ``periods`` (two or more) periods, in this order."""
    n, found = len(words), set()
    if n < least:
        return np.zeros((0, 3), np.int64)
    place = np.arange(n)
    for order in (words, words.max() - words):
        after, same = smaller_suffixes(order.tolist())
        same = np.frombuffer(same, np.int32).astype(np.int64)
        period = np.asarray(after) - place
        # The run starts less than a period before its first such place.
        long = np.flatnonzero((same > 0) & (same + 2 * period - 1 >= np.maximum(least, periods * period)))
        ends = long + period[long] + same[long]
        _, first = np.unique(ends * (n + 1) + period[long], return_index=True)
        for x, end, p in zip(long[first].tolist(), ends[first].tolist(), period[long][first].tolist(), strict=True):
            while x and words[x - 1] == words[x - 1 + p]:
                x -= 1
            if end - x >= max(least, periods * p):
                found.add((x, end - x, p))
    return np.array(sorted((x, p, size) for x, size, p in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): all runs of a text by start and period, and its words without the repeats, joined by one space.

    Words are what white space separates, numbered from 0. A repeat is what a run holds after its first period.
    """
    prepare(docs.sparkSession)

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = column_bytes(block.column("text"))
            starts, ends, first = word_spans(data, offsets)
            words = np.asarray(span_array(data, starts, ends).dictionary_encode().indices).astype(np.int64)
            raw, runs, texts = data.tobytes(), [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                found = runs_of(words[a:b], least, periods)
                kept = np.ones(b - a, bool)
                for start, size, period in found.tolist():
                    kept[start + period : start + size] = False
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                at = np.flatnonzero(kept) + a
                texts.append(b" ".join([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(collapsed, f"doc_id long, runs {_SCHEMA}, collapsed string")


def longest_power(runs: Column) -> Column:
    """The run with the most periods, compared as exact fractions; of equal ones the first."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with planted repeats: in one of ten documents, by the crc32 h of its id, the words from a on repeat the p words there.

    With g = floor(h / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", _WHITE), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + g % 8)) + 1
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        # Bound once, as lambda variables, so that no step is made again for each word.
        return F.when(n > 0, F.transform(F.array(at), lambda places: F.array_join(F.transform(places, lambda i: F.get(ws, i.cast("int"))), " "))[0])

    text = F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """The runs of each document with planted repeats: how many, the one with the most periods, and digests of all runs and of what is left."""
    found = collapse_runs(with_repeats(docs)).withColumn("best", longest_power(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
