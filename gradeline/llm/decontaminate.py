"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by up to k = floor(m * error_share) edits. Cut
into k + 1 pieces, one piece of it must then occur in the passage unchanged. The first eight bytes of
all pieces of a block of items form a sorted table; every position of every whole text is looked up
in it at once, the rest of a piece is compared, and a hit says where the item would lie, give or take
k. Myers' bit-parallel algorithm finds the smallest edit distance of the item within that stretch.
Texts and items are compared in lower case (A-Z) with white space as one space. Items of fewer than
SHORT characters, which would match anything within an edit, match exactly and as whole words.

The items are sent to the workers in blocks of at most BLOCK_BYTES bytes, one after the other, with
one pass over the texts for each block; usual benchmarks are one block. Defined results: null or empty
texts match nothing, null or empty items are left out, repeated items or rows give repeated matches,
of equal distances the first end counts, an empty benchmark or table gives no match, null identifiers are reported as
null, a very long text is searched whole, as a block of its own, other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeline.llm.shared import prepare
from gradeline.llm.textops import blocks, ranges

#: Bytes of items that are sent at once.
BLOCK_BYTES = 16 << 20
ERROR_SHARE = 0.08
#: Items of fewer characters match exactly; longer ones have pieces of eight bytes or more at ERROR_SHARE.
SHORT = 20
_BITS, _ODD = 22, np.uint64(0x9E3779B97F4A7C15)
#: Candidates that are compared at a time.
_MANY = 1 << 20


def canonical(text: str | None) -> bytes:
    """UTF-8 in lower case for A-Z with one space for each run of white space."""
    return b" ".join((text or "").encode().lower().split())


class Myers:
    """Smallest edit distance between a pattern and any substring of a text."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.mask = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.peq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i
        self.peq = dict(self.peq)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end): the smallest distance and where the first such substring ends."""
        pv, mv, score, mask, top, peq = self.mask, 0, self.size, self.mask, self.top, self.peq
        found, end = self.size, 0
        for at, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < found:
                    found, end = score, at
            ph = (ph << 1) & mask
            pv = ((mh << 1) & mask) | (mask & ~(xv | ph))
            mv = ph & xv
        return found, end


class Seeds:
    """Fixed-size heads of byte strings, looked up at all positions of a text."""

    def __init__(self, strings: list[bytes], size: int):
        self.mask = np.uint64((1 << (8 * size)) - 1)
        heads = np.array([int.from_bytes(x[:size], "little") for x in strings], np.uint64)
        self.order = np.argsort(heads, kind="stable")
        self.keys, at, self.count = np.unique(heads[self.order], return_index=True, return_counts=True)
        self.first = at
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys * _ODD) >> np.uint64(64 - _BITS)] = True

    def find(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, string number) of all strings whose head is there, in pieces."""
        for lo in range(0, len(windows), _MANY):
            w = windows[lo : lo + _MANY] & self.mask
            some = np.flatnonzero(self.seen[(w * _ODD) >> np.uint64(64 - _BITS)])
            key = np.minimum(np.searchsorted(self.keys, w[some]), len(self.keys) - 1)
            hit = self.keys[key] == w[some]
            some, key = some[hit] + lo, key[hit]
            total = np.cumsum(self.count[key])
            begin = 0
            while begin < len(some):
                end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _MANY, side="right")), begin + 1)
                k = key[begin:end]
                yield np.repeat(some[begin:end], self.count[k]), self.order[ranges(self.first[k], self.count[k])]
                begin = end


class Matcher:
    """Finds all items of a block in texts."""

    def __init__(self, items: list[tuple[int, bytes]], error_share: float, short: int = SHORT):
        self.items = items
        self.texts = [t.decode() for _, t in items]
        self.exact = np.array([len(t) < short for t in self.texts], bool)
        self.errors = [0 if e else int(len(t) * error_share) for t, e in zip(self.texts, self.exact, strict=True)]
        strings, uses = [], []  # distinct pieces would save little: each use is checked by itself
        for n, text in enumerate(self.texts):
            if self.exact[n]:
                strings.append(b" " + items[n][1] + b" ")
                uses.append((n, 1))
                continue
            parts = self.errors[n] + 1
            cuts = [len(text) * j // parts for j in range(parts + 1)]
            offset = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = text[a:b].encode()
                strings.append(piece)
                uses.append((n, -offset))
                offset += len(piece)
        self.strings = strings
        self.of, self.shift = (np.array(x, np.int64) for x in zip(*uses, strict=True)) if uses else (np.zeros(0, np.int64),) * 2
        self.size = np.array([len(x) for x in strings], np.int64)
        self.tail = np.array([int.from_bytes(x[-8:], "little") for x in strings], np.uint64)
        self.seeds = []
        for size in sorted({min(len(x), 8) for x in strings}):
            own = np.array([k for k, x in enumerate(strings) if min(len(x), 8) == size])
            self.seeds.append((Seeds([strings[k] for k in own], size), own))
        self.patterns: dict[int, Myers] = {}

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, distance, end in characters) of the items in canonical texts, the closest occurrence of each."""
        if not self.strings:
            return []
        buffer = b"".join(b" " + t + b" " for t in texts)
        sizes = np.array([len(t) + 2 for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        held = np.frombuffer(buffer + bytes(8), np.uint8)
        windows = np.ndarray(len(buffer) + 1, "<u8", held, strides=(1,))
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for seeds, own in self.seeds:
            for at, number in seeds.find(windows[:-1]):
                piece = own[number]
                size = self.size[piece]
                doc = np.searchsorted(begin, at, side="right") - 1
                good = at + size <= begin[doc] + sizes[doc]
                at, piece, size, doc = at[good], piece[good], size[good], doc[good]
                good = (size <= 8) | (windows[at + np.maximum(size - 8, 0)] == self.tail[piece])
                for p, k, d in zip(at[good].tolist(), piece[good].tolist(), doc[good].tolist(), strict=True):
                    if self.size[k] <= 16 or buffer[p : p + self.size[k]] == self.strings[k]:
                        found[d, int(self.of[k])].add(p + int(self.shift[k]) - int(begin[d]) - 1)
        out = []
        for (d, n), starts in sorted(found.items()):
            hit = self._closest(n, texts[d], sorted(starts))
            if hit:
                out.append((d, n, *hit))
        return out

    def _closest(self, n: int, text: bytes, starts: list[int]) -> tuple[int, int] | None:
        """(distance, end in characters) of an item whose pieces lie where it would start at these bytes."""
        pattern, most = self.items[n][1], self.errors[n]
        if self.exact[n]:
            return 0, len(text[: starts[0] + len(pattern)].decode())
        at = text.find(pattern)
        if at >= 0:
            return 0, len(text[: at + len(pattern)].decode())
        # An edit moves bytes by four at most.
        stretches: list[list[int]] = []
        for s in starts:
            a, b = max(s - 4 * most, 0), min(s + len(pattern) + 4 * most, len(text))
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], b)
            elif a < b:
                stretches.append([a, b])
        if n not in self.patterns:
            self.patterns[n] = Myers(self.texts[n])
        best = (most + 1, 0)
        for a, b in stretches:
            while a and text[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b += 1
            distance, end = self.patterns[n].best(text[a:b].decode())
            if distance < best[0]:
                best = distance, len(text[:a].decode()) + end
        return best if best[0] <= most else None


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size, as they stream through the driver; a longer item is a block of its own."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = canonical(r["text"])
        if not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, end_at of every document and item that it contains within the budget."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    picked = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    schema = "doc_id long, item_id long, distance int, end_at long"
    parts = []
    for block in item_blocks(benchmark, block_bytes):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, error_share, short)
            for part in blocks(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[k], matcher.items[n][0], d, end) for k, n, d, end in matcher.matches([canonical(t) for t in part.column("text").to_pylist()])]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "distance", "end_at"]
                )

        parts.append(picked.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    prepare(docs.sparkSession)
    kept = docs
    for block in item_blocks(benchmark, block_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, error_share, short)
            for part in blocks(batches, "text"):
                clean = np.ones(part.num_rows, bool)
                clean[[k for k, *_ in matcher.matches([canonical(t) for t in part.column("text").to_pylist()])]] = False
                yield part.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
