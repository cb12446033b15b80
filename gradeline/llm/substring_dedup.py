"""Substring deduplication with difference-cover anchors.

{1, 2, 4} is a difference cover modulo 7: for any two positions of one 13-word passage there is a
shift of at most 6 words that brings both to cover positions. So 7-word windows are hashed at cover
positions only (three of seven), and any two equal 13-word windows share an anchor inside them.

1. Anchors: every task hashes its texts' anchors and merges them. An anchor of several documents of a
   task is shared, which the task tells the documents' partitions itself (spread over all partitions
   on the way); of each anchor one entry goes to the partition of the hash space that keeps it, and
   that answers those whose anchor occurs elsewhere too.
2. Extension: texts meet their partition's shared anchors; only the 13-word windows around a shared
   anchor are hashed (96 bits). A task keeps the smallest document of each window, marks the others
   itself, and sends the smallest on, so a partition of the hash space finds the smallest of all.
3. Removal: texts meet their repeated windows; covered words go.

No pairs are formed, and a passage of very many documents costs its home one entry for each task.
Windows are equal if their 96-bit hashes are. Defined results: null and empty texts have no words; a
null id counts as smaller than any other and comes back null; rows that repeat an id never remove
each other's words; fewer than 13 words: nothing to remove; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeline.llm import buckets as B
from gradeline.llm.shared import Tables, prepare
from gradeline.llm.textops import SpanHash, blocks, column_bytes, mixed, ranges, windows, word_spans

PERIOD, COVER = 7, (1, 2, 4)
WINDOW = 13
ANCHOR = WINDOW - PERIOD + 1

_WORD, _WORD2 = SpanHash(41), SpanHash(42)
_ANCHOR, _FIRST, _SECOND = SpanHash(43), SpanHash(44), SpanHash(45)
_IS_COVER = np.isin(np.arange(PERIOD), COVER)

_ANCHORS = {"key": 8, "to": 4}
_HITS = {"key": 6, "to": 4}
_WINDOWS = {"key": 8, "more": 4, "id": -8, "row": -8, "start": 4}
_REPEATS = {"id": -8, "row": -8, "start": 4}
#: Marks in ``to``: passed through to the documents' partition; known to be shared, without an answer.
_DIRECT, _SHARED = np.uint64(1 << 31), np.uint64(1 << 30)
_PART = _SHARED - np.uint64(1)
_LOW32 = np.uint64((1 << 32) - 1)
_LOW48 = np.uint64((1 << 48) - 1)


def _words(block: pa.RecordBatch):
    data, offsets = column_bytes(block.column("text"))
    starts, ends, first = word_spans(data, offsets)
    return data, starts, ends, first, _WORD.words(data, starts, ends)


def _anchors(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions of the anchors of a block, the row of each, and their hashes."""
    at, row = windows(first, ANCHOR)
    cover = _IS_COVER[(at - first[row]) % PERIOD]
    at, row = at[cover], row[cover]
    return at, row, _ANCHOR.runs(hashes, at, ANCHOR)


def _prints(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's words, to tell rows of one id apart."""
    sums = np.append(np.uint64(0), np.cumsum(hashes * np.arange(1, len(hashes) + 1, dtype=np.uint64)))
    base = np.append(np.uint64(0), np.cumsum(hashes))
    begin, end = first[:-1], first[1:]
    return (sums[end] - sums[begin]) - (base[end] - base[begin]) * begin.astype(np.uint64)


def _spread(entries: B.Entries, parts: int, other: str) -> np.ndarray:
    """The home of each entry's key; entries that are passed through go anywhere."""
    row = entries.get("row", entries["to"] if "to" in entries else None)
    direct = row & _DIRECT > 0
    return B.hash_bucket(np.where(direct, mixed(entries[other] * np.uint64(31) + row), entries["key"]), parts)


def _shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """(part, key, to): anchors of two or more documents, for each partition of documents that has them."""

    def merged(keys: list, to: list, docs_: list) -> B.Entries:
        key, part, doc = (np.concatenate(x) for x in (keys, to, docs_))
        for x in (keys, to, docs_):
            x.clear()
        order = np.argsort(key, kind="stable")  # documents stay in order within a key
        key, part, doc = key[order], part[order], doc[order]
        at = B.heads(key)
        size = np.diff(np.append(at, len(key)))
        several = doc[at] != doc[at + size - 1]
        every = np.repeat(several, size)
        k, p = key[every], part[every] | _DIRECT
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        once = B.heads(k, p)
        home = np.where(several, _SHARED, part[at])
        return {"key": np.append(key[at], k[once]), "to": np.append(home, p[once])}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        keys, to, docs_, seen, held = [], [], [], 0, 0
        for block in blocks(batches, "text"):
            _, _, _, first, hashes = _words(block)
            _, row, h = _anchors(first, hashes)
            keys.append(h)
            to.append(np.asarray(block.column("part")).astype(np.uint64)[row])
            docs_.append(row + seen)
            seen, held = seen + block.num_rows, held + len(h)
            if held >= B.FLUSH:
                yield merged(keys, to, docs_)
                held = 0
        if held:
            yield merged(keys, to, docs_)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        for e in B.gathered(batches, _ANCHORS):
            direct = e["to"] & _DIRECT > 0
            key, to = e["key"][~direct], e["to"][~direct]
            order = np.argsort(key, kind="stable")
            key, to = key[order], to[order]
            at = B.heads(key)
            size = np.diff(np.append(at, len(key)))
            known = (np.bitwise_or.reduceat(to, at) & _SHARED > 0) | (size > 1) if len(at) else np.zeros(0, bool)
            hit = np.repeat(known, size) & (to & _SHARED == 0)
            key, to = np.append(key[hit], e["key"][direct]) & _LOW48, np.append(to[hit], e["to"][direct]) & _PART
            order = np.lexsort((key, to))
            key, to = key[order], to[order]
            once = B.heads(to, key)
            yield {"key": key[once], "to": to[once]}

    sent = B.exchange(docs, scan, _ANCHORS, lambda e: _spread(e, parts, "key"), parts)
    return B.exchange(sent, shared, _HITS, lambda e: e["to"].astype(np.int64), parts)


def _repeated_windows(docs: DataFrame, hits: DataFrame, parts: int) -> DataFrame:
    """(part, id, row, start): windows that start in a smaller document too; ``row`` has a print of the text and the partition."""

    def merged(found: list[B.Entries]) -> B.Entries:
        e = {n: np.concatenate([f[n] for f in found]) for n in _WINDOWS}
        found.clear()
        return least(e, False)

    def least(e: B.Entries, done: bool) -> B.Entries:
        """Entries of larger documents are marked; if ``done``, only these remain."""
        order = np.lexsort((e["id"].view(np.int64), e["more"], e["key"]))
        e = {n: c[order] for n, c in e.items()}
        at = B.heads(e["key"], e["more"])
        ids = e["id"].view(np.int64)
        again = ids > np.repeat(ids[at], np.diff(np.append(at, len(ids))))
        if done:
            return {n: c[again] for n, c in e.items()}
        e["row"] = np.where(again, e["row"] | _DIRECT, e["row"])
        e["key"] = np.where(again, np.uint64(0), e["key"])
        e["more"] = np.where(again, np.uint64(0), e["more"])
        return e

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        packs: list[np.ndarray] = []
        known, found, held = None, [], 0
        for block in blocks(B.split_met(batches, lambda r: packs.append(B.unpacked(r["key"], 6))), "text"):
            if known is None:
                known = np.unique(np.concatenate(packs)) if packs else np.zeros(0, np.uint64)
                packs.clear()
            if not len(known):
                continue
            data, starts, ends, first, hashes = _words(block)
            at, row, h = _anchors(first, hashes)
            key = h & _LOW48
            hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            at, row = at[hit], row[hit]
            if not len(at):
                continue
            edge = np.bincount(np.maximum(at - (WINDOW - ANCHOR), first[row]), minlength=len(starts) + 1)
            edge -= np.bincount(at + 1, minlength=len(starts) + 1)
            begin = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            row = np.searchsorted(first, begin, side="right") - 1
            fits = begin + WINDOW <= first[row + 1]
            begin, row = begin[fits], row[fits]
            if not len(begin):
                continue
            prints = _prints(first, hashes) & _LOW32
            part = np.asarray(block.column("part")).astype(np.uint64)
            found.append({
                "key": _FIRST.runs(hashes, begin, WINDOW), "more": _SECOND.runs(_WORD2.words(data, starts, ends), begin, WINDOW) & _LOW32,
                "id": B.ids_of(block.column("doc_id")).view(np.uint64)[row], "row": (prints << np.uint64(32) | part)[row],
                "start": (begin - first[row]).astype(np.uint64),
            })
            held += len(begin)
            if held >= B.FLUSH // 2:
                yield merged(found)
                held = 0
        if found:
            yield merged(found)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        for e in B.gathered(batches, _WINDOWS):
            direct = e["row"] & _DIRECT > 0
            later = least({n: c[~direct] for n, c in e.items()}, True)
            out = {n: np.append(later[n], e[n][direct]) for n in _REPEATS}
            out["row"] &= ~_DIRECT
            order = np.lexsort((out["start"], out["row"], out["id"]))
            yield {n: c[order] for n, c in out.items()}

    met = B.met(docs, hits, ["key"], parts)
    sent = B.exchange(met, extend, _WINDOWS, lambda e: _spread(e, parts, "start"), parts)
    return B.exchange(sent, smallest, _REPEATS, lambda e: (e["row"] & _PART).astype(np.int64), parts)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``with_text`` also kept_text."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    parts = B.partitions(docs)
    docs = B.with_part(docs, parts)
    tables = Tables(spark)
    hits = tables.keep(_shared_anchors(docs, parts), "substring-anchors")
    repeats = tables.keep(_repeated_windows(docs, hits, parts), "substring-windows")
    tables.drop(hits)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields.append(("kept_text", pa.string()))
    schema = pa.schema(fields)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[tuple] = []
        table = None

        def take(r: dict) -> None:
            id_, row, start = (B.unpacked(r[n], w) for n, w in _REPEATS.items())
            packs.append((id_.view(np.int64), row >> np.uint64(32), start.astype(np.int64)))

        for block in blocks(B.split_met(batches, take), "text"):
            if table is None:
                ids, prints, starts = (np.concatenate(c) for c in zip(*packs, strict=True)) if packs else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
                packs.clear()
                order = np.lexsort((prints, ids))
                ids, prints, table = ids[order], prints[order], starts[order]
                head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1]))) if len(ids) else np.zeros(0, np.int64)
                bounds = np.append(head, len(ids))
                index = {(int(i), int(f)): k for k, (i, f) in enumerate(zip(ids[head], prints[head], strict=True))}
            data, spans, _, first, hashes = _words(block)
            own = B.ids_of(block.column("doc_id"))
            prints_ = _prints(first, hashes) & _LOW32
            where = [index.get((int(i), int(f)), -1) for i, f in zip(own, prints_, strict=True)]
            some = np.array([k for k, w in enumerate(where) if w >= 0], np.int64)
            covered = np.zeros(len(spans), bool)
            if len(some):
                to = np.array([where[k] for k in some])
                size = bounds[to + 1] - bounds[to]
                begin = table[ranges(bounds[to], size)] + np.repeat(first[some], size)
                edge = np.bincount(begin, minlength=len(spans) + 1) - np.bincount(begin + WINDOW, minlength=len(spans) + 1)[: len(spans) + 1]
                covered = np.cumsum(edge)[:-1] > 0
            gone = np.append(0, np.cumsum(covered))
            gone = gone[first[1:]] - gone[first[:-1]]
            columns: list[list] = [[] for _ in range(2)]
            raw, offsets = column_bytes(block.column("text"))
            raw = raw.tobytes()
            keep = (~covered).tolist() if len(some) else []
            for k in range(block.num_rows):
                words = raw[offsets[k] : offsets[k + 1]].split()
                if gone[k]:
                    words = compress(words, keep[first[k] : first[k + 1]])
                text = b" ".join(words)
                columns[0].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    columns[1].append(text.decode())
            arrays = [B.id_array(own), pa.array(np.diff(first)), pa.array(gone), pa.array(columns[0])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[1], pa.string())] * with_text, schema=schema)

    met = B.met(docs, repeats, list(_REPEATS), parts)
    return met.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
