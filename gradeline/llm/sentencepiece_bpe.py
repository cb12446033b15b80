"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary could span the cut, equal segments are encoded
once for each block, and all segments of a block merge together: in each round every segment
finds its adjacent pairs of the smallest rank and merges them, leftmost first, up to one that makes
a pair of a smaller rank, until no pair of any segment is in the vocabulary. This keeps the library's
order of merges exactly. Characters outside the vocabulary become byte pieces.

Defined results: null counts as empty, an empty text has no ids and decodes to an empty text,
texts of any length are encoded whole, rows that repeat stay as they are, other columns don't
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeline.llm.shared import prepare
from gradeline.llm.textops import SpanHash, blocks

_SPACE, _NORMAL, _UNKNOWN, _CONTROL, _BYTE = "▁", 1, 2, 3, 6
_NONE = np.int32(np.iinfo(np.int32).max)
_DENSE = 1024


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Tables of a BPE model file with identity normalisation and a dummy prefix."""

    def __init__(self, data: bytes):
        pieces, kinds, scores = [], [], []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece[2], np.float32)[0]) if 2 in piece else 0.0)
                kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(3, 1) != 1 or spec.get(4, 1) != 0 or spec.get(5, 1) != 1:
                    raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.pieces, self.kinds = pieces, kinds
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        if any(k not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for k in kinds):
            raise ValueError("user-defined pieces are not supported")
        self.byte_ids = [0] * 256
        self.raw = []  # the bytes that each id decodes to
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == _BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            self.raw.append(
                {_BYTE: lambda p=p: bytes([int(p[3:5], 16)]), _NORMAL: lambda p=p: p.replace(_SPACE, " ").encode(), _UNKNOWN: lambda: " ⁇ ".encode(), _CONTROL: lambda: b""}[k]()
            )
        self.is_byte = np.array([k == _BYTE for k in kinds])
        self.texts = [str(i).encode() for i in range(len(pieces))]
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        order = sorted((i for p, i in normal.items() if len(p) > 1), key=lambda i: (-scores[i], i))
        self.merged = np.array(order, np.int32)  # by rank
        pairs: dict[int, int] = {}
        near: set[tuple[str, str]] = set()
        for rank, i in enumerate(order):
            p = pieces[i]
            near.update(zip(p, p[1:], strict=False))
            if any(self.char_id[ord(c)] < 0 for c in p):
                raise ValueError("a piece has a character that is no piece")
            for cut in range(1, len(p)):
                left, right = normal.get(p[:cut]), normal.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        self.bits = max(int(np.ceil(np.log2(max(len(pairs), 1) * 5))), 4)
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        for key, rank in pairs.items():
            at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, rank
        # Whether a merge can span two characters: a table for low code points, a sorted list for the others.
        self.joins = np.zeros((_DENSE, _DENSE), bool)
        for a, b in near:
            self.joins[self._dense(ord(a)), self._dense(ord(b))] = True
        self.near = np.array(sorted(ord(a) << 21 | ord(b) for a, b in near), np.int64)
        space = self._dense(ord(_SPACE))
        self.joins[:, space] = False
        self.joins[space, space] = True
        if any(b == _SPACE and a != _SPACE for a, b in near):
            raise ValueError("a piece has a space after another character")

    @staticmethod
    def _dense(code: int) -> int:
        return _DENSE - 2 if code == ord(_SPACE) else min(code, _DENSE - 1) if code < _DENSE - 2 else _DENSE - 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at], _NONE)
        open_ = np.flatnonzero((there != key) & (there != np.uint32(0xFFFFFFFF)))
        while len(open_):
            at[open_] = (at[open_] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != np.uint32(0xFFFFFFFF))]
        return out

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all segments (flat symbols and the start of each) to the end; flat ids and starts.

        In a round each segment merges all pairs of its smallest rank, leftmost first and without overlap, up to
        the first whose merge makes a pair of a smaller rank: that pair comes before the rest, in the next round.
        """
        segments = len(starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        done_ids: list[np.ndarray] = []
        done_of: list[np.ndarray] = []
        of = np.repeat(np.arange(segments), lengths)
        rank = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            length = np.diff(np.append(head, len(symbols)))
            best = np.minimum.reduceat(rank, head)
            live = best != _NONE
            if not live.all():  # segments that are finished leave
                stay = np.repeat(live, length)
                done_ids.append(symbols[~stay])
                done_of.append(of[~stay])
                if not live.any():
                    break
                symbols, of, rank = symbols[stay], of[stay], rank[stay]
                best, length = best[live], length[live]
            at = np.flatnonzero(rank == np.repeat(best, length))
            if len(at) > 1:
                run = np.flatnonzero(np.append(True, np.diff(at) != 1))  # overlapping pairs: every other one
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            made = self.merged[rank[at]]
            if len(at) > 1:
                # The pairs that each merge makes, with the symbols as they are at that moment.
                seg, least = of[at], rank[at]
                left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
                has_left, has_right = (at > 0) & (of[left] == seg), (at + 2 < len(symbols)) & (of[right] == seg)
                before = symbols[left].copy()
                chained = np.flatnonzero(at[1:] == at[:-1] + 2) + 1
                before[chained] = made[chained - 1]
                lower = has_left & (self.pair_ranks(before, made) < least)
                lower |= has_right & (self.pair_ranks(made, symbols[right]) < least)
                if lower.any():
                    count = np.cumsum(lower) - lower  # such merges before each one, whose segments wait
                    first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                    keep = count == np.repeat(count[first], np.diff(np.append(first, len(seg))))
                    at, made = at[keep], made[keep]
            symbols[at] = made
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol before each place goes for every earlier merge
            symbols, of, rank = symbols[keep], of[keep], rank[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[of[touched] == of[touched + 1]]
            rank[touched] = self.pair_ranks(symbols[touched], symbols[touched + 1])
        ids = np.concatenate(done_ids) if done_ids else symbols
        of = np.concatenate(done_of) if done_of else of
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(segments + 1))

    def segments(self, codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Starts of the segments of code points; ``breaks`` are starts of texts."""
        small = np.minimum(codes, _DENSE - 1)
        small = np.where(codes == ord(_SPACE), _DENSE - 2, np.where(small >= _DENSE - 2, _DENSE - 1, small))
        known = self.char_id[codes] >= 0
        cut = np.ones(len(codes), bool)
        joined = self.joins[small[:-1], small[1:]]
        high = np.flatnonzero(joined & ((small[:-1] == _DENSE - 1) | (small[1:] == _DENSE - 1)))
        if len(high):
            pair = codes[high].astype(np.int64) << 21 | codes[high + 1]
            joined[high] = self.near[np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)] == pair
        cut[1:] = ~joined | ~known[:-1] | ~known[1:]
        cut[breaks] = True
        return np.flatnonzero(cut)

    def encode_segments(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given segments (flat, and the bounds of each)."""
        from gradeline.llm.textops import ranges

        lengths = ends - starts
        flat = codes[ranges(starts, lengths)]
        symbols = self.char_id[flat]
        unknown = symbols < 0
        if unknown.any():  # such a character is a segment by itself: bytes, without merges
            head = np.cumsum(lengths) - lengths
            odd = np.flatnonzero(unknown[head])
            ids, bounds = self.merge(np.where(unknown, 0, symbols).astype(np.int32), head)
            parts = [[self.byte_ids[b] for b in chr(flat[head[i]]).encode()] for i in odd]
            counts = np.diff(bounds)
            grown = counts.copy()
            grown[odd] = [len(p) for p in parts]
            new = np.append(0, np.cumsum(grown))
            out = np.zeros(new[-1], np.int32)
            same = np.ones(len(counts), bool)
            same[odd] = False
            out[ranges(new[:-1][same], counts[same])] = ids[ranges(bounds[:-1][same], counts[same])]
            for i, p in zip(odd, parts, strict=True):
                out[new[i] : new[i + 1]] = p
            return out, new
        return self.merge(symbols.astype(np.int32), np.cumsum(lengths) - lengths)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        unique, numbers = self._encoded(texts)
        return [[i for k in of.tolist() for i in unique[k]] for of in numbers]

    def _encoded(self, texts: list[str]):
        """Ids of the distinct segments, and for each text the numbers of its segments."""
        joined = "".join(_SPACE + t if t else "" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        codes[codes == 32] = ord(_SPACE)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        if not len(codes):
            return [], [np.zeros(0, np.int64) for _ in texts]
        starts = self.segments(codes, begin[sizes > 0])
        ends = np.append(starts[1:], len(codes))
        one, two = (h.words(codes.view(np.uint8), starts * 4, ends * 4) for h in _HASHES)
        _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][inverse] != two).any():  # two segments share the first hash: compare both
            _, first, inverse = np.unique(np.rec.fromarrays([one, two]), return_index=True, return_inverse=True)
        ids, bounds = self.encode_segments(codes, starts[first], ends[first])
        flat, b = ids.tolist(), bounds.tolist()
        at = np.searchsorted(starts, np.append(begin, len(codes)))
        return [flat[x:y] for x, y in zip(b[:-1], b[1:], strict=True)], [inverse[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded ids, without the removal of the first space."""
        raw = b"".join([self.raw[i] for i in ids])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self._repaired(ids)

    def _repaired(self, ids: list[int]) -> bytes:
        """Each byte of a run of byte pieces that starts no valid character becomes U+FFFD."""
        out, at = [], 0
        while at < len(ids):
            if not self.is_byte[ids[at]]:
                out.append(self.raw[ids[at]])
                at += 1
                continue
            for size in (4, 3, 2, 1):
                run = ids[at : at + size]
                if len(run) == size and all(self.is_byte[i] for i in run):
                    with_ = b"".join(self.raw[i] for i in run)
                    try:
                        if len(with_.decode()) == 1:
                            out.append(with_)
                            at += size
                            break
                    except UnicodeDecodeError:
                        pass
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the dummy prefix goes."""
        out = self.decode_bytes(ids).decode()
        return out[1:] if ids and self.pieces[ids[0]].startswith(_SPACE) else out


_HASHES = (SpanHash(11), SpanHash(12))
_models: dict[str, Model] = {}


def model(data: bytes) -> Model:
    """The tables of a model file; kept while the process lives."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models[key] = Model(data)
    return _models[key]


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(
    docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``with_ids`` also ids and decoded.

    The model file (about 0.5 MB) is read by the driver and sent to the workers.
    """
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(Path(model_path or default_model_path()).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shipped.value)
        for block in blocks(batches, "text"):
            texts = [t or "" for t in block.column("text").to_pylist()]
            unique, numbers = m._encoded(texts)
            strings = [b",".join([m.texts[i] for i in ids]) for ids in unique]
            decoded = [m.decode_bytes(ids) for ids in unique]
            sizes = np.array([len(ids) for ids in unique], np.int64)
            columns = {"doc_id": block.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if with_ids:
                columns |= {"ids": [], "decoded": []}
            for of in numbers:
                listed = of.tolist()
                text = b"".join([decoded[k] for k in listed])
                text = text[1:] if listed else text  # the dummy prefix
                columns["n_tokens"].append(int(sizes[of].sum()) if listed else 0)
                columns["ids_sha256"].append(hashlib.sha256(b",".join([strings[k] for k in listed])).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    columns["ids"].append([i for k in listed for i in unique[k]])
                    columns["decoded"].append(text.decode())
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)
    spark_schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return picked.mapInArrow(run, spark_schema)
