"""Language-model scores: log-bilinear neural models trained by noise-contrastive estimation.

Symbols are all words that occur at least ``LEAST`` times in the training texts, a class for each group
of rarer words (by their last bytes) and the text end; the vocabulary grows with the corpus. A model
scores a symbol by the product of a context vector (of the symbol one or two places before it) and a
target vector, plus a bias. The probability is a mixture of the two places.

The most frequent words, coarse classes of all others and the end are trained first, on the counts of all
pairs of them: the noise-contrastive objective over all data and all noise is a sum over that table. All
other words (and classes of rare words) then get vectors of their own. Given the first ones, each
word's objective is convex and stands alone, so words are fitted in batches where their hash sends them, on
all their occurrences. A frequent word or coarse class is normalised over all of these for every context
with its own vector; a word of a class over all words of the class, for every frequent word and class as
context, so the work grows with the vocabulary and not with its square. A rare word has the probability
of its class times its add-one share within the class, so the probabilities of all words, with one place
for unseen words in each class, sum to one.

Texts are read once: groups of documents become rows with their distinct words (by hash, with the counts in
training texts) and their tokens as numbers of these words. Token counts are exact and cover all training
texts: each group sends its distinct words to the partitions of the hash space, which add up and answer the
group's partition, so a word of very many documents costs one entry a group. Words are told apart by 64-bit
hashes. A word in more than ``LANE`` occurrences is gathered by several tasks, whose sums are added before
it is fitted. The model is held by the driver and broadcast, some 500 bytes for each word that has vectors;
such words have at least ``LEAST`` occurrences and ``LEAST_SHARE`` of all words, so there are at most
1 / LEAST_SHARE of them.

Defined results: A-Z are lower-cased; null and empty texts have the end token only; a null id is not
held out and comes back null; rows that repeat id and text are scored each; without training texts
all counts are zero and the model is the uniform one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import buckets as B
from gradeline.llm.labels import fold
from gradeline.llm.shared import TIDY, Tables, new_dir, prepare, settings, write
from gradeline.llm.textops import SpanHash, blocks, column_bytes, lower_ascii, mixed, word_spans

#: Words that are trained together, and classes of others.
VOCABULARY, CLASSES = 1000, 64
#: Occurrences from which on any word has vectors of its own; shares of the contexts one and two places before.
LEAST = 10
LEAST_SHARE = 5e-7
SHARES = (0.8, 0.2)
#: Pull of a word's vectors towards those of its class; words fitted at a time.
RIDGE, FITTED = 2.0, 128
DIMENSIONS, NOISE = 24, 10
#: Observations with plain symbol frequencies that each context starts with.
PRIOR_PAIRS = 50.0
_CLASS_BITS = np.uint64(CLASSES - 1)
_WORD = SpanHash(61)
#: Words of a group of documents; occurrences of a word that one task gathers.
GROUP_WORDS = 700_000
LANE = 4_000_000
_GROUPS = {"ids": 8, "held": 1, "sizes": 4, "tokens": 4, "words": 8, "train": 4}
_WORDS = {"key": 8, "to": -4, "n": 4}
_REPLIES = {"key": 8, "n": 6, "to": -4}
_NEAR = {"item": 4, "before1": 2, "before2": 2, "after1": 2, "after2": 2}
_PAIRS = {"pair": 4, "n": 6}
_NONE = 65_535


def _picked(docs: DataFrame, id_col: str, text_col: str, parts: int = 7, out: int = 2) -> DataFrame:
    held = F.coalesce(fold(F.col(id_col), parts) == out, F.lit(False))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(B.NULL_ID)).alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))


def _words(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block (the class in the lowest bits) and the first word of each row."""
    data, offsets = column_bytes(block.column("text"))
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    hashes = _WORD.words(data, starts, ends)
    if len(starts):
        tail = data[ends - 1].astype(np.uint64) << np.uint64(8) | np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        hashes = hashes & ~_CLASS_BITS | mixed(tail) & _CLASS_BITS
    return hashes, first


def _grouped(texts: DataFrame, parts: int) -> DataFrame:
    """(part, ids, held, sizes, tokens, words, train): a row for each group of documents, its words the most frequent first."""

    def packed(found: list[tuple], part: int) -> pa.RecordBatch:
        hashes, sizes, ids, held = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        words, number, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = place[number]
        train = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(words))
        columns = {"ids": ids, "held": held.astype(np.int64), "sizes": sizes, "tokens": tokens, "words": words[order], "train": train}
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([B.packed(columns[c], w)]) for c, w in _GROUPS.items())], names=["part", *_GROUPS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, number, held, found = TaskContext.get().partitionId(), 0, 0, []
        target = lambda: (int(lane * 0.6180339887498949 % 1 * parts) + number) % parts  # noqa: E731  (tasks begin evenly spread)
        for block in blocks(batches, "text"):
            hashes, first = _words(block)
            found.append((hashes, np.diff(first), np.asarray(block.column("doc_id")), np.asarray(block.column("held").cast(pa.uint8())) > 0))
            held += len(hashes)
            if held >= GROUP_WORDS:
                yield packed(found, target())
                number, held = number + 1, 0
        if found:
            yield packed(found, target())

    return texts.mapInArrow(scan, "part int, " + ", ".join(f"{c} binary" for c in _GROUPS))


def _counted(groups: DataFrame, parts: int) -> DataFrame:
    """Packed rows. Kind word: words of training texts with their counts; kind reply: the same for each partition of groups."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        for r in B.rows_of(batches):
            key, n = (B.unpacked(r[c], _GROUPS[c]) for c in ("words", "train"))
            yield {"key": key, "to": np.full(len(key), r["part"], np.uint64), "n": n}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in B.gathered(batches, _WORDS):
            order = np.lexsort((e["to"], e["key"]))
            key, to, n = (e[c][order] for c in _WORDS)
            at = B.heads(key)
            total = np.add.reduceat(n, at)
            some = total > 0
            every = np.repeat(total, np.diff(np.append(at, len(key))))
            once = B.heads(key, to)
            once = once[every[once] > 0]
            found = [("word", key[at][some], total[some], np.zeros(0, np.uint64)), ("reply", key[once], every[once], to[once])]
            columns = [pa.array([f[0] for f in found]), *(pa.array([B.packed(f[k], w) for f in found]) for k, w in enumerate(_REPLIES.values(), 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", *_REPLIES])

    sent = B.exchange(groups.select("part", "words", "train"), scan, _WORDS, lambda e: B.hash_bucket(e["key"], parts), parts)
    return sent.mapInArrow(add, "kind string, " + ", ".join(f"{c} binary" for c in _REPLIES))


class LogBilinear:
    """Vectors and biases of the symbols that are trained together: frequent words, classes, text end."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray):
        """``words`` sorted; the class totals are those of the words outside the vocabulary."""
        self.words, self.counts = words, counts
        self.class_sizes = class_tokens + class_words + 1
        self.symbols = len(words) + CLASSES + 1
        self.end = self.symbols - 1
        rng = np.random.default_rng(7)
        self.context = rng.normal(0, 0.1, (self.symbols, DIMENSIONS))
        self.target = rng.normal(0, 0.1, (self.symbols, DIMENSIONS))
        self.combine = np.eye(DIMENSIONS)
        self.bias = np.full(self.symbols, -np.log(self.symbols))

    def train(self, pairs: np.ndarray, steps: int = 160, rate: float = 0.05) -> None:
        """Maximise the noise-contrastive objective over a table of counts [symbol before, symbol]."""
        total = pairs.sum()
        if not total:
            return
        noise = (pairs.sum(0) + 1) / (total + self.symbols)
        self.bias = np.log(noise)
        # Rare contexts lean on the frequencies of the symbols alone.
        pairs = pairs + PRIOR_PAIRS * noise[None, :]
        data = pairs / total
        against = NOISE * (pairs.sum(1) / total)[:, None] * noise[None, :]
        shift = np.log(NOISE * noise)
        names = ("context", "target", "combine", "bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        for step in range(1, steps + 1):
            q = self.context @ self.combine
            s = q @ self.target.T + self.bias
            p = 1 / (1 + np.exp(np.clip(shift - s, -30, 30)))  # that a pair is from the data
            d = data * (1 - p) - against * p
            dq = d @ self.target
            grads = {"target": d.T @ q, "bias": d.sum(0), "context": dq @ self.combine.T, "combine": self.context.T @ dq}
            for n, g in grads.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g**2
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-9)
                setattr(self, n, getattr(self, n) + rate * (1 - step / (steps + 1)) * move)

    def table(self, batch: int = 512) -> np.ndarray:
        """Log10 probability of each symbol (columns) after each symbol (rows)."""
        out = np.empty((self.symbols, self.symbols), np.float32)
        for k in range(0, self.symbols, batch):
            s = (self.context[k : k + batch] @ self.combine) @ self.target.T + self.bias
            top = s.max(1, keepdims=True)
            out[k : k + batch] = (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / np.log(10)
        return out


class Grown:
    """All symbols: frequent words, other words of the vocabulary, classes of rare words, text end.

    ``coarse`` is each symbol's place among those that are trained together. After training,
    ``context``, ``target``, ``bias``, ``log_sum`` and ``class_sum`` have one array for each place before;
    ``given`` has the context vectors, target vectors and biases of coarse symbols.
    """

    def __init__(self, frequent: np.ndarray, others: np.ndarray, counts: np.ndarray, rest_tokens: np.ndarray, rest_words: np.ndarray):
        """``counts`` are those of frequent and other words."""
        words = np.append(frequent, others)
        self.frequent = len(frequent)
        self.end = len(words) + CLASSES
        self.symbols = self.end + 1
        self.place = np.argsort(words)
        self.words = words[self.place]
        self.classes = len(frequent) + np.arange(CLASSES)
        self.coarse = np.concatenate([np.arange(len(frequent)), len(frequent) + (others & _CLASS_BITS).astype(np.int64), self.classes, [len(frequent) + CLASSES]])
        self.occurrences = np.append(counts, rest_tokens)
        # What a word adds besides log10(c + 1), which the exact counts hold.
        self.own = np.concatenate([-np.log10(counts + 1), -np.log10(rest_tokens + rest_words + 1), [0.0]])
        self.given, self.context, self.target, self.bias, self.log_sum, self.class_sum = [], [], [], [], [], []

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each word hash: its own or that of its class of rare words."""
        symbol = len(self.words) + (words & _CLASS_BITS).astype(np.int64)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            symbol = np.where(self.words[at] == words, self.place[at], symbol)
        return symbol

    def encode(self, symbol: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The symbols one and two places before each token, the token's symbol, ends included, and the bounds of each row's tokens."""
        rows = len(first) - 1
        bounds = first + np.arange(rows + 1)  # one end more for each row
        after = np.full(bounds[-1], self.end)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[1:] - 1] = False
        after[inner] = symbol
        before, last = [], after
        for _ in SHARES:
            shifted = np.empty_like(after)
            shifted[1:] = last[:-1]
            shifted[bounds[:-1]] = self.end
            before.append(shifted)
            last = shifted
        return before, after, bounds

    def log_probabilities(self, before: list[np.ndarray], after: np.ndarray, batch: int = 50_000) -> np.ndarray:
        """Log10 probability of each symbol after those before it."""
        out = np.empty(len(after))
        for k in range(0, len(after), batch):
            a = after[k : k + batch]
            each, coarse = [], self.coarse[a]
            inner = np.flatnonzero((a >= self.frequent) & (a < self.end))
            for d, share in enumerate(SHARES):
                b = before[d][k : k + batch]
                q, t, bias = self.given[d]
                s = np.log(share) + np.einsum("ij,ij->i", self.context[d][b], t[coarse]) + bias[coarse] - self.log_sum[d][b]
                w, h = a[inner], self.coarse[b[inner]]
                s[inner] += np.einsum("ij,ij->i", q[h], self.target[d][w]) + self.bias[d][w] - self.class_sum[d][h, coarse[inner] - self.frequent]
                each.append(s)
            out[k : k + batch] = np.logaddexp(*each) / np.log(10)
        return out


def _training(row: dict, model: Grown) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What ``encode`` gives for the training texts of a group."""
    held, sizes, tokens, words = (B.unpacked(row[c], _GROUPS[c]) for c in ("held", "sizes", "tokens", "words"))
    sizes, own = sizes.astype(np.int64), held == 0
    symbol = model.symbols_of(words)[tokens.astype(np.int64)[np.repeat(own, sizes)]]
    return model.encode(symbol, np.append(0, np.cumsum(sizes[own])))


def _neighbours(model: Grown, before: list[np.ndarray], after: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The coarse symbols one and two places before and after each token; _NONE beyond the text."""
    coarse = model.coarse[after]
    columns = [model.coarse[b] for b in before]
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(after))
    for d in range(1, len(SHARES) + 1):
        later = np.full(len(after), _NONE)
        later[:-d] = coarse[d:]
        later[left <= d] = _NONE
        columns.append(later)
    return columns


def _pair_counts(groups: DataFrame, model: Grown, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts in all training texts: pairs of coarse symbols one and two places apart, and the neighbours of each class of rare words."""
    shipped = groups.sparkSession.sparkContext.broadcast(model)
    size = model.frequent + CLASSES + 1
    pairs, places = len(SHARES) * size * size, 2 * len(SHARES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        m = shipped.value
        total = np.zeros(pairs + CLASSES * places * size, np.int64)
        for r in B.rows_of(batches):
            before, after, bounds = _training(r, m)
            for d, b in enumerate(before):
                total[d * size * size : (d + 1) * size * size] += np.bincount(m.coarse[b] * size + m.coarse[after], minlength=size * size)
            rare = np.flatnonzero((after >= len(m.words)) & (after < m.end))
            cls = after[rare] - len(m.words)
            for k, c in enumerate(_neighbours(m, before, after, bounds)):
                near = c[rare]
                good = near != _NONE
                total[pairs:] += np.bincount((cls[good] * places + k) * size + near[good], minlength=len(total) - pairs)
        some = np.flatnonzero(total)
        yield {"pair": some.astype(np.uint64), "n": total[some]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in B.gathered(batches, _PAIRS):
            chunk, at = e["pair"] >> np.uint64(16), (e["pair"] & np.uint64(_NONE)).astype(np.int64)
            for c in np.unique(chunk).tolist():
                sums = np.bincount(at[chunk == c], e["n"][chunk == c].astype(float), _NONE + 1)
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([sums.tobytes()])], names=["chunk", "sums"])

    sent = B.exchange(groups.select("held", "sizes", "tokens", "words"), scan, _PAIRS, lambda e: (e["pair"] >> np.uint64(16)).astype(np.int64) % parts, parts)
    table = np.zeros(-(-(pairs + CLASSES * places * size) // (_NONE + 1)) * (_NONE + 1))
    with settings(groups.sparkSession, TIDY):
        for r in sent.mapInArrow(add, "chunk long, sums binary").collect():  # tables of fixed size
            table[r["chunk"] * (_NONE + 1) :][: _NONE + 1] = np.frombuffer(r["sums"])
    shipped.destroy()
    return table[:pairs].reshape(len(SHARES), size, size), table[pairs : pairs + CLASSES * places * size].reshape(CLASSES, places, size)


def fitted(data: np.ndarray, against: np.ndarray, features: np.ndarray, offset: np.ndarray, shift: np.ndarray, start: np.ndarray, steps: int = 16, rate: float = 0.2) -> np.ndarray:
    """A vector for each row that maximises its noise-contrastive objective with the given vectors of the columns."""
    v, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    both, base, across = data + against, shift - offset, np.ascontiguousarray(features.T)
    for step in range(1, steps + 1):
        p = v @ across
        np.subtract(base, p, out=p)
        np.minimum(p, 30, out=p)
        np.exp(p, out=p)
        p += 1
        np.divide(both, p, out=p)
        np.subtract(data, p, out=p)
        g = p @ features - RIDGE * (v - start)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g**2
        v = v + rate * (1 - step / (steps + 1)) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return v


def _fit_items(near: np.ndarray, cls: np.ndarray, chance: np.ndarray, given: list) -> np.ndarray:
    """Target vectors, biases and context vectors (flat rows) of items with these counts of neighbours [item, place, coarse symbol]."""
    out, chance = [], chance[:, None]
    for d, (q, target, bias, times, coarse_noise) in enumerate(given):
        data = near[:, d] + PRIOR_PAIRS * chance
        wide = np.column_stack([q, np.ones(len(q), np.float32)])
        start = np.column_stack([target[cls], np.log(chance)])
        out.append(fitted(data, NOISE * (times + PRIOR_PAIRS)[None, :] * chance, wide, np.float32(0), np.log(NOISE * chance), start))
        data = near[:, len(SHARES) + d] + PRIOR_PAIRS * coarse_noise
        out.append(fitted(data, NOISE * data.sum(1, keepdims=True) * coarse_noise, target, bias, np.log(NOISE * coarse_noise), q[cls]))
    return np.column_stack(out)


def _grow(groups: DataFrame, model: Grown, heads: list[LogBilinear], pairs: np.ndarray, rare: np.ndarray, parts: int, tables: Tables, lane: int) -> None:
    """Vectors of the words and classes that are not trained together, on all their occurrences in training texts."""
    spark = groups.sparkSession
    size, low, places = model.frequent + CLASSES + 1, model.frequent, 2 * len(SHARES)
    total = pairs[0].sum()
    noise = ((model.occurrences + 1) / (total + model.symbols)).astype(np.float32)
    given = []
    for head, table in zip(heads, pairs, strict=True):
        coarse_noise = (table.sum(0) + 1) / (total + size)
        q = head.context @ head.combine
        given.append([x.astype(np.float32) for x in (q, head.target, head.bias, table.sum(1), coarse_noise)])
    lanes = -(-np.maximum(model.occurrences[: len(model.words)], 1) // lane).astype(np.int64)  # tasks for each word
    shipped = spark.sparkContext.broadcast((model, given, noise, lanes)) if total else None  # before it has vectors
    for head, (q, *_) in zip(heads, given, strict=True):
        model.given.append([q, *(x.astype(np.float32) for x in (head.target, head.bias))])
        fine = model.coarse
        model.context.append(q[fine].astype(np.float32))
        model.target.append(head.target[fine].astype(np.float32))
        bias = head.bias[fine].astype(np.float32)
        if total:
            bias[low : model.end] = np.log(noise[low:])
        model.bias.append(bias)

    def take(some: np.ndarray, v: np.ndarray) -> None:
        for d in range(len(SHARES)):
            x = v[:, d * (2 * DIMENSIONS + 1) : (d + 1) * (2 * DIMENSIONS + 1)]
            model.target[d][some], model.bias[d][some], model.context[d][some] = x[:, :DIMENSIONS], x[:, DIMENSIONS], x[:, DIMENSIONS + 1 :]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        m = shipped.value[0]
        for r in B.rows_of(batches):
            before, after, bounds = _training(r, m)
            columns = _neighbours(m, before, after, bounds)
            at = np.flatnonzero((after >= low) & (after < len(m.words)))
            yield dict(zip(_NEAR, (after[at], *(c[at] for c in columns)), strict=True))

    def home(e: B.Entries) -> np.ndarray:
        item = e["item"].astype(np.int64)
        several = shipped.value[3][item]
        near = sum(e[c].astype(np.uint64) << np.uint64(16 * k) for k, c in enumerate(list(_NEAR)[1:]))
        return (item + (mixed(near) % several.astype(np.uint64)).astype(np.int64)) % parts

    def counted(items: np.ndarray, near: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(items, kind="stable")
        items, near = items[order], [c[order] for c in near]
        first = B.heads(items)
        names, first = items[first], np.append(first, len(items))
        for k in range(0, len(names), FITTED):
            some = names[k : k + FITTED]
            a, b = first[k], first[k + len(some)]
            row = np.repeat(np.arange(len(some)), np.diff(first[k : k + len(some) + 1]))
            table = np.zeros((len(some), places, size), np.float32)
            for j, c in enumerate(near):
                c = c[a:b]
                good = c != _NONE
                table[:, j] = np.bincount(row[good] * size + c[good], minlength=len(some) * size).reshape(len(some), size)
            yield some, table

    def emitted(items: np.ndarray, whole: bool, values: np.ndarray) -> pa.RecordBatch:
        if whole:
            return pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([items.astype("<i8").tobytes()]), pa.array([values.astype("<f4").tobytes()])], names=["item", "items", "values"])
        rows = [x.astype("<f8").tobytes() for x in values]
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.nulls(len(items), pa.binary()), pa.array(rows, pa.binary())], names=["item", "items", "values"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, given_, noise_, lanes_ = shipped.value
        for e in B.gathered(batches, _NEAR):
            columns = [e[c].astype(np.int64) for c in _NEAR]
            for some, table in counted(columns[0], columns[1:]):
                alone = lanes_[some] == 1
                if alone.any():
                    own = some[alone]
                    yield emitted(own, True, _fit_items(table[alone], m.coarse[own], noise_[own], given_))
                if not alone.all():  # counts of a part of its occurrences
                    yield emitted(some[~alone], False, table[~alone])

    def fit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, given_, noise_, _ = shipped.value
        sums: dict[int, np.ndarray] = {}
        for r in B.rows_of(batches):
            x = np.frombuffer(r["values"], "<f8")
            sums[r["item"]] = sums[r["item"]] + x if r["item"] in sums else x
        for item, x in sums.items():
            own = np.array([item])
            yield emitted(own, True, _fit_items(x.reshape(1, places, size).astype(np.float32), m.coarse[own], noise_[own], given_))

    if total:
        columns = "item long, items binary, values binary"
        sent = B.exchange(groups.select("held", "sizes", "tokens", "words"), scan, _NEAR, home, parts)
        found = tables.keep(sent.mapInArrow(fit, columns), "lm-vectors")
        if (lanes > 1).any():
            found = found.where("item < 0").unionByName(tables.keep(found.where("item >= 0").repartition(parts, "item").mapInArrow(fit_sums, columns), "lm-sums"))
        for r in found.toLocalIterator():  # in pieces of FITTED words
            some = np.frombuffer(r["items"], "<i8")
            take(some, np.frombuffer(r["values"], "<f4").reshape(len(some), -1))
        tables.drop(*[t for t, _ in list(tables.paths.values()) if "items" in t.columns])
        some = len(model.words) + np.arange(CLASSES)
        take(some, _fit_items(rare.astype(np.float32), model.coarse[some], noise[some], given))
        shipped.destroy()
    _normalise(spark, model)


def _normalise(spark: SparkSession, model: Grown, batch: int = 256, many: int = 32) -> None:
    """The log of each context's summed scores over coarse symbols, and of the words of each class after each coarse symbol."""
    shipped = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for r in B.rows_of(batches):
            own, within = [], []
            for d, (q, t, b) in enumerate(m.given):
                parts_, total = [], np.zeros((len(q), CLASSES))
                for k in range(r["id"] * batch * many, min((r["id"] + 1) * batch * many, m.symbols), batch):
                    at = np.arange(k, min(k + batch, m.symbols))
                    s = m.context[d][at] @ t.T + b
                    top = s.max(1)
                    parts_.append(top + np.log(np.exp(s - top[:, None]).sum(1)))
                    at = at[(at >= m.frequent) & (at < m.end)]
                    one = np.zeros((len(at), CLASSES), np.float32)
                    one[np.arange(len(at)), m.coarse[at] - m.frequent] = 1
                    total += np.exp(np.minimum(q @ m.target[d][at].T + m.bias[d][at], 60)) @ one
                own.append(np.concatenate(parts_))
                within.append(total)
            yield pa.RecordBatch.from_arrays([pa.array([r["id"]]), *(pa.array([np.array(x).astype("<f8").tobytes()]) for x in (own, within))], names=["id", "own", "within"])

    steps = -(-model.symbols // (batch * many))
    found = spark.range(0, steps, 1, steps).mapInArrow(sums, "id long, own binary, within binary").toArrow()
    shipped.destroy()
    model.log_sum = [np.zeros(model.symbols) for _ in SHARES]
    within = np.zeros((len(SHARES), model.frequent + CLASSES + 1, CLASSES))
    for r in B.rows_of(found.to_batches()):
        own = np.frombuffer(r["own"], "<f8").reshape(len(SHARES), -1)
        within += np.frombuffer(r["within"], "<f8").reshape(within.shape)
        for d in range(len(SHARES)):
            model.log_sum[d][r["id"] * batch * many :][: own.shape[1]] = own[d]
    model.class_sum = list(np.log(within))


def _vocabulary(packs: DataFrame, size: int, share: float = LEAST_SHARE) -> tuple[Grown, list[LogBilinear]]:
    """All words of the vocabulary, and untrained models of the most frequent ones with the totals of each class without them."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in B.rows_of(batches):
            key, n = B.unpacked(r["key"]), B.unpacked(r["n"], _REPLIES["n"])
            for k in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000].view(np.int64)) for c in (key, n)], names=["key", "n"])

    rows = packs.where("kind = 'word'").select("key", "n").mapInArrow(unpack, "key long, n long")
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    by_class = rows.groupBy((F.col("key").bitwiseAND(CLASSES - 1)).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    for r in by_class.collect():
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["words"]
    least = max(LEAST, int(share * tokens.sum()))
    top = rows.orderBy(F.desc("n"), "key").limit(size)
    found = rows.where(F.col("n") >= least).unionByName(top).distinct().toArrow()  # at most 1 / share + size words
    words = np.asarray(found.column("key").combine_chunks()).astype(np.int64)
    counts = np.asarray(found.column("n").combine_chunks()).astype(float)
    order = np.lexsort((words, -counts))
    words, counts = words[order].view(np.uint64), counts[order]
    own = np.arange(len(words)) < size
    others, other_counts = (x[~own & (counts >= least)] for x in (words, counts))
    words, counts = words[own], counts[own]
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    cls = (words & _CLASS_BITS).astype(np.int64)
    outside = tokens - np.bincount(cls, counts, CLASSES), distinct - np.bincount(cls, minlength=CLASSES)
    heads = [LogBilinear(words, counts, *outside) for _ in SHARES]
    cls = (others & _CLASS_BITS).astype(np.int64)
    model = Grown(words, others, np.append(counts, other_counts), outside[0] - np.bincount(cls, other_counts, CLASSES), outside[1] - np.bincount(cls, minlength=CLASSES))
    model.train_words, model.train_types = int(tokens.sum()), int(distinct.sum())
    return model, heads


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, lane: int = LANE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    texts = _picked(docs, id_col, text_col)
    parts = B.partitions(texts)
    tables = Tables(spark)
    groups = tables.keep(_grouped(texts, parts), "lm-groups")
    path = new_dir(spark, "lm-counts")
    write(_counted(groups, parts), path, "kind")
    packs = spark.read.schema(", ".join(f"{c} binary" for c in _REPLIES) + ", kind string").parquet(path)
    with settings(spark, TIDY):
        model, heads = _vocabulary(packs, vocabulary)
    pairs, rare = _pair_counts(groups, model, parts)
    for head, table in zip(heads, pairs, strict=True):
        head.train(table)
    train_docs = int(pairs[0][:, -1].sum())  # every training text ends once
    _grow(groups, model, heads, pairs, rare, parts, tables, lane)
    total = model.train_words + train_docs
    types = model.train_types + (train_docs > 0)
    shipped = spark.sparkContext.broadcast(model)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        return B.gathered(batches, _REPLIES, B.FLUSH)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, replies, known = shipped.value, [], None
        for r in B.rows_of(batches):
            if r["ids"] is None:
                replies.append((B.unpacked(r["key"], _REPLIES["key"]), B.unpacked(r["n"], _REPLIES["n"])))
                continue
            if known is None:
                known, times = (np.concatenate(c) for c in zip(*replies, strict=True)) if replies else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                replies.clear()
                order = np.argsort(known)
                known, times = known[order], times[order].astype(float)
            ids, held, sizes, tokens, words = (B.unpacked(r[c], _GROUPS[c]) for c in ("ids", "held", "sizes", "tokens", "words"))
            c = np.zeros(len(words))
            if len(known) and len(words):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                c = np.where(known[at] == words, times[at], 0)
            tokens, first = tokens.astype(np.int64), np.append(0, np.cumsum(sizes.astype(np.int64)))
            sums = [np.append(0, np.cumsum(x[tokens])) for x in (np.log10(c + 1), c > 0)]
            word_sum, n_known = (x[first[1:]] - x[first[:-1]] for x in sums)
            before, after, bounds = m.encode(m.symbols_of(words)[tokens], first)
            each = np.append(0, np.cumsum(m.log_probabilities(before, after) + m.own[after]))
            n = np.diff(bounds)
            columns = [
                B.id_array(ids.view(np.int64)), pa.array(held > 0), pa.array(n), pa.array(n_known + (train_docs > 0)), pa.array(np.full(len(ids), total)),
                pa.array(word_sum + np.log10(train_docs + 1) - n * np.log10(total + types + 1)), pa.array(each[bounds[1:]] - each[bounds[:-1]] + word_sum),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = B.exchange(packs.where("kind = 'reply'").drop("kind"), dealt, _REPLIES, lambda e: e["to"].astype(np.int64), parts)
    own = groups.select("part", F.lit(1).alias("order"), *(c for c in _GROUPS if c != "train"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("n"))
    met = own.unionByName(answers.select("part", F.lit(0).alias("order"), "key", "n"), allowMissingColumns=True)
    met = met.repartitionById(parts, "part").sortWithinPartitions("order")
    return met.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
