"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting cycles through the features; each step fits a shallow tree to the gradients over the
feature's bins and adds it to that feature's lookup table. Then the pairs with the largest gain
on what is left get two-way tables in the same way. A document's score is a sum of table entries
at its bins, so scoring needs no trees. Features come from the text alone.

Defined results: null and empty texts have all features at zero and get a score like any other;
with no labelled rows every score is 0.5; labels on one side only give that side's rate;
repeated rows and null identifiers are scored like others, and a null one is never held out; an empty
table gives an empty result; a very long text is one row of features like any other, worked on as a
block of its own; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.labels import SAMPLE_ROWS, fold, training_sample
from gradeline.llm.shared import prepare
from gradeline.llm.textops import SpanHash, blocks, column_bytes, mixed, word_spans

FEATURES = (
    "log_words", "word_length", "symbols", "bars", "exclamations", "capitals", "digits",
    "repeated_neighbours", "distinct_words", "sentence_ends", "other_scripts", "longest_word", "lines",
)

_KINDS = {
    "symbols": b"#$%&*@^~_=+<>{}[]\\/", "bars": b"|", "exclamations": b"!", "upper": bytes(range(65, 91)),
    "letters": bytes([*range(65, 91), *range(97, 123)]), "digits": b"0123456789", "stops": b".?!", "high": bytes(range(128, 256)), "newline": b"\n",
}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
_WORD = SpanHash(21)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first).astype(float)
    per_word, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)

    def count(kind: str) -> np.ndarray:
        sums = np.append(0, np.cumsum(_MASKS[kind][data], dtype=np.int64))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    row = np.repeat(np.arange(n), np.diff(first))
    hashes = _WORD.words(data, starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    keys = np.sort(mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | row.astype(np.uint64) << np.uint64(44))
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=n) if len(keys) else np.zeros(n)
    length = ends - starts
    longest = np.zeros(n)
    full = words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(length, first[:-1][full])
    stops = np.bincount(row, _MASKS["stops"][data[ends - 1]] if len(ends) else None, n) if len(row) else np.zeros(n)
    total = np.bincount(row, length, n) if len(row) else np.zeros(n)
    return np.column_stack([
        np.log1p(words), total / per_word, count("symbols") / per_word, count("bars") / per_word, count("exclamations") / per_word,
        count("upper") / np.maximum(count("letters"), 1), count("digits") / size,
        (np.bincount(row, same, n) if len(row) else np.zeros(n)) / per_word, distinct / per_word, stops / per_word,
        count("high") / size, np.log1p(longest), count("newline") / per_word,
    ])


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, edges, tables, pairs, base):
        self.edges, self.tables, self.pairs, self.base = edges, tables, pairs, base

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.base)
        for table, b in zip(self.tables, at, strict=True):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[at[i], at[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of the tree with at most so many leaves that fits the gradient sums best."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in parts:
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (lo, lo + k + 1, hi))
        if not best[1]:
            break
        lo, mid, hi = best[1]
        parts.remove((lo, hi))
        parts += [(lo, mid), (mid, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 5,
    most_bins: int = 32, leaves: int = 3, rate: float = 0.15, ridge: float = 2.0,
) -> AdditiveModel:
    """Fit to labels 0/1."""
    if not len(y):
        return AdditiveModel([np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [], 0.0)
    share = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], [], float(np.log(share / (1 - share))))
    at = model.bins(x)
    logit = np.full(len(y), model.base)

    def gradients():
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, b in enumerate(at):
            size = len(edges[j]) + 1
            if size < 2:
                continue
            g, h = gradients()
            step = rate * _tree(np.bincount(b, g, size), np.bincount(b, h, size), leaves, ridge)
            model.tables[j] += step
            logit += step[b]
    gains = []
    g, h = gradients()
    for i in range(len(at)):
        for j in range(i + 1, len(at)):
            gain, _ = _pair_tree(at, edges, i, j, g, h, ridge)
            gains.append((gain, i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))))
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = gradients()
            _, step = _pair_tree(at, edges, i, j, g, h, ridge)
            table += rate * step
            logit += rate * step[at[i], at[j]]
    return model


def _pair_tree(at, edges, i, j, g, h, ridge):
    """Gain and two-way table of the best cut of one feature followed by a cut of the other on each side."""
    shape = (len(edges[i]) + 1, len(edges[j]) + 1)
    flat = at[i] * shape[1] + at[j]
    gs = np.bincount(flat, g, shape[0] * shape[1]).reshape(shape)
    hs = np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)
    best = (0.0, np.zeros(shape))
    whole = gs.sum() ** 2 / (hs.sum() + ridge)
    for turn in (False, True):
        G, H = (gs.T, hs.T) if turn else (gs, hs)
        if G.shape[0] < 2 or G.shape[1] < 2:
            continue
        c, d = np.cumsum(np.cumsum(G, 0), 1), np.cumsum(np.cumsum(H, 0), 1)
        total = 0
        picks = []
        for low in (True, False):  # the rows up to each cut, and the rest
            a = (c[:-1] if low else c[-1] - c[:-1]), (d[:-1] if low else d[-1] - d[:-1])
            left = a[0][:, :-1] ** 2 / (a[1][:, :-1] + ridge)
            right = (a[0][:, -1:] - a[0][:, :-1]) ** 2 / (a[1][:, -1:] - a[1][:, :-1] + ridge)
            gain = left + right
            picks.append(gain.argmax(1))
            total = total + gain.max(1)
        k = int(np.argmax(total))
        if total[k] - whole > best[0]:
            table = np.zeros(G.shape)
            for rows, cut in ((slice(0, k + 1), picks[0][k]), (slice(k + 1, None), picks[1][k])):
                for cols in (slice(0, cut + 1), slice(cut + 1, None)):
                    table[rows, cols] = -G[rows, cols].sum() / (H[rows, cols].sum() + ridge)
            best = (total[k] - whole, table.T if turn else table)
    return best


def train_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on labelled rows outside the held-out fold; only feature rows reach the driver."""
    prepare(docs.sparkSession)
    usable = fold(F.col("doc_id"), 3) != 1
    sample = training_sample(docs, labels, "quality", usable, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = features(*column_bytes(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("label"), *x.T], names=["label", *FEATURES])

    rows = sample.mapInArrow(run, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the fit must not depend on the order of tasks
    return fit(rows[list(FEATURES)].to_numpy(float).reshape(len(rows), len(FEATURES)), rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = model.score(features(*column_bytes(block.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs`` that the model predicts as good, with all their columns."""
    prepare(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = model.score(features(*column_bytes(block.column("text"))))
            yield block.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, schema)
