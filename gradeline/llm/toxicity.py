"""Toxicity scoring with Levenshtein automata over a lexicon trie and context windows.

The lexicon is a short list of English insults plus words and stems that the labelled rows show to
occur in toxic texts only; a word must do so in many different surroundings, so that copies of one
text don't make its words look toxic. All terms form a trie for each error budget (by term length);
the Levenshtein automata of the terms are intersected with the tries and made deterministic once,
as one table of states for every ``CHUNK`` terms. All words of a block then step through a table together, a
character at a time, and leave when they can't match any more. Texts and terms are folded to lower case by the
same table of characters, and errors are counted in characters. Stems match words that begin with them exactly;
words that begin with a stem keep their own misspellings. Each hit is exact or misspelled, and inside or
outside a quotation (quotation marks or reporting words near it in a window of words); a logistic
model over the counts, fitted towards a stated prior, gives the score.

Defined results: null and empty texts have no hits; with no labelled rows the prior's weights
score; repeated rows and null identifiers are scored like others, and a null one is never held out; an empty table
gives an empty result; a very long text is counted whole, as a block of its own; other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.labels import SAMPLE_ROWS, fold, training_sample
from gradeline.llm.shared import prepare
from gradeline.llm.textops import SpanHash, blocks, column_bytes, word_spans

#: Terms that count without any labels.
INSULTS = ("idiot", "moron", "loser", "scum", "trash", "clown", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "bastard")
REPORTING = ("said", "says", "wrote", "writes", "quote", "quoted", "called", "word", "term", "dijo", "dit", "sagte", "palabra", "mot", "wort")
DIRECT = ("you", "your", "du", "dich", "tu", "toi", "vous", "te", "usted")
#: Terms of one automaton; more make further automata.
CHUNK = 100
WINDOW = 8

_CODES = 0x110000
_PUNCT = np.zeros(_CODES, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARKS = np.zeros(_CODES, bool)
_MARKS[[0x22, 0xAB, 0xBB, *range(0x2018, 0x2020)]] = True
#: Lower case of each character that has one of a single character.
_FOLD = np.arange(_CODES, dtype=np.int32)
_FOLD[:0x10000] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x10000)]
_LEET = {ord(a): ord(b) for a, b in zip("013457@$", "oieastas", strict=True)}
_HASH = SpanHash(31)


def budget(term: str) -> int:
    """Errors that a misspelling of a term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def folded(text: str) -> str:
    """Lower case, character by character."""
    return _FOLD[np.frombuffer(text.encode("utf-32-le"), np.int32)].tobytes().decode("utf-32-le")


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and how many characters begin before each byte."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)
    return codes, np.append(0, np.cumsum((data & 0xC0) != 0x80))


class Automaton:
    """Terms and their misspellings as one deterministic table over classes of characters.

    ``hit[state]``: 0 no match, 1 exact, 2 misspelled. A stem matches any word that begins with it.
    """

    def __init__(self, words: list[str], stems: list[str]):
        used = sorted({ord(c) for t in [*words, *stems] for c in t})
        self.classes = np.zeros(_CODES, np.int16)  # 0: any character that no term has
        for k, c in enumerate(used, 1):
            self.classes[c] = k
        for a, b in _LEET.items():
            if not self.classes[a]:
                self.classes[a] = self.classes[b]
        children: list[dict[int, int]] = []
        ends: list[bool] = []
        stem_end: list[bool] = []
        most: list[int] = []

        def add(root: int, term: str, stem: bool) -> None:
            node = root
            for c in term:
                k = int(self.classes[ord(c)])
                if k not in children[node]:
                    children[node][k] = new(most[root])
                node = children[node][k]
            ends[node] = True
            stem_end[node] |= stem

        def new(errors: int) -> int:
            children.append({})
            ends.append(False)
            stem_end.append(False)
            most.append(errors)
            return len(children) - 1

        roots = {e: new(e) for e in (0, 1, 2)}
        for t in words:
            add(roots[budget(t)], t, False)
        for t in stems:
            add(roots[0], t, True)

        def closed(items: dict[int, int]) -> frozenset:
            todo = list(items.items())
            while todo:  # a letter of the term may be missing
                node, e = todo.pop()
                if e < most[node]:
                    for child in children[node].values():
                        if items.get(child, 99) > e + 1:
                            items[child] = e + 1
                            todo.append((child, e + 1))
            return frozenset(items.items())

        def step(state: frozenset, k: int) -> frozenset:
            out: dict[int, int] = defaultdict(lambda: 99)
            for node, e in state:
                if stem_end[node]:
                    out[node] = min(out[node], e)
                for c, child in children[node].items():
                    cost = e + (c != k)
                    if cost <= most[node]:
                        out[child] = min(out[child], cost)
                if e < most[node]:
                    out[node] = min(out[node], e + 1)
            return closed(dict(out))

        start = closed({r: 0 for r in roots.values()})
        number, queue, table, hit = {frozenset(): 0, start: 1}, [start], [[0] * (len(used) + 1)], [0]
        for state in queue:
            reach = {c for node, _ in state for c in children[node]}
            other = step(state, -1)
            row = []
            for k in range(len(used) + 1):
                nxt = step(state, k) if k in reach else other
                if nxt not in number:
                    number[nxt] = len(number)
                    queue.append(nxt)
                row.append(number[nxt])
            table.append(row)
            found = [e for node, e in state if ends[node]]
            hit.append(0 if not found else 1 if min(found) == 0 else 2)
        self.table = np.array(table, np.int32)
        self.hit = np.array(hit, np.int8)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hit class of each word."""
        classes = self.classes[codes]
        out = np.zeros(len(starts), np.int8)
        live = np.flatnonzero(ends > starts)
        at, state = starts[live], np.ones(len(live), np.int32)
        while len(live):
            state = self.table[state, classes[at]]
            at = at + 1
            over = at == ends[live]
            out[live[over]] = self.hit[state[over]]
            on = ~over & (state != 0)
            live, at, state = live[on], at[on], state[on]
        return out


class Lexicon:
    """Any number of terms, in automata of bounded size."""

    def __init__(self, words: list[str], stems: list[str], chunk: int = CHUNK):
        terms = sorted([*((w, False) for w in set(words)), *((t, True) for t in set(stems))])
        parts = [terms[k : k + chunk] for k in range(0, len(terms), chunk)]
        self.automata = [Automaton([t for t, stem in p if not stem], [t for t, stem in p if stem]) for p in parts]

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """1 for words that match exactly, 2 for misspelled ones, else 0."""
        out = np.zeros(len(starts), np.int8)
        for a in self.automata:
            found = a.match(codes, starts, ends)
            out = np.where((out == 0) | (found == 1), found, out)
        return out


def trimmed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without punctuation at either end."""
    starts, ends = starts.copy(), ends.copy()
    todo = np.arange(len(starts))
    while len(todo):
        todo = todo[starts[todo] < ends[todo]]
        todo = todo[_PUNCT[codes[starts[todo]]]]
        starts[todo] += 1
    todo = np.arange(len(starts))
    while len(todo):
        todo = todo[starts[todo] < ends[todo]]
        todo = todo[_PUNCT[codes[ends[todo] - 1]]]
        ends[todo] -= 1
    return starts, ends


def _spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of characters."""
    return _HASH.words(codes.view(np.uint8), starts * 4, ends * 4)


def _hashes(terms) -> np.ndarray:
    ends = np.cumsum([len(t) for t in terms])
    return _spans(np.frombuffer("".join(terms).encode("utf-32-le"), np.int32), np.append(0, ends[:-1]), ends)


COUNTS = ("plain_exact", "plain_misspelled", "quoted_exact", "quoted_misspelled", "direct")


class Scorer:
    """Counts hits by context and weighs them."""

    #: Bias, then for each of COUNTS: at least one, at least two, log of the number; last the share of words.
    PRIOR = np.array([-4.0, 1.5, 2.5, 1.5, 0.8, 1.8, 1.0, 0.2, 0.4, 0.2, 0.1, 0.2, 0.1, 0.3, 0.2, 0.2, 1.0])

    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray | None = None):
        self.lexicon = Lexicon(words, stems)
        self.words, self.stems = words, stems
        self.weights = self.PRIOR if weights is None else weights
        self.cues = [self._hashes(REPORTING), self._hashes(DIRECT)]

    @staticmethod
    def _hashes(terms: tuple[str, ...]) -> np.ndarray:
        return np.sort(_hashes(terms))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """COUNTS and the number of words for each text."""
        n = len(offsets) - 1
        out = np.zeros((n, len(COUNTS) + 1))
        byte_starts, byte_ends, first = word_spans(data, offsets)
        out[:, -1] = np.diff(first)
        codes, before = characters(data)
        raw_starts, raw_ends = before[byte_starts], before[byte_ends]
        low = _FOLD[codes]
        starts, ends = trimmed(low, raw_starts, raw_ends)
        kind = self.lexicon.match(low, starts, ends)
        hits = np.flatnonzero(kind)
        if not len(hits):
            return out
        row = np.searchsorted(first, hits, side="right") - 1
        in_word = np.append(0, np.cumsum(_MARKS[codes]))
        marked = in_word[raw_ends] > in_word[raw_starts]
        lo, hi = np.maximum(hits - WINDOW, first[row]), np.minimum(hits + WINDOW + 1, first[row + 1])
        quote_sum = np.append(0, np.cumsum(marked))
        # only the words in the windows are looked up
        near = np.zeros(len(starts) + 1, np.int32)
        np.add.at(near, lo, 1)
        np.add.at(near, hi, -1)
        at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        hashes = _spans(low, starts[at], ends[at])
        sums = []
        for cue in self.cues:
            flag = np.zeros(len(starts) + 1, np.int64)
            flag[at + 1] = np.isin(hashes, cue)
            sums.append(np.cumsum(flag))
        both = (quote_sum[hits] > quote_sum[lo]) & (quote_sum[hi] > quote_sum[hits + 1])
        own = marked[hits] & ((quote_sum[hits] > quote_sum[lo]) | (quote_sum[hi] > quote_sum[hits + 1]) | (in_word[raw_ends[hits]] - in_word[raw_starts[hits]] > 1))
        said = sums[0][hi] > sums[0][lo]
        quoted = both | own | (said & marked[hits])
        column = quoted * 2 + (kind[hits] == 2)
        np.add.at(out, (row, column), 1)
        direct = (sums[1][hi] > sums[1][lo]) & ~quoted
        np.add.at(out, (row[direct], 4), 1)
        return out

    @staticmethod
    def inputs(counts: np.ndarray) -> np.ndarray:
        c, words = counts[:, : len(COUNTS)], np.maximum(counts[:, -1:], 1)
        per = np.stack([c >= 1, c >= 2, np.log1p(c) * (c >= 2)], axis=2).reshape(len(c), -1)
        share = (c[:, :1] + 0.5 * c[:, 1:2]) / words
        return np.hstack([np.ones((len(c), 1)), per, np.minimum(share * 10, 1)])

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(counts) @ self.weights, -30, 30)))

    def fit(self, counts: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> None:
        """Newton steps to the most likely weights under a normal prior around PRIOR."""
        x, w = self.inputs(counts), self.PRIOR.copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + ridge * (w - self.PRIOR)
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step * min(1, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w


def _learned(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that occur in many surroundings of toxic rows and hardly in others."""
    counts = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return [], []
    def fold_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([folded(t or "") for t in block.column("text").to_pylist()], pa.string())], names=["text"])

    words = F.filter(
        F.transform(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")),
        lambda w: w != "",
    )
    seen = sample.where("label = 1").select("text").mapInArrow(fold_texts, "text string").select(words.alias("w")).selectExpr(
        "explode(transform(sequence(1, size(w)), i -> struct(element_at(w, i) as word, xxhash64(try_element_at(w, if(i > 1, i - 1, size(w) + 1)), try_element_at(w, i + 1)) as around))) as s"
    ).select("s.word", "s.around").distinct()
    by_word = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stems = (
        by_word.withColumn("term", F.explode(F.expr("transform(sequence(4, 8), k -> if(length(word) > k, left(word, k), null))")))
        .where("term is not null")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.max("n").alias("top"))
        .where("forms >= 4 and top < 0.7 * n")
        .select("term", "n", F.lit(True).alias("stem"))
    )
    share = toxic / (toxic + clean)
    least = max(4, int(np.ceil(np.log(0.01 / 1e5) / np.log(share)))) if share < 0.9 else 50
    found = (
        by_word.where(F.length("word") >= 3).select(F.col("word").alias("term"), "n", F.lit(False).alias("stem")).unionByName(stems)
        .where(F.col("n") >= least)
        .orderBy(F.desc("n"), "term").collect()  # of the labelled sample, which is bounded
    )
    if not found:
        return [], []
    terms = [r["term"] for r in found]
    hashes = _hashes(terms)
    whole = np.array([not r["stem"] for r in found])
    sizes = np.array([len(t) for t in terms])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        groups = [(size, full, np.flatnonzero((sizes == size) & (whole == full))) for size in np.unique(sizes) for full in (True, False)]
        for block in blocks(batches, "text"):
            data, offsets = column_bytes(block.column("text"))
            starts, stop, _ = word_spans(data, offsets)
            codes, before = characters(data)
            low = _FOLD[codes]
            starts, stop = trimmed(low, before[starts], before[stop])
            for size, full, members in groups:
                if not len(members):
                    continue
                s = starts[stop - starts == size] if full else starts[stop - starts > size]
                order = members[np.argsort(hashes[members])]
                h = _spans(low, s, s + size)
                at = np.minimum(np.searchsorted(hashes[order], h), len(order) - 1)
                total[order] += np.bincount(at[hashes[order][at] == h], minlength=len(order))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["k", "n"])

    clean_hits = np.zeros(len(terms))
    for r in sample.where("label = 0").select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        clean_hits[r["k"]] = r["n"]
    hits = np.array([r["n"] for r in found], float)
    good = hits / (hits + clean_hits) >= np.where(whole, 0.9, 0.97)
    kept_stems: list[str] = []
    for t in sorted((t for t, g, w in zip(terms, good, whole, strict=True) if g and not w), key=lambda t: (len(t), t)):
        if not any(t.startswith(s) for s in kept_stems):
            kept_stems.append(t)
    return [t for t, g, w in zip(terms, good, whole, strict=True) if g and w], kept_stems


def train_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Scorer:
    """Learn lexicon and weights from labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    usable = fold(F.col("doc_id"), 5) != 0
    sample = training_sample(docs, labels, "toxic", usable, limit).persist()
    words, stems = _learned(sample)
    words = list(dict.fromkeys([*INSULTS, *words]))
    scorer = Scorer(words, stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            c = scorer.counts(*column_bytes(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("label"), *(pa.array(x) for x in c.T)], names=["label", *COUNTS, "words"])

    schema = "label int, " + ", ".join(f"{c} double" for c in (*COUNTS, "words"))
    rows = sample.mapInArrow(run, schema).toPandas()
    sample.unpersist()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    if len(rows):
        scorer.fit(rows[[*COUNTS, "words"]].to_numpy(float), rows["label"].to_numpy(float))
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted and the counts of hits for every row."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)  # a few MB for each CHUNK of terms of the bounded sample
    names = ["doc_id", "held_out", "score", "predicted", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shipped.value
        for block in blocks(batches, "text"):
            c = s.counts(*column_bytes(block.column("text")))
            p = s.score(c)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 *(pa.array(x.astype(np.int64)) for x in c.T[: len(COUNTS)])], names=names,
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, " + ", ".join(f"{c} long" for c in COUNTS))
