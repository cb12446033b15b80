import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gradeline.llm import buckets as B
from gradeline.llm import lm_score as L

from llm_soup import word_soup
from test_textops import colliding_words

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def test_base_is_exact(make_docs):
    texts = [*word_soup(documents=120), (10, "one"), (None, "one two"), (10, "unseen"), *enumerate(colliding_words() * 20, 500)]
    rows = [(i, (t or "").encode().translate(LOWER).split()) for i, t in texts]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(x for i, w in rows if not held(i) for x in [*w, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, held(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 5)) for i, w in rows], key=repr)
    got = L.score_texts(make_docs(texts), vocabulary=20).collect()
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got], key=repr) == want
    assert all(r["train_tokens"] == n for r in got)
    assert all(r["score"] < 0 for r in got)


def test_held_out_texts_with_structure_score_better_than_base(make_docs):
    r = random.Random(8)
    tongues = [[f"{a}{b}{t}" for a in "bdfgk" for b in "aeiou"] for t in ("na", "ro", "st")]
    texts = [(i, " ".join(r.choice(tongues[i % 3]) + r.choice(["", "", "."]) for _ in range(150))) for i in range(210)]
    held = [x for x in L.score_texts(make_docs(texts), vocabulary=40).collect() if x["held_out"]]
    assert len(held) > 10 and sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_empty(empty_docs):
    assert L.score_texts(empty_docs).count() == 0


def test_no_training_rows(make_docs):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = L.score_texts(make_docs([(i, "a b") for i in held])).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == pytest.approx(0) for r in got)


def test_probabilities_sum_to_one():
    words = np.sort(np.array([5 << 6, 9 << 6 | 1, 77 << 6 | 3], np.uint64))
    m = L.LogBilinear(words, np.array([5.0, 4.0, 3.0]), np.full(L.CLASSES, 6.0), np.full(L.CLASSES, 2.0))
    pairs = np.random.default_rng(1).integers(0, 5, (m.symbols, m.symbols)).astype(float)
    before = (pairs * m.table()).sum()
    m.train(pairs)
    table = m.table()
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-4)
    assert (pairs * table).sum() > before


def test_vocabulary_grows_beyond_the_frequent_words(make_docs, monkeypatch):
    """Rare pairs of words that only their own vectors can tell apart; contexts two places before count."""
    r = random.Random(3)
    pairs = [(f"left{i}a", f"right{i}o") for i in range(12)]
    texts = [(i, " ".join(w for _ in range(20) for w in r.choice(pairs))) for i in range(210)]
    models = []
    kept = L._normalise
    monkeypatch.setattr(L, "_normalise", lambda spark, model, *rest: (kept(spark, model, *rest), models.append(model)))
    held = [x for x in L.score_texts(make_docs(texts), vocabulary=4).collect() if x["held_out"]]
    m = models[0]
    assert len(m.words) == 24 and m.frequent == 4
    assert len(np.unique(m.target[0][4:24], axis=0)) == len(np.unique(m.context[1][4:24], axis=0)) == 20
    each = np.arange(m.symbols)
    for first in range(m.symbols):
        second = (first * 7 + 3) % m.symbols
        got = m.log_probabilities([np.full(m.symbols, first), np.full(m.symbols, second)], each)
        assert (10.0**got).sum() == pytest.approx(1, abs=1e-4)
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def plain_score(m, words, counts, rest_tokens, rest_words):
    """One document, one token and one symbol at a time."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    symbol = [int(m.symbols_of(np.array([w], np.uint64))[0]) for w in words] + [m.end]
    total = 0.0
    for k, s in enumerate(symbol):
        p = 0.0
        for d, share in enumerate(L.SHARES):
            b = symbol[k - d - 1] if k > d else m.end
            q, target, bias = m.given[d]
            coarse = soft(target @ m.context[d][b] + bias)
            each = coarse[m.coarse[s]]
            if m.frequent <= s < m.end:
                inside = np.flatnonzero(m.coarse[: m.end] == m.coarse[s])
                inside = inside[inside >= m.frequent]
                each *= soft(m.target[d][inside] @ q[m.coarse[b]] + m.bias[d][inside])[list(inside).index(s)]
            p += share * each
        if len(m.words) <= s < m.end:
            c = s - len(m.words)
            p *= (counts.get(words[k], 0) + 1) / (rest_tokens[c] + rest_words[c] + 1)
        total += math.log10(p)
    return total


def test_scores_match_a_plain_loop_and_hops_and_lanes_change_nothing(make_docs, monkeypatch):
    r = random.Random(12)
    words = [f"w{a}{b}" for a in "abcdefg" for b in "aeiou"]
    texts = [(i, " ".join(r.choice(words[: 5 + i % 30]) for _ in range(40))) for i in range(90)] + [(400, "rare words here"), (401, "Rare unseen x"), (402, None)]
    models = []
    kept = L._normalise
    monkeypatch.setattr(L, "_normalise", lambda spark, model, *rest: (kept(spark, model, *rest), models.append(model)))
    got = {x["doc_id"]: x["score"] for x in L.score_texts(make_docs(texts), vocabulary=6).collect()}
    m = models[0]
    hashed = {i: [int(x) for x in L._words(pa.record_batch({"text": [t or ""]}))[0]] for i, t in texts}
    counts = Counter(w for i, ws in hashed.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    assert 6 < len(m.words) < len(counts)
    own = set(m.words.tolist())
    rest_tokens, rest_words = Counter(), Counter()
    for w, n in counts.items():
        if w not in own:
            rest_tokens[w % L.CLASSES] += n
            rest_words[w % L.CLASSES] += 1
    for i, ws in hashed.items():
        assert got[i] == pytest.approx(plain_score(m, ws, counts, rest_tokens, rest_words), abs=2e-3), i
    monkeypatch.setattr(B, "HOPS_FROM", 2)
    again = {x["doc_id"]: x["score"] for x in L.score_texts(make_docs(texts), vocabulary=6, lane=30).collect()}
    assert all(again[i] == pytest.approx(got[i], abs=1e-2) for i in got)
