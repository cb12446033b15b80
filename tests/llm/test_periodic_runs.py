import hashlib
import random
import re
import zlib

import numpy as np

from gradeline.llm.periodic_runs import collapse_runs, run_report, runs_of, smaller_suffixes

from llm_soup import word_soup


def suffixes_by_hand(w):
    n, out = len(w), []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if w[j:] < w[i:]), n)
        out.append((j, next((k for k in range(n) if j + k >= n or w[i + k] != w[j + k]), 0) if j < n else 0))
    return out


def runs_by_hand(w, least=24, periods=3):
    found = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            smallest = all(any(w[k] != w[k + d] for k in range(i, i + size - d)) for d in range(1, q))
            if size >= max(least, periods * q) and smallest:
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(r):
    symbols, n = r.choice([1, 2, 2, 3, 5]), r.randint(1, 60)
    w = [r.randrange(symbols) for _ in range(n)]
    if r.random() < 0.6:
        p = r.randint(1, 8)
        w = [w[i % min(p, n)] if r.random() > 0.03 else r.randrange(symbols) for i in range(n)]
    return w


def test_lyndon_arrays_and_runs_against_plain_loops():
    r = random.Random(11)
    for _ in range(1500):
        w = periodic(r)
        assert list(zip(*smaller_suffixes(w), strict=True)) == suffixes_by_hand(w)
        for least, periods in ((2, 2), (3, 3), (24, 3)):
            assert [tuple(x) for x in runs_of(np.array(w), least, periods).tolist()] == runs_by_hand(w, least, periods)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_comparisons_are_linear():
    class Word(int):
        compared = 0

        def __eq__(self, other):
            Word.compared += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    r, n = random.Random(5), 4000
    texts = [[0] * n, fibonacci(n), [r.randrange(2) for _ in range(n)], [r.randrange(50) for _ in range(80)] * (n // 80), ([0] * 50 + [1]) * (n // 51), [0, 1] * (n // 2)]
    for w in texts:
        Word.compared = 0
        smaller_suffixes([Word(x) for x in w])
        assert Word.compared <= 4 * n


def report_by_hand(doc_id, text):
    words = re.findall("[^\\x20\\x09-\\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    best = (None,) * 3
    for r in runs:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report(make_docs):
    r = random.Random(2)
    texts = [(i, t if len(t or "") < 5000 else t[:4000]) for i, t in word_soup(documents=40)]
    texts += [(1000 + k, " \n".join(str(x) for x in periodic(r)) * r.choice([1, 3])) for k in range(60)] + [(None, "é " * 30), (None, None), (1000, "a b c " * 20), (1000, "a b c " * 20)]
    got = sorted((tuple(x) for x in run_report(make_docs(texts)).collect()), key=str)
    assert got == sorted((report_by_hand(i, t) for i, t in texts), key=str)


def test_long_text_and_outputs(make_docs, empty_docs):
    body = "x " + "one two  three\n" * 50_000 + "end"
    found = {r["doc_id"]: r for r in collapse_runs(make_docs([(1, body), (2, "A a " * 6), (3, "")])).collect()}
    assert found[1]["collapsed"] == "x one two three end" and [tuple(x) for x in found[1]["runs"]] == [(1, 150_000, 3)]
    assert found[2]["runs"] == [] and found[3]["collapsed"] == ""
    assert collapse_runs(make_docs([(2, "A a " * 6)]), least=6).first()["collapsed"] == "A a"
    assert run_report(empty_docs).count() == 0
