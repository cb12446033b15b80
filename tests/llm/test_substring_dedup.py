import hashlib

from gradeline.llm import buckets as B
from gradeline.llm import substring_dedup as S

from llm_soup import word_soup
from test_textops import colliding_words


def expected(texts):
    words = [(-(1 << 63) if i is None else i, i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for key, _, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), key)
    out = []
    for key, i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(make_docs):
    texts = [*word_soup(documents=80), (None, word_soup()[0][1]), (10, "one"), (13, word_soup()[3][1])]
    got = S.dedup_substrings(make_docs(texts), with_text=True).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=repr) == expected(texts)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_boundaries(make_docs):
    p = [f"w{i}" for i in range(40)]
    texts = [
        (1, " ".join(p)), (2, "x " + " ".join(p[5:18]) + " y"), (3, "x x " + " ".join(p[5:17]) + " y"), (4, " ".join(p[:13] + p[:13])),
        (5, "\n".join(p[27:])), (6, "X " * 30), (7, "X " * 13), (8, "q " * 12),
    ]
    got = S.dedup_substrings(make_docs(texts)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=repr) == expected(texts)


def test_two_hops_and_patterned_words(make_docs, monkeypatch):
    monkeypatch.setattr(B, "HOPS_FROM", 2)
    one, two = colliding_words()
    texts = [*word_soup(documents=40), (300, f"{one} " * 20), (301, f"{two} " * 20), (302, f"x {two} " + f"{one} " * 13)]
    got = S.dedup_substrings(make_docs(texts)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=repr) == expected(texts)


def test_a_passage_of_every_document(make_docs):
    licence = " ".join(f"clause{i}" for i in range(30))
    texts = [(i, f"own{i} text{i} {licence} end{i}") for i in range(400)]
    got = {r["doc_id"]: r for r in S.dedup_substrings(make_docs(texts).repartition(5)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 30 for i in range(1, 400))


def test_empty(empty_docs):
    assert S.dedup_substrings(empty_docs).count() == 0


def test_difference_cover():
    for i in range(7):
        for j in range(7):
            assert any((i + k) % 7 in S.COVER and (j + k) % 7 in S.COVER for k in range(S.PERIOD))
    assert S.ANCHOR + S.PERIOD - 1 == S.WINDOW
