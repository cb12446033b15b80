from collections import defaultdict

import pytest

from gradeline.llm.components import components
from gradeline.llm.jaccard_join import jaccard_components, keep_one_of_each

from llm_soup import word_soup

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(texts):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, tokens(t)) for i, t in texts]
    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=repr)


def result(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("options", [{}, {"group": 3}, {"group": 2, "frequent": 2, "combined": 4}, {"group": 4, "frequent": 1, "combined": 0}, {"group_tokens": 40}])
def test_against_brute_force(make_docs, options):
    texts = [*word_soup(documents=90), (None, word_soup()[0][1]), (None, None), (10, "one"), (10, "one two three")]
    assert result(jaccard_components(make_docs(texts), **options)) == expected(texts)


def test_threshold_and_chains(make_docs):
    base = [f"t{i}" for i in range(204)]
    # 200 shingles; a change at the end costs one token each, so exactly 3/4 is reachable.
    texts = [(k, " ".join(base[: 204 - k * 12] + [f"z{k}_{j}" for j in range(k * 12)])) for k in range(9)]
    texts += [(20, " ".join(base[:7])), (21, " ".join(base[:8])), (22, "a b c d e"), (23, "A B c d E"), (24, "a b c d")]
    assert result(jaccard_components(make_docs(texts), group=3)) == expected(texts)


def test_large_group_of_near_copies(make_docs):
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base[: i % 50] + [f"x{i}"] + base[i % 50 + 1 :])) for i in range(120)]
    assert result(jaccard_components(make_docs(texts), group=10, frequent=20)) == expected(texts)


def test_long_texts_of_one_group(make_docs):
    """Some 20,000 tokens each and room for two: chunks hold the pivot and one more, of which some miss it."""
    base = [f"w{i}" for i in range(20_000)]
    texts = [(i, " ".join(base[: 20_000 - i * 800] + [f"y{i // 2}_{j}" for j in range(i * 800)])) for i in range(8)]
    assert result(jaccard_components(make_docs(texts), group_tokens=40_000)) == expected(texts)


def test_keep_one(make_docs, empty_docs):
    docs = make_docs([(5, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, None), (4, None), (None, "a b c d e f g h")])
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 3, 4, None]
    assert keep_one_of_each(empty_docs).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 200)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["component"]].add(r["node"])
    assert got == {0: set(range(41)), 90: {90, 95, 100}}
