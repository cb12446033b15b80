import hashlib
import math
import random
import re
import zlib
from collections import Counter

from gradeline.llm import resampling as R

from llm_soup import word_soup


def features_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def expected(texts, target, share=25, seed=7, least=20, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(of(f) for _, x in texts for f in features_of(x)[1]), Counter(of(f) for x in target for f in features_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in texts:
        words, features = features_of(x)
        weight = sum(gain[of(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        ranks.setdefault(id(r), k)
    return sorted((tuple([*r[:4], ranks.get(id(r))]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts_and_target():
    r = random.Random(8)
    texts = [*word_soup(documents=50), (None, "Null id " * 15), (900, "naïve-ÄÖ ß 12x 3.5 don't\u3000CAP " * 9), (901, "one word"), (902, "!!! --- ..."), (903, "A" * 3000)]
    target = [" ".join(r.choices((texts[k][1] or "x").split() or ["x"], k=30)) for k in range(12)] + [None, "", "only here"]
    return texts, target


def test_against_plain_loops(spark, make_docs):
    texts, target = texts_and_target()
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, doc_id long")
    assert got(R.importance_resample(make_docs(texts), bench)) == expected(texts, target)


def test_small_blocks_shares_and_repeated_rows(spark, make_docs):
    texts, target = texts_and_target()
    texts += [texts[0], texts[0]]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    found = got(R.importance_resample(make_docs(texts), bench, share=100, seed=3, least_words=5, buckets=97, block_bytes=2000))
    assert found == expected(texts, target, 100, 3, 5, 97)


def test_empty_tables(spark, make_docs, empty_docs):
    nothing = spark.createDataFrame([], "text string")
    bench = spark.createDataFrame([("a b",)], "text string")
    assert R.importance_resample(empty_docs, bench).count() == 0
    texts = [(1, "a b c " * 10), (2, None)]
    assert got(R.importance_resample(make_docs(texts), nothing)) == expected(texts, [])


def test_hashes_each_distinct_string_once(spark, make_docs):
    texts = [(i, "the same words in all texts") for i in range(200)]
    stored = R._stored(make_docs(texts).repartition(5).select("doc_id", "text"), False)
    sent = R._sent(stored, 3)
    assert sum(len(R._large(r["lengths"])) for r in sent.collect()) == 5 * 11  # each block sends each feature once
    counts = R._answered(sent, 10_000).where("bucket is not null").agg({"s": "sum"}).first()[0]
    assert counts == 200 * 11
