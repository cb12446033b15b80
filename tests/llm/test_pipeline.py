import random
import re

import pytest

import corpus_pipeline as C
from gradeline.llm import quality
from gradeline.llm.decontaminate import canonical
from test_jaccard_join import expected as components_of

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "er", "ti", "lo", "ve", "su"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(4)]
    docs, labels = [], []
    for i in range(150):
        t = text(r.randint(20, 60))
        good = i % 4 > 0
        if not good:
            t = t.replace(" ", "### ")
        elif i % 9 == 0 and i:
            t = docs[i - 1][1].replace(" ", "  ")
        elif i % 10 == 0:
            w = docs[i - 1][1].split()
            w[-1] = "changed"
            t = " ".join(w)
        elif i % 13 == 0:
            t = text(10) + " " + items[i % 4][1].upper() + " " + text(10)
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages_against_brute_force(spark, tables):
    path, docs, items = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train_quality(frame, spark.read.parquet(f"{path}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score_quality(frame, model).collect() if r["predicted"] == 1}
    kept = [(i, t) for i, t, *_ in docs if i in good]
    assert 0 < len(kept) < len(docs)
    seen = {}
    for i, t in sorted(kept):
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    kept = [(i, t) for i, t in kept if i in seen.values()]
    kept = [(i, t) for i, t in kept if dict((a, c) for a, _, c in components_of(kept))[i] == i]
    kept = [(i, t) for i, t in kept if not any(canonical(x) in canonical(t) for _, x in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=C.encode_decode.__globals__["default_model_path"]())
    want = {i: len(library.encode(t or "")) for i, t in kept}
    got = {r["doc_id"]: r["n_tokens"] for r in C.run(spark, path).collect()}
    assert got == want
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, frame, path).columns == frame.columns


def written(spark, folder, rows, schema, items=()):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    from conftest import SCHEMA, rows_of

    r = random.Random(4)
    text = lambda n, k: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10_000)}{k}" for _ in range(n))
    body, item, long = text(60, "x"), text(20, "i"), text(60_000, "l")
    near = body.split()
    near[-1] = "changed"
    texts = [
        (1, body), (1, body), (2, body.replace(" ", "\t ")), (3, " ".join(near)), (None, text(30, "n")), (None, None), (5, ""), (6, " \n "), (7, long), (8, text(10, "p") + " " + item.upper() + " " + text(10, "q")), (9, text(40, "z")),
    ]
    path = written(spark, tmp_path, rows_of(texts), SCHEMA, [(1, item), (2, None), (3, "")])
    library = sentencepiece.SentencePieceProcessor(model_file=C.encode_decode.__globals__["default_model_path"]())
    want = sorted(((i, len(library.encode(t or ""))) for i, t in texts if (i, t) in [(1, body), (None, texts[4][1]), (None, None), (6, " \n "), (7, long), (9, texts[10][1])]), key=str)
    want.remove((1, len(library.encode(body))))  # the row is there twice and stays once
    got = sorted(((x["doc_id"], x["n_tokens"]) for x in C.run(spark, path).collect()), key=str)
    assert got == want
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, frame, path).columns == frame.columns


def test_empty_table(spark, tmp_path):
    from conftest import SCHEMA

    assert C.run(spark, written(spark, tmp_path, [], SCHEMA)).count() == 0
