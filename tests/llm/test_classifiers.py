import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import quality, toxicity
from gradeline.llm.labels import training_sample


def sentence(r, n):
    return " ".join(r.choice(["the", "of"]) if r.random() < 0.4 else "".join(r.choice(["an", "er", "ti", "lo", "ve"]) for _ in range(3)) for _ in range(n)).capitalize() + "."


def quality_rows():
    r = random.Random(1)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        t = " ".join(sentence(r, 12) for _ in range(5))
        if not good:
            t = [t.upper().replace(" ", "!! "), t.replace(" ", " | "), t.replace(" ", "### "), " ".join(w for w in t.split()[:9] for _ in range(8))][i // 3 % 4]
        rows.append((i, t, int(good)))
    return rows


def test_quality(spark, make_docs, empty_docs):
    rows = quality_rows()
    docs = make_docs([*[(i, t) for i, t, _ in rows], (None, None), (9000, ""), (9001, "w " * 60_000), (0, rows[0][1])])
    labels = spark.createDataFrame([*[(i, q, 0) for i, _, q in rows], (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, quality.train_quality(docs, labels)).collect()
    truth = {i: q for i, _, q in rows}
    known = [r for r in got if r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known if r["held_out"]]) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    model = quality.train_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, model).collect()} == {0.5}
    assert quality.score_quality(empty_docs, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_sample_keeps_the_held_out_fold_out(spark, make_docs):
    docs = make_docs([(i, str(i)) for i in range(200)])
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    got = {int(r["text"]) for r in training_sample(docs, labels, "quality", usable, 50).collect()}
    assert len(got) == 50 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in got)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def matched(matcher, words):
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    ends = np.cumsum([len(w) for w in words])
    return matcher.match(codes, np.append(0, ends[:-1]), ends)


def test_automaton_equals_edit_distance():
    r = random.Random(3)
    terms = ["scum", "idiot", "worthless", "abcab", "größen", "идиотка"]
    words = ["".join(r.choice("abcdiostuwhrlemö") for _ in range(r.randint(1, 10))) for _ in range(1500)]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w) + 1)
                how = r.random()
                if how < 0.34:
                    w.insert(k, r.choice("abcioxé"))
                elif how < 0.67 and len(w) > 1:
                    del w[min(k, len(w) - 1)]
                else:
                    w[min(k, len(w) - 1)] = r.choice("abcioxé")
            words.append("".join(w))
    words += ["vequ", "vequment", "veq"]
    for matcher in (toxicity.Automaton(terms, ["vequ"]), toxicity.Lexicon(terms, ["vequ"], chunk=2)):
        for w, hit in zip(words, matched(matcher, words), strict=True):
            near = min((d for t in terms if (d := edit_distance(w, t)) <= toxicity.budget(t)), default=None)
            want = 1 if near == 0 or w.startswith("vequ") else 2 if near else 0
            assert hit == want, w


def test_large_lexicon():
    r = random.Random(5)
    terms = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randint(3, 11))) for _ in range(350)})
    lexicon = toxicity.Lexicon(terms, [])
    assert len(lexicon.automata) > 2 and (matched(lexicon, terms) == 1).all()


def test_folding():
    assert toxicity.folded("ÀÉÎ ΓΔΣ ЖЩЯ ŁŠ İ ẞ") == "àéî γδσ жщя łš İ ß"


def test_contexts():
    scorer = toxicity.Scorer(["idiot", "moron"], [])
    def counts(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return scorer.counts(data, np.array([0, len(data)]))[0].tolist()

    assert counts("What an idiot, you MORON!")[:5] == [2, 0, 0, 0, 2]
    assert counts("An idi0t and an idjot")[:5] == [1, 1, 0, 0, 0]
    assert counts('They said "what an idiot" to him')[:5] == [0, 0, 1, 0, 0]
    plain, quoted = (scorer.score(np.array([counts(t)]))[0] for t in ("idiot moron idiot", 'he wrote: "idiot moron idiot" there'))
    assert plain > 0.5 > quoted


def test_terms_in_other_scripts_match_in_any_case(spark, make_docs):
    r = random.Random(9)
    rows = [(i, " ".join([sentence(r, 12), *(["ДУРАКИЩЕ", "σκουπίδι"] if i % 5 == 1 else []), sentence(r, 12)]), int(i % 5 == 1)) for i in range(400)]
    labels = spark.createDataFrame([(i, None, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    scorer = toxicity.train_toxicity(make_docs([(i, t) for i, t, _ in rows]), labels)
    assert {"дуракище", "σκουπίδι"} <= set(scorer.words)
    got = toxicity.score_toxicity(make_docs([(1, "Дуракище! ΣΚΟΥΠΊΔΙ."), (2, "дуракище дуракищи")]), scorer).collect()
    assert sorted((r["plain_exact"], r["plain_misspelled"]) for r in got) == [(1, 1), (2, 0)]


def test_toxicity_learns_terms(spark, make_docs, empty_docs):
    r = random.Random(6)
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        words = " ".join(sentence(r, 12) for _ in range(4)).split()
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "zorqu" + r.choice(["ment", "eur", "ique", "ait", "ons"]))
        rows.append((i, " ".join(words), int(bad)))
    docs = make_docs([*[(i, t) for i, t, _ in rows], (None, None), (9000, ""), (9001, "idiot moron " * 40_000), (9002, "He is an idiot and a mor0n, scvm and scum")])
    labels = spark.createDataFrame([(i, None, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    scorer = toxicity.train_toxicity(docs, labels)
    assert any("zorqu".startswith(s) or s.startswith("zorq") for s in [*scorer.stems, *scorer.words])
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, scorer).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.97
    assert got[9001]["predicted"] == 1 and got[9002]["predicted"] == 1 and got[9000]["predicted"] == 0 and got[None]["predicted"] == 0
    assert toxicity.train_toxicity(docs, labels.limit(0)).score(np.zeros((1, 6)))[0] < 0.5
    assert toxicity.score_toxicity(empty_docs, scorer).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])


def test_quality_scores_are_sums_of_table_entries(spark, make_docs):
    """Each document's score by plain loops over the tables at its own bins."""
    rows = quality_rows()
    docs = make_docs([(i, t) for i, t, _ in rows] + [(7000, None), (7001, "One two. Three!")])
    model = quality.train_quality(docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for i, text in [*[(i, t) for i, t, _ in rows], (7000, ""), (7001, "One two. Three!")]:
        data = text.encode()
        (x,) = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        at = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, x, strict=True)]
        logit = model.base
        for table, b in zip(model.tables, at, strict=True):
            logit += float(table[b])
        for j, k, table in model.pairs:
            logit += float(table[at[j]][at[k]])
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-9
        words = text.split()
        assert abs(x[quality.FEATURES.index("log_words")] - np.log1p(len(words))) < 1e-9
        assert abs(x[quality.FEATURES.index("lines")] - text.count("\n") / max(len(words), 1)) < 1e-9


def test_toxicity_scores_by_plain_loops(spark, make_docs):
    """Counts of texts without quotation by word for word comparison with the lexicon, and the scores of all counts."""
    r = random.Random(3)
    scorer = toxicity.Scorer(list(toxicity.INSULTS), ["zorb"])
    clean = ["river", "table", "window", "garden", "seven", "march"]
    texts = [(i, " ".join(r.choice([*clean, *clean, "idiot", "moron.", "(scum)", "zorbing", "Zorb!"]) for _ in range(r.randint(0, 30)))) for i in range(200)] + [(900, None), (901, "")]
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(make_docs(texts), scorer).collect()}
    exact = {"idiot", "moron", "scum"}
    for i, text in texts:
        words = [w.strip(".()!").lower() for w in (text or "").split()]
        hits = sum(w in exact or w.startswith("zorb") for w in words)
        counts = [got[i][c] for c in toxicity.COUNTS]
        assert counts[0] == hits and counts[1:] == [0] * (len(counts) - 1), text
        terms = [1.0]
        for c in counts:
            terms += [float(c >= 1), float(c >= 2), np.log1p(c) * (c >= 2)]
        terms.append(min((counts[0] + 0.5 * counts[1]) / max(len(words), 1) * 10, 1))
        score = 1 / (1 + np.exp(-sum(t * w for t, w in zip(terms, scorer.weights, strict=True))))
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(score >= 0.5)
