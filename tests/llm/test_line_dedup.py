import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from gradeline.llm.line_dedup import LineIndex, dedup_lines, line_report

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key_of(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def expected(texts):
    first = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            k = key_of(line)
            first[k] = min(first.get(k, (1, 0)), (i is not None, i or 0), key=lambda x: x) if k in first else (i is not None, i or 0)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or first[key_of(x)] == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_soup(documents=80, seed=4):
    r = random.Random(seed)
    shared = [f"Line number {k} of many documents" for k in range(12)] + ["Straße Ähre ÄPFEL", "ÀÉÎ ÀÉÎ ÀÉ", "short one", "exactly 10", "\u00a0no break space\u00a0"]
    vary = lambda s: r.choice(["", " ", "\t", "\r"]) + r.choice([s, s.upper(), s.translate(LOWER)]) + r.choice(["", "  ", "\x0b\f", "\r"])
    texts = []
    for i in range(documents):
        lines = [vary(r.choice(shared)) if r.random() < 0.6 else r.choice(["", " ", "x", f"own line {i} {r.random()}"]) for _ in range(r.randint(1, 12))]
        texts.append((r.randint(-50, 200), "\n".join(lines)))
    return texts + [(300, None), (301, ""), (302, "\n\n"), (None, shared[0] + "\n" + shared[0]), (None, "x\n" + shared[0] + "\nnull id only"), (5000, "\n".join(f"Line number {k % 12} of many documents" for k in range(30_000)))]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_plain_loops(make_docs):
    texts = line_soup()
    texts += [texts[3], texts[3]]
    assert got(line_report(make_docs(texts))) == expected(texts)


def test_any_number_of_batches_and_levels(make_docs):
    texts = line_soup(40, 9)
    sha = lambda df: df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    for batches, fan_in in ((1, 2), (7, 2)):
        assert got(sha(dedup_lines(make_docs(texts), batches=batches, fan_in=fan_in))) == expected(texts)


def test_kept_text_and_empty_table(make_docs, empty_docs):
    found = {r["doc_id"]: r["kept"] for r in dedup_lines(make_docs([(1, "a shared line\nx"), (2, " A SHARED LINE \ny\nx")])).collect()}
    assert found == {1: "a shared line\nx", 2: "y\nx"}
    assert line_report(empty_docs).count() == 0


def test_runs_are_compacted_and_hold_each_key_once(spark):
    index = LineIndex(spark, 4, 2)
    for b in range(7):
        index.add(spark.range(b * 10, b * 10 + 30).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.lit(b).cast("long").alias("id")))
    assert [len(level) for level in index.levels] == [1, 1, 1]
    rows = index.owners().collect()
    assert len(rows) == len({bytes(r["key"]) for r in rows}) == 90
    assert sorted(r["first"] for r in rows) == sorted([0] * 30 + [b for b in range(1, 7) for _ in range(10)])
    with_new = spark.range(80, 100).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.lit(9).alias("first"))
    assert index.fresh(with_new).count() == 10
    index.close()


def test_runs_are_neither_moved_nor_sorted(spark):
    index = LineIndex(spark, 4, 8)
    keys = lambda a, b: spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.col("id"))
    for b in range(3):
        index.add(keys(b * 50, b * 50 + 100))
    from gradeline.llm.shared import settings

    with settings(spark, index.conf | {"spark.sql.adaptive.enabled": "false"}):
        plan = index.fresh(keys(0, 400).groupBy("key").agg(F.min("id").alias("first")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and len(re.findall(r"Sort \[", plan)) == 1
    index.close()


def test_plan_is_native(make_docs):
    plan = line_report(make_docs([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
