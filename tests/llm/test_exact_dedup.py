import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from gradeline.llm.exact_dedup import drop_exact_copies, exact_dedup

from llm_soup import word_soup


def expected(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    first = lambda ids: min(ids, key=lambda i: (i is not None, i or 0))
    return {(i, hashlib.sha256(k.encode()).hexdigest()): (first(ids), len(ids)) for k, ids in groups.items() for i in ids}


def check(df, texts):
    got = df.collect()
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in got} == expected(texts)
    for digest in {r["text_sha256"] for r in got}:
        kept = [r for r in got if r["text_sha256"] == digest and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]


def test_copies_nulls_and_repeated_rows(make_docs):
    texts = [*word_soup(), (8, ""), (7, None), (None, "one"), (10, "one"), (10, "one")]
    check(exact_dedup(make_docs(texts)), texts)


def test_digest_hits_are_checked_on_full_bytes(make_docs):
    texts = [*word_soup(documents=20), (10, "one")]
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    check(exact_dedup(make_docs(texts), digest=weak), texts)


def test_several_batches_share_one_state(make_docs):
    texts = word_soup()
    check(exact_dedup(make_docs(texts).repartition(6), files_per_batch=1), texts)


def test_drop_keeps_columns(make_docs, empty_docs):
    docs = make_docs([(2, "a b"), (1, "a  b"), (3, None), (4, ""), (1, "a b"), (1, "c")])
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] if r["doc_id"] > 2 else r["text"].replace("  ", " ")) for r in kept.collect()) == [(1, "a b"), (1, "c"), (3, None)]
    assert drop_exact_copies(empty_docs).count() == 0 and exact_dedup(empty_docs).count() == 0


def test_plan_is_native(make_docs):
    plan = exact_dedup(make_docs([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bloom_filter_and_state_grow_with_the_input(spark, make_docs, monkeypatch):
    """Far more hits than the filter's least size, by a small setting: other texts stay out of the byte check's shuffle."""
    from gradeline.llm import exact_dedup as E

    assert int(E._bloom(100_000_000)["spark.sql.optimizer.runtime.bloomFilter.numBits"]) >= 800_000_000
    assert E._bloom(100_000_000)["spark.sql.optimizer.runtime.bloomFilter.maxNumItems"] == "100000000"
    monkeypatch.setattr(E, "_LEAST_HITS", 4)
    texts = [(i, f"copy {i % 40}") for i in range(120)] + [(1000 + i, f"single {i}") for i in range(300)]
    found = make_docs(texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(exact_dedup(found), texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    seen = []
    real = E.partitions
    monkeypatch.setattr(E, "partitions", lambda df: seen.append(real(df)) or 7)
    check(exact_dedup(found), texts)
    assert seen
