"""Every registered query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

from gradeline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def same(spark_rows, columns, result):
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(columns)
    order = sorted(columns)
    left = sorted((tuple(plain(r[c]) for c in order) for r in spark_rows), key=repr)
    at = [names.index(c) for c in order]
    right = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert left == right


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(name, spark, sf_dir, db):
    df = catalog.QUERIES[name](spark, sf_dir)
    same(df.collect(), df.columns, db.execute(catalog.ORACLE[name]))


def test_flagship(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_words_reads_whole_texts_of_all_rows(spark, tmp_path):
    middle = "filler " * 60 + "needle " + "padding " * 60
    spark.createDataFrame([(0, middle, "de"), (1, None, "en"), (3, "needle other", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "stuffing " * 60 + "needle " + "more " * 60), (1, "needle"), (2, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["shared"] for r in catalog.QUERIES["shared_words_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 0, 3: 1}
