"""Steps whose work for each row was too much on large tables."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from gradeline.functions.matching import values_match
from gradeline.operators import compare, normalize, validate
from gradeline.plans import records
from gradeline.sources import records as record_source


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_rows_are_paired_once_for_cells_missing_and_extra_rows(spark, monkeypatch):
    stored, cut = [], compare.cut
    monkeypatch.setattr(compare, "cut", lambda df: stored.append(df.columns) or cut(df))
    cell = lambda n: (float(n), None)
    schema = "project string, ord int, key string, length struct<num:double,text:string>"
    truth = spark.createDataFrame([("p", i, f"MH {i}", cell(i)) for i in range(10)], schema)
    found = spark.createDataFrame([("p", i, f"mh-{i} (built)", cell(i + 4 * (i == 5))) for i in range(2, 12)], schema)
    cells, extra = compare.compare_rows(truth, found, ["project"], ["length"])
    r = compare.section_counts(cells, extra, ["project"]).first()
    assert (r["total_cells"], r["matching_cells"], r["missing_rows"], r["extra_rows"]) == (9, 7, 2, 2)  # row 0 has a blank cell, row 1 no partner
    assert ["project", "ord", "match"] in stored


def test_only_rows_with_the_same_digits_meet(spark):
    schema = "g int, ord int, key string"
    truth = spark.createDataFrame([(1, 1, "Run 1"), (1, 2, "Run 12"), (1, 3, None), (1, 4, "run"), (1, 5, "a run 1")], schema)
    found = spark.createDataFrame([(1, 7, "RUN 1 (built)"), (1, 8, "a Run-12"), (1, 9, None), (1, 10, "the run"), (1, 11, "run (1)")], schema)
    matched = compare.greedy_match(truth, found, ["g"])
    assert {r["ord"]: r["match"] for r in matched.collect()} == {1: 7, 2: 8, 3: None, 4: 10, 5: None}
    joins = [line for line in plan(matched).splitlines() if "Join" in line]
    assert joins and all("_digits" in line for line in joins)


def test_cells_of_numbers_are_compared_without_the_code_for_texts(spark):
    rows = [(1.0, None, 1.04, None), (1.0, None, 1.06, None), (0.0, None, 0.0, None), (None, None, None, None), (1.0, None, None, None), (1.0, None, None, " 1.01 m"), (2.0, None, None, "two"), (None, "A", None, "\ta"), (None, "12 mm", None, "12.3"), (None, "x", None, "x"), (None, "", None, "")]
    df = spark.createDataFrame(rows, "a double, s string, b double, t string")
    same = df.select(values_match(F.col("a"), F.col("s"), F.col("b"), F.col("t")).alias("same"))
    assert [r["same"] for r in same.collect()] == [True, False, True, True, False, True, False, True, True, True, True]
    assert plan(same).count("regexp_extract") <= 4  # two texts, each looked at once with its check for emptiness


def test_warnings_read_only_the_fields_of_their_rules(spark, sf_dir):
    texts = [
        '{"sewers": [{"runLabel": "a", "length": "0", "slope": "300", "depth": "0.1", "typeClass": "x"}, {"isLineItem": true, "length": 0}], "warnings": ["w"], "manholes": [{"depth": "1"}]}',
        '{"watermain": [{"sizeAndType": "b", "avgCover": "9"}], "catchbasins": {"groups": [{"type": "", "quantity": "0"}], "laborRates": {}}}', "no record", "{}",
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "project string, response_json string")
    found = lambda df: sorted(tuple(r) for r in validate.with_warnings(df).select("project", "warnings").collect())
    few = normalize.normalized(record_source.parsed(rows, schema=record_source.schema_of(validate.FIELDS)), "2024-01-01", only=validate.FIELDS)
    assert found(few) == found(normalize.normalized(record_source.parsed(rows), "2024-01-01"))
    made = records.record_warnings(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "typeClass" not in made
