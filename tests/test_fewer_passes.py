"""Shared steps of the queries over records: what is read, dealt and looked at once."""

import re

from pyspark.sql import functions as F

from gradeline.functions import pipes
from gradeline.functions.values import number
from gradeline.operators import normalize, publish, sections
from gradeline.plans import records
from gradeline.sources import records as record_source
from gradeline.sources import workbooks

CELLS = "path string, sheet string, row int, col string, num double, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df.select("*"))))  # a plan that has not run yet


def test_diameters_are_found_without_lambdas_and_of_any_number(spark):
    values = [1e300, float("inf"), 1e18, 124.9, 125.0, 125.1, 1725.0, 1725.1, 1e6, -1.0, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", pipes.standard_diameter(F.col("v")).alias("d"))
    slow = [min(pipes.DIAMETERS, key=lambda d: (abs(v - d), d)) if v and v > 0 else 0 if v is not None else 100 for v in values]
    assert [r["d"] for r in got.orderBy("i").collect()] == slow
    assert "lambda" not in plan(got)


def test_odd_numbers_stay_what_they_were(spark):
    texts = ["12.5", " -8.50 ", "", " ", "0x10", "1e2", "Infinity", "inf", "NaN", "1d", "abc", "5.", ".5", "-", None, "\u00a07\u2003"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(number(F.col("t"))).collect()]
    assert got == [12.5, -8.5, 0.0, 0.0, 16.0, 100.0, float("inf"), None, None, None, None, 5.0, 0.5, None, None, 7.0]


def test_entries_that_are_no_objects_keep_their_place(spark):
    text = '{"sewers": [null, "x", {"runLabel": "a", "length": "3", "pipeDiameter": 160}, 5, {"length": null}]}'
    rows = sections.section(sections.parsed(spark.createDataFrame([("p", text)], "project string, response_json string")), "sewers", ["project"])
    assert [(r["item"], r["runLabel"], r["length"], r["pipeDiameter"]) for r in rows.orderBy("item").collect()] == [(1, "", None, None), (2, "", None, None), (3, "a", 3.0, 150.0), (4, "", None, None), (5, "", None, None)]
    assert "array<variant>" not in plan(rows)


def test_sections_of_sheets_are_dealt_once(spark):
    rows = [("w", "SEWERS (1)", r, c, n, t) for r, cells in ((14, [("B", None, "a"), ("C", 1.0, None)]), (16, [("C", 2.0, None)]), (20, [("B", 7.0, None), ("D", 3.0, None), ("Z", 1.0, None)]), (21, [("B", 0.0, None)])) for c, n, t in cells]
    got = workbooks.section_rows(spark.createDataFrame([*rows, (None, "SEWERS (1)", 14, "B", None, "lost")], CELLS))
    assert sorted((r["ord"], r["row"], r["key"], r["column"], r["num"]) for r in got.where("num is not null").collect()) == [(1, 14, "a", "C", 1.0), (2, 15, "7", "B", 7.0), (2, 15, "7", "D", 3.0)]
    assert dealt(got) == 1


def test_lists_of_workbooks_are_dealt_once(spark):
    cells = spark.createDataFrame([
        ("a", "MANHOLES (1)", 11, "B", None, "M1"), ("a", "MANHOLES (1)", 12, "C", 5.0, None), ("a", "SEWERS (1)", 14, "C", 2.0, None), ("a", "MANHOLES (1)", 2, "B", None, "Name"),
        ("a", "MANHOLES (1)", 54, "C", 3.0, None), ("b", "Notes", 1, "A", None, "x"),
    ], CELLS)
    sets, examples = publish.dataset_records(cells), publish.example_records(cells)
    got = {r["path"]: r for r in sets.collect()}
    assert [(m["row"], m["description"], m["topElevation"]) for m in got["a"]["manholes"]] == [(11, "M1", 0.0), (12, "", 5.0), (54, "", 3.0)]  # down to row 60
    assert len(got["a"]["sewers"]) == 1 and got["b"]["sewers"] == [] and got["b"]["watermain"] == []
    one = examples.collect()
    assert [(r["path"], r["projectName"], [m["row"] for m in r["manholes"]], [(g["row"], g["type"]) for g in r["catchbasins"]["groups"]], r["sewers"]) for r in one] == [("a", "Name", [11], [(54, "DOUBLE_CB")], [])]
    assert dealt(sets) == 1 and dealt(examples) == 1


def test_cells_of_records_are_stored_once_only(spark, sf_dir, monkeypatch):
    stored = []
    monkeypatch.setattr(records, "cut", lambda df: stored.append(df) or df)
    records._cells(spark, sf_dir)
    assert len(stored) == 1  # the responses


def test_counting_lists_does_not_read_their_leaves(spark):
    texts = ['{"sewers": [{"length": "1"}, {}], "catchbasins": {"groups": [{}]}}', '{"projectName": "n", "manholes": [{}]}', "no record"]
    raw = record_source.parsed(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "project string, response_json string"))
    sizes = lambda df: sorted(tuple(r) for r in df.select("project", *[F.size(c) for c in ("sewers", "manholes", "watermain", "watermainSpecials", "watermainValves", "catchbasins.groups")]).collect())
    few = normalize.listed(raw)
    assert sizes(few) == sizes(normalize.normalized(raw, "2024-01-01"))
    assert "lambda" not in plan(few)
