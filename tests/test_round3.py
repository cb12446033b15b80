"""Queries and their SQL on tables of their own, for what a review found."""

import json
import time
from datetime import datetime
from fractions import Fraction

import duckdb

import __spark_entry__
from pyspark.sql import functions as F

from gradeline.operators import compare, layout, normalize, statistics
from gradeline.sources import records as record_source
from gradeline.sources import workbooks
from gradeline.sources.constants import DEFAULT_PARAMS


def both(spark, name, folder, tables):
    """Rows of a query and of its SQL over the given tables."""
    db = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return sorted(got, key=repr), sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=repr)


def test_rows_that_compete_for_many_found_rows_are_folded_fast(spark):
    """Two keys of 900 rows each that share found rows: they take turns."""
    n = 900
    truth = [(1, i, "old plate" if i % 2 else "cold plate") for i in range(2 * n)]
    found = [(1, 10_000 - i, "the old plate" if i % 2 else "COLD PLATE") for i in range(n)]
    t, f = (spark.createDataFrame(rows, "g long, ord long, key string") for rows in (truth, found))
    began = time.monotonic()
    got = {r["ord"]: r["match"] for r in compare.greedy_match(t, f, ["g"]).collect()}
    free = sorted((o, k) for _, o, k in found)
    for _, o, k in truth:
        at = next((i for i, (_, other) in enumerate(free) if k == "old plate" or other == "COLD PLATE"), None)
        assert got[o] == (None if at is None else free.pop(at)[0])
    assert time.monotonic() - began < 100


def test_currency_of_negative_zero(spark, tmp_path):
    values = [-0.0, 0.0, -0.001, -1234.5, 1234567.125, None]
    got, sql = both(spark, "currency_text", tmp_path, {"customer": spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double")})
    assert got == sql
    assert dict(got)[0] == "$-0.00" and dict(got)[1] == "$0.00"


def test_printed_means_don_t_depend_on_the_order_of_rows(spark, tmp_path):
    """Means right between two texts, from values whose sum as doubles is off."""
    rows, want = [], {}
    for user in range(300):
        cents = [(user * 37 + 11) % 100 + 10, (user * 53 + 29) % 100 + 10, 0]
        cents[2] = 300 * (2 + user % 3) + 150 - sum(cents)  # the mean is 2.5, 3.5 or 4.5
        if user % 2:
            cents.reverse()
        rows += [(len(rows) + i, datetime(2024, 1, 1, 12), user, "view", c / 100) for i, c in enumerate(cents)]
        mean = Fraction(sum(cents), 300)
        want[f"Project {user}"] = f"{int(mean + Fraction(1, 2))}%"
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    got, sql = both(spark, "printed_sections", tmp_path, {"events": events})
    assert got == sql
    assert {line.split(" │ ")[0].strip(): line.split(" │ ")[1].strip() for layout, line in got if layout == "board"} == want


def test_a_template_is_taken_apart_once(monkeypatch):
    """Further workbooks of a template are made without its trees, and say what was written."""
    template = workbooks.new_workbook({"S": {"A1": "a & b", "B1": ("formula", "C1*2"), "J11": ("shared", 0, "J11:J12", "C11*2"), "J12": ("shared", 0, None, None)}, "T": {"A1": 1.0}})
    workbooks.filled_template(template, [("S", "A1", 1.0, None, False)])
    monkeypatch.setattr(workbooks.ElementTree, "tostring", None)
    writes = [("S", "A1", None, " <new> & old ", False), ("S", "B1", 5.0, None, False), ("S", "J12", 7.0, None, True), ("S", "AA1", 2.5, None, False), ("S", "C3", 4.0, None, False)]
    made = workbooks.filled_template(template, writes)
    got = {(sheet, row, col): (kind, num, text) for _, sheet, row, col, kind, num, text in workbooks.cells_of(made)}
    assert got == {
        ("S", 1, "A"): ("str", None, " <new> & old "), ("S", 1, "AA"): ("num", 2.5, None), ("S", 3, "C"): ("num", 4.0, None), ("S", 12, "J"): ("num", 7.0, None),
        ("S", 1, "B"): ("formula_empty", None, None), ("S", 11, "J"): ("formula_empty", None, None), ("T", 1, "A"): ("num", 1.0, None),
    }


def test_complexity_order_reads_records_once(spark):
    """Each record is made once, however often its narrow key is read."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    lists = F.array(F.lit(1), F.lit(2))
    records = spark.range(100, numPartitions=4).select(F.udf(count, "string")(F.col("id").cast("string")).alias("project"), lists.alias("sewers"), lists.alias("manholes"))
    assert statistics.by_complexity(records).count() == 100
    assert seen.value == 100


def test_guarded_writes_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    row = F.col("id").cast("string")
    writes = spark.range(20, numPartitions=2).select(F.lit("S").alias("sheet"), F.udf(count, "string")(F.concat(F.lit("A"), row)).alias("ref"), (F.col("id") % 2 == 0).alias("force"))
    formulas = spark.createDataFrame([("S", "A1"), ("S", "A1"), ("S", "A2"), ("T", "A3")], "sheet string, ref string")
    assert {r["ref"] for r in layout.guarded(writes, formulas).collect()} == {f"A{i}" for i in range(20)} - {"A1"}
    assert seen.value == 20


def test_cells_of_raw_records_need_no_typed_records(spark):
    """cells of raw records are those of the typed ones, with odd leaves, and each response is parsed once."""
    long = [{"description": f"m{i}", "diameter": i * 7 if i % 3 else "oops", "addLE": "0x10", "depth": "0", "structureType": ""} for i in range(45)]
    texts = {
        "a": {
            "projectName": "", "jobNumber": 7, "date": "", "manholes": long, "sewers": [{"length": "abc", "slope": "11", "pipeDiameter": " "}, None, {"runLabel": "x", "slope": -0.0, "depth": " 1e1 "}],
            "catchbasins": {"groups": [{"quantity": "3", "depth": ""}, {"type": "ODD_CB", "quantity": 1}, {"type": "DOUBLE_CB", "wallThickness": "0", "grateEach": "x"}], "laborRates": {"scbLabor": "0", "dcbLabor": 12.5}},
            "watermain": [{"pipeDiameter": None, "ocSc": "0"}, {"pipeDiameter": "-3", "avgCover": "Infinity"}], "watermainSpecials": [{"thrustBlock": 0, "anodeCost": "1e999"}], "watermainValves": [{}],
        },
        "b": {"projectName": "named", "sewers": [], "manholes": None}, "c": [],
    }
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = [(k, json.dumps(v)) for k, v in texts.items()] + [("d", "no JSON"), ("e", None)]
    responses = spark.createDataFrame(rows, "project string, response_json string").repartition(2)
    params = F.struct(*[F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]).alias(s) for s, fields in DEFAULT_PARAMS.items()])
    records = lambda df: record_source.parsed(df).withColumn("params", params)
    typed = layout.cell_writes(normalize.normalized(records(responses), "2024-01-01").withColumn("params", params))
    made = layout.raw_writes(records(responses.withColumn("response_json", F.udf(count, "string")("response_json"))), "2024-01-01")
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert seen.value == len(rows)
    assert made.schema.simpleString() == typed.schema.simpleString() and got == sorted((tuple(r) for r in typed.collect()), key=repr)
    assert ("a", "SEWERS (1)", "F14", 1.1, None, False) in got and ("a", "MANHOLES (1)", "I50", 16.0, None, False) in got and not [r for r in got if r[2] == "I51"]
