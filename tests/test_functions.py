"""Edge cases of the expressions."""

import pytest
from pyspark.sql import functions as F

from gradeline.functions import display, matching, pipes, tokens, values


def column(spark, rows, expression, schema="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_number(spark):
    got = column(spark, ["12", " 7 ", "", "  ", "0x10", "1,234", "N/A", None, "1e3", ".5", "5.", "12d"], values.number(F.col("v")))
    assert got == [12, 7, 0, 0, 16, None, None, None, 1000, 0.5, 5, None]


def test_number_prefix(spark):
    got = column(spark, ["12.5m", "-3e2x", ".5", "5.", "", "  7 ", "0x10", "1,234", "N/A", "+4", "-.5e1z", "e5"], values.number_prefix(F.col("v")))
    assert got == [12.5, -300, 0.5, 5, None, 7, 0, 1, None, 4, -5, None]


def test_or_default(spark):
    assert column(spark, [None, 0.0, 3.0], values.or_default(F.col("v"), 4), "v double") == [4, 4, 3]


def test_truthy(spark):
    assert column(spark, ["true", "false", "0", "", None, "yes", "1"], values.truthy(F.col("v"))) == [True, False, False, False, False, True, True]
    assert column(spark, ["false"], values.truthy(F.col("v"), F.lit(True))) == [True]


def test_standard_diameter(spark):
    got = column(spark, [-5.0, 0.0, 1.0, 125.0, 412.0, 413.0, 825.0, 5000.0, None, float("nan")], pipes.standard_diameter(F.col("v")), "v double")
    assert got == [0, 0, 100, 100, 375, 450, 750, 1800, 100, 100]


def test_percent_slope(spark):
    assert column(spark, [1.1, 10.0, 11.0, 100.0, 101.0], pipes.percent_slope(F.col("v")), "v double") == [1.1, 10, 1.1, 10, 10.1]


@pytest.mark.parametrize(
    "a, b, match",
    [
        ("MH 1/O.P.", "MH1-OP", True), ("CB 3 (repl.)", "cb3", True), ("MH 1", "MH 10", False), ("(note)", "TANK", True),
        ("(note)", "TANK 1", False), ("STM MH 4", "MH 4", True), ("MH 4", "CB 4", False), ("TANK", "WATER TANK", True), ("", "", True),
    ],
)
def test_keys_match(spark, a, b, match):
    assert column(spark, [(a, b)], matching.keys_match(F.col("a"), F.col("b")), "a string, b string") == [match]


def test_null_keys_never_match(spark):
    assert column(spark, [(None, "x"), (None, None)], matching.keys_match(F.col("a"), F.col("b")), "a string, b string") == [False, False]


@pytest.mark.parametrize(
    "a, s, b, t, match",
    [
        (100.0, None, 95.0, None, False), (100.0, None, 95.1, None, True), (0.0, None, 0.0, None, True), (0.0, None, 1.0, None, False),
        (None, None, 0.0, None, False), (None, "1A", None, "1B", True), (None, "MH 1 ", None, "mh 1", True), (None, None, None, None, True),
        (12.0, None, None, "12.1m", True), (None, "abc", None, "ABD", False), (None, "2 CB", None, "2 MH", True), (-5.0, None, 5.0, None, False),
    ],
)
def test_values_match(spark, a, s, b, t, match):
    e = matching.values_match(F.col("a"), F.col("s"), F.col("b"), F.col("t"))
    assert column(spark, [(a, s, b, t)], e, "a double, s string, b double, t string") == [match]


def test_percent_error(spark):
    e = matching.percent_error(F.col("a"), F.col("b"))
    assert column(spark, [(100.0, 90.0), (0.0, 1.0), (None, 1.0), (1.0, None)], e, "a double, b double") == [10, None, None, None]


def test_overlap(spark):
    e = tokens.overlap(tokens.word_set(F.col("a"), 3), tokens.word_set(F.col("b"), 3))
    got = column(spark, [("check pipe sizes twice", "check pipe sizes once"), ("a b", "c d")], e, "a string, b string")
    assert got[0] == pytest.approx(0.75) and got[1] is None


def test_display(spark):
    assert column(spark, [1234.5, -1.0], display.currency(F.col("v")), "v double") == ["$1,234.50", "$-1.00"]
    assert column(spark, ["a-b_c.pdf.pdf", "plain"], display.project_name(F.col("v"))) == ["a b c.pdf", "plain"]
    assert column(spark, ["A/b (1).x"], display.safe_name(F.col("v"))) == ["Ab 1x"]
    assert column(spark, ["evaluation_scoreboard_2026-05-23_task1.csv", "x.csv"], display.scoreboard_date(F.col("v"))) == ["2026-05-23", ""]
    assert column(spark, [0.8, 0.6, 0.1], display.confidence_band(F.col("v")), "v double") == ["high", "medium", "low"]
    assert column(spark, [["a", "b"]], display.numbered_rules(F.col("v")), "v array<string>") == ["1. a\n2. b"]
