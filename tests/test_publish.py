from pyspark.sql import functions as F

from gradeline.operators import learning, publish


def test_quote_lines(spark):
    q = spark.createDataFrame([("p", 100.5, 200.0, 0.0, 65.0, 2, 0.0, 0.1, 300.5, 330.55)], "project string, sewer_total double, manhole_total double, watermain_total double, sewer_length double, manhole_count int, watermain_length double, markup double, subtotal double, grand_total double")
    got = [(r["quantity"], r["description"], r["amount"]) for r in publish.quote_lines(q).orderBy("line").limit(6).collect()]
    assert got == [("65 m", "Sewer Installation", "$100.50"), ("2 ea", "Manholes & Catchbasins", "$200.00"), ("0 m", "Watermain Installation", "$0.00"), (None, "SUB TOTAL", "$300.50"), (None, "MARKUP (10%)", "$30.05"), (None, "GRAND TOTAL", "$330.55")]


def test_printed(spark):
    rows = spark.createDataFrame([("b" * 60, 50.0, 4, 2), ("a", None, 0, 0), ("c", 90.0, 10, 9)], "project string, overall double, total_cells int, matching_cells int")
    got = [r["line"] for r in publish.printed(rows).collect()]
    assert got[0].startswith("c ") and got[0].endswith("  90.0% (9/10)") and got[1].startswith("b" * 50 + " ") and "N/A" in got[2]


def test_tables_of_sections(spark):
    rows = spark.createDataFrame([("b" * 60, 12.5, None, 100.0, 0.4, 50.0, 4, 2, False), ("a", None, None, None, None, None, 0, 0, True)], "project string, mh_structures double, mh_catchbasins double, sewers double, watermain double, overall double, total_cells int, matching_cells int, failed boolean")
    board = [r["line"] for r in publish.board_lines(rows).collect()]
    assert board[0] == "b" * 50 + " │      13% │      N/A │     100% │       0% │    50.0% │      4"
    golden = sorted(r["line"] for r in publish.golden_lines(rows).collect())
    assert golden == ["a".ljust(50) + "│ ERROR  │ ERROR  │ ERROR  │ ERROR  │ ERROR", "b" * 60 + "│ 12.5%  │ N/A    │ 100.0% │ 0.4%   │ 50.0%"]


def test_lines_of_a_comparison(spark):
    reports = spark.createDataFrame([("p", "S", 40, 23, 1, 2), ("p", "T", 0, 0, 0, 0)], "project string, section string, total_cells long, matching_cells long, missing_rows long, extra_rows long")
    diffs = spark.createDataFrame([("p", "S", i, 11 + i, "Depth", "2", None, 12.34 if i == 1 else None) for i in range(1, 18)], "project string, section string, ord int, row int, column_name string, truth string, found string, pct_error double")
    got = [r["line"] for r in publish.comparison_lines(reports, diffs).orderBy("section", "place").collect()]
    assert got[:4] == ["  S", "     Accuracy: 57.5% (23/40)", "     Missing rows: 1 | Extra rows: 2", "     17 mismatches:"]
    assert got[4] == '        Row 12 [Depth]: truth="2" vs gen="null" (12.3% err)' and len(got) == 4 + 15 + 1 + 3 and got[19] == "        ... and 2 more"
    assert got[20:] == ["  T", "     Accuracy: N/A% (0/0)", "     Missing rows: 0 | Extra rows: 0"]


def test_workbook_projections(spark):
    cells = [("x", "MANHOLES (1)", 11, "B", None, "MH 1"), ("x", "MANHOLES (1)", 54, "B", None, "CB"), ("x", "MANHOLES (1)", 12, "C", 3.0, None), ("x", "MANHOLES (1)", 13, "D", 3.0, None),
             ("x", "SEWERS (1)", 15, "B", None, "STORM"), ("x", "SEWERS (1)", 14, "B", None, "A-B"), ("x", "SEWERS (1)", 14, "C", 5.0, None), ("x", "SEWERS (1)", 16, "B", None, "Video fee")]
    df = spark.createDataFrame(cells, "path string, sheet string, row int, col string, num double, text string")
    got = publish.dataset_records(df).first()
    assert [(r["row"], r["description"], r["topElevation"], r["structureType"]) for r in got["manholes"]] == [(11, "MH 1", 0.0, 1.0), (12, "", 3.0, 1.0), (54, "CB", 0.0, 1.0)]
    assert [(r["row"], r["runLabel"], r["length"]) for r in got["sewers"]] == [(14, "A-B", 5.0), (15, "STORM", 0.0), (16, "Video fee", 0.0)] and got["watermain"] == []
    one = publish.example_records(df).first()
    assert [(s["runLabel"], s["isLineItem"], s["length"]) for s in one["sewers"]] == [("A-B", False, 5.0), ("STORM", True, None)]
    assert one["projectName"] == "x" and [m["description"] for m in one["manholes"]] == ["MH 1"] and one["catchbasins"]["laborRates"]["dicbFC"] == 465.0 and one["catchbasins"]["groups"] == []


def test_catchbasins_of_examples(spark):
    cells = [("x", "MANHOLES (1)", 53, "C", 4.0, None), ("x", "MANHOLES (1)", 54, "C", 0.0, None), ("x", "MANHOLES (1)", 56, "C", None, "2"), ("x", "MANHOLES (1)", 56, "E", 3.0, None), ("x", "MANHOLES (1)", 2, "B", None, "Name"),
             ("x", "MANHOLES (1)", 59, "C", 210.0, None), ("x", "SEWERS (1)", 1, "A", None, "t"), ("y", "SEWERS (1)", 14, "B", None, "only sewers")]
    df = spark.createDataFrame(cells, "path string, sheet string, row int, col string, num double, text string")
    (one,) = publish.example_records(df).collect()
    assert one["projectName"] == "Name" and [(g["type"], g["quantity"], g["wallThickness"], g["depth"]) for g in one["catchbasins"]["groups"]] == [("SINGLE_CB", 4.0, 4.0, 2.2), ("DOUBLE_DITCH_INLET_CB", 2.0, 4.0, 3.0)]
    assert one["catchbasins"]["laborRates"]["scbLabor"] == 210.0


def test_learned_state_and_examples(spark):
    examples = spark.createDataFrame([(i, n, [(l,) for l in s]) for i, n, s in ((1, "A", ["run", "VIDEO ($25/m)"]), (2, "", ["x"]), (3, "B", []), (4, "C", []), (5, "D", []))], "ord int, projectName string, sewers array<struct<runLabel:string>>").withColumn("manholes", F.lit(None).cast("array<string>"))
    kept = learning.usable_examples(examples)
    assert [r["projectName"] for r in kept.collect()] == ["A", "B", "C"] and len(kept.first()["sewers"]) == 1
    state = publish.learned_state(learning.migrated({"promptAdditions": ["r"]}, "d"), kept)
    assert sorted(tuple(r) for r in state.collect()) == [("example", 1, "A"), ("example", 2, "B"), ("example", 3, "C"), ("prompt", 1, "r")]
    assert {r["kind"]: r["n"] for r in publish.state_counts(state).collect()} == {"example": 3, "prompt": 1}
    new = spark.createDataFrame([(1, "a"), (2, "Z"), (3, "z")], "ord int, projectName string")
    assert learning.addable_examples(kept, new).count() == 0  # three are the most
    assert [r["projectName"] for r in learning.addable_examples(kept.limit(2), new).collect()] == ["Z"]


def test_failing_order(spark):
    rows = spark.createDataFrame([("a", 95.0, 5), ("b", 10.0, 5), ("c", 0.0, 0), ("d", 10.0, 1), ("e", None, 3)], "project string, overall double, total_cells int")
    assert [r["project"] for r in learning.failing(rows).collect()] == ["b", "d"]
