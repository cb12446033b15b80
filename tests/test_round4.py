"""Workbooks that are written where their cells are made, and read by columns."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gradeline.plans import books, catalog, records
from gradeline.sources import workbooks

TEMPLATE = workbooks.new_workbook({"S": {"A1": "kept <&>", "B2": ("formula", "A1*2"), "J11": ("shared", 0, "J11:J12", "C11*2"), "J12": ("shared", 0, None, None)}, "T": {"A1": 1.0}})
WRITE = "project string, sheet string, ref string, num double, text string, force boolean"


def batched(made, wanted=workbooks.Wanted()):
    return [tuple(r.values()) for batch in workbooks._cells_of_books(made, wanted) for r in batch.to_pylist()]


def test_a_project_is_written_without_being_dealt(spark):
    """rows that follow each other make one workbook each, across batches, and the last write of a cell counts."""
    writes = {
        "b": [("S", "A1", 1.0, None, False), ("S", "C3", None, " a & <b> ", False), ("S", "C3", 2.5, None, False), ("S", "B2", 9.0, None, False)],
        "a": [("S", "J12", 7.0, None, True), ("S", "J11", 7.0, None, True), ("S", "J11", 8.0, None, False), ("gone", "A1", 1.0, None, False), ("S", "AA1", float("nan"), None, None)],
        None: [("T", "B1", -0.5, None, False)], "c": [("T", "A1", None, "x", False)] * 9,
    }
    rows = spark.createDataFrame([(p, *w) for p, ws in writes.items() for w in ws], WRITE).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        made = workbooks.write_workbooks(rows, TEMPLATE, together=True)
        got = {r["project"]: list(workbooks.cells_of(bytes(r["content"]))) for r in made.collect()}
        dealt = {r["project"] for r in workbooks.write_workbooks(rows, TEMPLATE).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert got == {p: list(workbooks.cells_of(workbooks.filled_template(TEMPLATE, ws))) for p, ws in writes.items()} and dealt == set(writes)
    own = lambda p: {f"{s}!{c}{r}": (k, n, t) for _, s, r, c, k, n, t in got[p]}
    assert own("b") == {
        "S!A1": ("num", 1.0, None), "S!B2": ("formula_empty", None, None), "S!C3": ("num", 2.5, None), "S!J11": ("formula_empty", None, None),
        "S!J12": ("formula_empty", None, None), "T!A1": ("num", 1.0, None),
    }
    assert own("a")["S!J12"] == ("num", 7.0, None) and own("a")["S!J11"] == ("formula_empty", None, None) and own("a")["S!AA1"] == ("str", None, "")
    assert own(None)["T!B1"] == ("num", -0.5, None) and own("c")["T!A1"] == ("str", None, "x")


def test_plain_sheets_are_read_by_columns(monkeypatch):
    """sheets as they are written here are read without a tree."""
    made = workbooks.filled_template(TEMPLATE, [("S", "A3", None, "<&amp; \"'\n ü ]]>", False), ("S", "B3", -1.5e-7, None, False), ("S", "AB3", 1e300, None, False), ("T", "C1", None, "", False)])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None
    want, some = list(workbooks.cells_of(made, "p")), workbooks.Wanted().of_sheets(["S"]).rows(2, 3)
    few = list(workbooks.cells_of(made, "p", some))
    monkeypatch.setattr(workbooks, "cells_of", None)
    assert batched([("p", made)]) == want and batched([("p", made)], some) == few and len(few) == 4


@pytest.mark.parametrize("cells", [
    '<row r="1"><c r="A1" t="b"><v>1</v></c><c r="B1" t="e"><v>#N/A</v></c><c r="C1" s="2"/><c r="D1"><v>3</v></c></row>', '<row r="1"><c r="A1"><v> 1e2 </v></c></row>',
    '<row r="1"><c r="A1" t="inlineStr"><is><t>a&#233;</t></is></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
    '<row r="1"><!-- <c r="B1"><v>1</v></c> --><c r="A1"><v>1</v></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><t><![CDATA[<c r="B1"><v>2</v></c>]]></t></is></c></row>',
    '<row r="1"><c r="A1" t="inlineStr"><is><t>a\r\nb</t></is></c></row>', '\n <row r="1">\n  <c r="A1"><v>1</v></c>\n </row>', '<row r="1"><c t="str" r="A1"><f>B1</f><v>x</v></c></row>',
    '<row r="1"><c r="A1"><f t="shared" si="0"/><v>2</v></c><c r="B1" s="1"></c><c r="C1"><v>1e999</v></c></row>', '<row r="1"/><row r="2" ht="3"></row>', "",
])
def test_other_sheets_are_read_whole(cells):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(TEMPLATE)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>" if name.endswith("sheet1.xml") else old.read(name))
    want = list(workbooks.cells_of(out.getvalue(), "p"))
    assert sorted(batched([("p", out.getvalue())]), key=repr) == sorted(want, key=repr) and want[-1][1] == "T"


def test_round_trip_deals_no_cells(spark, sf_dir):
    """cells go from a record's row to its workbook and back within a task, and no response is stored in between."""
    assert catalog.QUERIES["workbook_round_trip"] is books.workbook_round_trip
    plan = books.workbook_round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "ExistingRDD" not in plan
    assert "Exchange" not in plan[: plan.index("from_json")]


def test_rounding_is_that_of_decimals(spark):
    values = [0.0, -0.0, 1.0, -3.0, 7.000000000000001, 0.8999999999999999, 0.0000005, 0.0000015, -0.0000025, 2.0000004999, 1e-9, -1e-9, 123456789.1234565, 1e9, -1.23456789e15, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [repr(r["v"]) for r in records._rounded(df).collect()]
    assert got == [repr(r["v"]) for r in df.select(F.round("v", 6).alias("v")).collect()]
