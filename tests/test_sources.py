"""Readers and writers."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gradeline.operators import compare, scoreboard
from gradeline.sources import files, records, scoreboards, workbooks
from gradeline.streaming import scoreboards as streams

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheets: dict[str, str], shared: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{sheets[n]}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
    return out.getvalue()


ROWS = (
    '<row r="11"><c r="B11" t="s"><v>0</v></c><c r="H11"><v>12.5</v></c><c r="I11" t="e"><v>#REF!</v></c>'
    '<c r="J11"><f t="shared" ref="J11:J12" si="0">C11-D11</f><v>3</v></c></row>'
    '<row r="12"><c r="B12"><v>0</v></c><c r="J12"><f t="shared" si="0"/><v>4</v></c></row>'
    '<row r="13"><c r="B13" t="s"><v>1</v></c><c r="H13" t="str"><f>A1</f><v>text</v></c><c r="K13"><f>B1</f></c></row>'
)
SHARED = "<si><t>MH 1</t></si><si><r><t>MH</t></r><r><t> 2</t></r></si>"


def test_cells(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.xlsx").write_bytes(workbook({"MANHOLES (1)": ROWS}, SHARED))
    workbooks.register(spark)
    for cells in (spark.read.format("workbook").load(str(tmp_path)), workbooks.read_cells(spark, str(tmp_path))):
        got = {f"{r['col']}{r['row']}": (r["kind"], r["num"], r["text"]) for r in cells.collect()}
        assert got["B11"] == ("str", None, "MH 1") and got["B13"] == ("str", None, "MH 2")
        assert got["H11"] == ("num", 12.5, None) and got["I11"][0] == "error" and got["J12"] == ("formula_num", 4.0, None)
        assert got["H13"] == ("formula_str", None, "text") and got["K13"][0] == "formula_empty"
    values = {f"{r['col']}{r['row']}" for r in workbooks.decoded(cells).collect()}
    assert "I11" not in values and "J12" in values
    rows = workbooks.section_rows(workbooks.decoded(cells)).where("column = 'H'").orderBy("ord").collect()
    assert [(r["key"], r["ord"], r["row"], r["num"]) for r in rows] == [("MH 1", 1, 11, 12.5), ("MH 2", 2, 12, None)]


def test_filters_reach_the_files(spark, tmp_path):
    sheets = {"MANHOLES (1)": {"B11": "MH 1", "B12": "MH 2", "C12": 3.5}, "SEWERS (1)": {"B14": " S 1 ", "J11": ("formula", "A1+1")}}
    (tmp_path / "a.xlsx").write_bytes(workbooks.new_workbook(sheets))
    workbooks.register(spark)
    cells = spark.read.format("workbook").load(str(tmp_path))
    got = lambda df: sorted((r["sheet"], f"{r['col']}{r['row']}", r["num"], r["text"]) for r in df.collect())
    assert got(cells.where("sheet = 'SEWERS (1)' and row >= 14")) == [("SEWERS (1)", "B14", None, " S 1 ")]
    assert got(cells.where("sheet in ('MANHOLES (1)', 'x') and row > 11 and row < 13 and col = 'C'")) == [("MANHOLES (1)", "C12", 3.5, None)]
    assert got(cells.where("row = 11")) == [("MANHOLES (1)", "B11", None, "MH 1"), ("SEWERS (1)", "J11", None, None)]  # a formula without a result
    assert got(workbooks.read_cells(spark, str(tmp_path), workbooks.Wanted().of_sheets(["SEWERS (1)"]).rows(12, 14))) == [("SEWERS (1)", "B14", None, " S 1 ")]


def test_the_calculation_chain_goes(spark):
    made = io.BytesIO(workbooks.new_workbook({"MANHOLES (1)": {"J11": ("formula", "A1")}}))
    with zipfile.ZipFile(made, "a") as z:
        z.writestr("xl/calcChain.xml", "<calcChain/>")
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="calcChain.xml"/></Relationships>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/xl/calcChain.xml" ContentType="x"/><Override PartName="/xl/workbook.xml" ContentType="y"/></Types>'
    assert b"calcChain" not in workbooks._without_chain(rels.encode()) and b"sheet1.xml" in workbooks._without_chain(rels.encode()) and b"workbook.xml" in workbooks._without_chain(types.encode())
    out = workbooks.filled_template(made.getvalue(), [("MANHOLES (1)", "J11", 2.0, None, True), ("MANHOLES (1)", "B11", None, "  x ", False)])
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert "xl/calcChain.xml" not in z.namelist()
    assert [(c[3], c[5], c[6]) for c in workbooks.cells_of(out)] == [("B", None, "  x "), ("J", 2.0, None)]


def test_template(spark):
    template = workbook({"MANHOLES (1)": ROWS, "SEWERS (1)": ""}, SHARED)
    writes = [("MANHOLES (1)", "J12", 9.0, None, True), ("MANHOLES (1)", "H13", 5.0, None, False), ("MANHOLES (1)", "C20", None, "new & old", False), ("SEWERS (1)", "C14", 2.5, None, False)]
    df = spark.createDataFrame([("p", *w) for w in writes], "project string, sheet string, ref string, num double, text string, force boolean")
    made = bytes(workbooks.write_workbooks(df, template).first()["content"])
    got = {(s, f"{c}{r}"): (k, n, t) for _, s, r, c, k, n, t in workbooks.cells_of(made)}
    assert got["MANHOLES (1)", "J12"] == ("num", 9.0, None) and got["MANHOLES (1)", "J11"][0] == "formula_num"
    assert got["MANHOLES (1)", "H13"] == ("formula_str", None, "text")
    assert got["MANHOLES (1)", "C20"] == ("str", None, "new & old") and got["SEWERS (1)", "C14"] == ("num", 2.5, None)
    xml = zipfile.ZipFile(io.BytesIO(made)).read("xl/worksheets/sheet1.xml").decode()
    assert "shared" not in xml


CSV = scoreboards.HEADER + '\n"A, B",50.0,N/A,1.5,2.0,40.0,10,4\n"C",N/A,N/A,N/A,N/A,0.0,0,0\n'


def test_scoreboard_files(spark, tmp_path):
    for day, task in (("2026-05-01", 0), ("2026-05-02", 0), ("2026-05-02", 1)):
        (tmp_path / f"evaluation_scoreboard_{day}_task{task}.csv").write_text(CSV)
    rows = scoreboards.read_scoreboards(spark, str(tmp_path))
    newest = scoreboard.latest_day(rows)
    assert newest.count() == 4
    best = scoreboard.best_of_each(newest, ["project"], "overall", [F.asc("ord")])
    s = scoreboard.summary(best, ("mh_structures", "mh_catchbasins")).first()
    assert (s["projects"], s["mean_accuracy"], s["cell_accuracy"], s["mh_structures"], s["mh_catchbasins"]) == (2, 40, 40, 50, 0)
    naive = scoreboards.read_scoreboards_naive(spark, str(tmp_path / "evaluation_scoreboard_2026-05-01_task0.csv")).collect()
    assert [(r["project"], r["overall"]) for r in naive] == [("A", 2.0), ("C", 0.0)]
    scoreboards.write_scoreboard(best, str(tmp_path / "out"))
    again = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("Project").collect()
    assert again[0]["Project"] == "A, B" and again[1]["Sewers"] == "N/A"


def test_scoreboard_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "evaluation_scoreboard_2026-05-01.csv").write_text(CSV)
    query = streams.run_summaries(streams.scoreboard_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got["projects"], got["mean_accuracy"]) == (2, 40)


def test_manifest_and_rules(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(b"abc")
    (tmp_path / "p" / "b.pdf").write_bytes(b"x" * 100)
    assert {(r["project"], r["name"], r["size"]) for r in files.manifest(spark, str(tmp_path)).collect()} == {("p", "a.pdf", 3), ("p", "b.pdf", 100)}
    small = files.drawings(spark, str(tmp_path), 50)
    assert [r["path"].rsplit("/", 1)[1] for r in small.collect()] == ["a.pdf"]
    store = files.content_keys(small).select("sha256")
    every = files.drawings(spark, str(tmp_path))
    assert files.uncached(every, store, 1).count() == 1
    (tmp_path / "rules.json").write_text(json.dumps({"version": 2, "promptAdditions": [{"rule": "r", "component": "sewers"}], "heuristics": []}))
    state = files.read_rules(spark, str(tmp_path / "rules.json"), "2026-01-01")
    assert files.rules_rows(spark, state).first()["component"] == "sewers"
    assert files.read_rules(spark, str(tmp_path / "none.json"), "2026-01-01").prompt == ()


def test_replay_and_client(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"project": "p", "stage": "sewers", "response_json": '{"sewers":[{"length":"3"}]}'}) + "\n")
    raw = records.parsed(records.read_replay(spark, str(tmp_path / "r.json"))).first()
    assert raw["raw"]["sewers"][0]["length"] == "3"
    (tmp_path / "one.json").write_text(json.dumps([{"projectName": "A", "manholes": []}, {"projectName": "B", "sewers": [{"length": 2}]}]))
    got = records.read_records(spark, str(tmp_path / "one.json")).orderBy("project").collect()
    assert [r["project"] for r in got] == ["A", "B"] and got[1]["raw"]["sewers"][0]["length"] == "2"

    def client():
        def call(project, stage, content):
            if stage == "watermain":
                raise ValueError("bad")
            return json.dumps({"warnings": [stage]})

        return call

    drawings = spark.createDataFrame([("p", b"x")], "project string, content binary")
    out = {r["stage"]: r for r in records.extract_with(drawings, client).collect()}
    assert out["watermain"]["error"] == "bad" and json.loads(out["sewers"]["response_json"]) == {"warnings": ["sewers"]}


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 resource exhausted")
        return "ok"

    assert records.with_retry(call, sleep=waits.append) == "ok" and waits == [10, 20]
    with pytest.raises(ValueError):
        records.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)


def test_workbook_comparison(spark, tmp_path):
    """Two workbooks from files to a report."""
    for side, value in (("truth", 10), ("gen", 10.2)):
        (tmp_path / side).mkdir()
        sheet = f'<row r="14"><c r="B14" t="str"><v>A-B</v></c><c r="C14"><v>{value}</v></c></row>'
        (tmp_path / side / "x.xlsx").write_bytes(workbook({"SEWERS (1)": sheet}))
    sides = []
    for side in ("truth", "gen"):
        rows = workbooks.section_rows(workbooks.decoded(workbooks.read_cells(spark, str(tmp_path / side)))).withColumn("project", F.lit("p"))
        wide = rows.groupBy("project", "section", "ord", "key").agg(*[F.max(F.when(F.col("column") == c, F.struct("num", "text"))).alias(c) for c in "BC"])
        sides.append(wide)
    cells, extra = compare.compare_rows(*sides, ["project", "section"], ["B", "C"])
    r = compare.section_report(cells, ["project", "section"]).first()
    assert (r["total_cells"], r["matching_cells"], round(r["avg_pct_error"], 6)) == (2, 2, 2.0) and extra.count() == 0
