"""Operators on small fixtures."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeline.operators import compare, costs, discovery, layout, learning, normalize, ordinals, scoreboard, statistics, validate
from gradeline.sources import records as raw_records
from gradeline.sources.constants import DEFAULT_PARAMS


def params_column():
    return F.struct(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in fields.items()]).alias(s) for s, fields in DEFAULT_PARAMS.items()])


def normal(spark, *records):
    rows = spark.createDataFrame([(f"p{i}", json.dumps(r)) for i, r in enumerate(records)], "project string, response_json string")
    return normalize.normalized(raw_records.parsed(rows), "2026-01-01")


def test_normalize_defaults_and_order(spark):
    r = normal(spark, {
        "manholes": [{"description": "MH 1", "topElevation": "101.5", "lowInvert": 0, "addMaterials": None, "diameter": 1210}, {"depth": "deep"}],
        "catchbasins": {"groups": [{"quantity": "3"}]},
        "sewers": [{"runLabel": "A", "slope": 11, "pipeDiameter": 412, "length": 10}, {"runLabel": "STORM", "isLineItem": True}],
        "watermain": [{"length": "5", "pipeDiameter": 0}], "watermainSpecials": [{}], "watermainValves": [{"boxCost": 0}],
    }).first()
    assert [m["item"] for m in r["manholes"]] == [1, 2]
    assert (r["manholes"][0]["topElevation"], r["manholes"][0]["lowInvert"], r["manholes"][0]["diameter"]) == (101.5, 0, 1200)
    assert r["manholes"][1]["depth"] is None and r["manholes"][1]["description"] == ""
    assert r["catchbasins"]["groups"][0].asDict() == {"type": "SINGLE_CB", "quantity": 3, "wallThickness": 4, "depth": 2.2, "grateEach": 0, "addMaterials": 0}
    assert r["catchbasins"]["laborRates"]["ddicbFC"] == 715
    assert (r["sewers"][0]["slope"], r["sewers"][0]["pipeDiameter"], r["sewers"][1]["isLineItem"]) == (1.1, 375, True)
    w, s, v = r["watermain"][0], r["watermainSpecials"][0], r["watermainValves"][0]
    assert (w["ocSc"], w["avgCover"], w["pipeDiameter"], s["anodeCost"], v["boxCost"], v["anodeCost"], v["laborPerValve"]) == (1.1, 1.8, 0, 100, 285, 150, 150)
    assert (r["confidence"], r["warnings"], r["date"], r["project"], r["templateType"]) == (0.5, [], "2026-01-01", "p0", "SHORT")


def test_normalize_empty_and_template(spark):
    rows = normal(spark, {}, {"sewers": [{"runLabel": str(i)} for i in range(40)]}, {"sewers": [{"runLabel": str(i)} for i in range(41)]}).orderBy("project").collect()
    assert rows[0]["manholes"] == [] and rows[0]["sewers"] == [] and rows[0]["catchbasins"]["groups"] == []
    assert [r["templateType"] for r in rows] == ["SHORT", "SHORT", "LONG"]


def test_combined_stages(spark):
    stages = [("p", "manholes", {"confidence": 0.8, "warnings": ["m"]}), ("p", "sewers", {"jobNumber": "7", "warnings": ["s"]}), ("q", "sewers", {"confidence": 0.8})]
    rows = spark.createDataFrame([(p, s, json.dumps(r)) for p, s, r in stages], "project string, stage string, response_json string")
    got = {r["project"]: r for r in normalize.normalized(normalize.combined(raw_records.parsed(rows), "2026-01-01"), "2026-01-01").collect()}
    assert got["p"]["confidence"] == pytest.approx(0.8 / 3) and got["p"]["warnings"] == ["m", "s"] and got["p"]["jobNumber"] == "7"
    assert got["q"]["confidence"] == pytest.approx(1.7 / 3)


def test_warnings_before_fees(spark):
    rows = normal(spark, {
        "sewers": [{"runLabel": "A", "length": 0, "depth": 12, "slope": 101}, {"runLabel": "F", "isLineItem": True, "length": -1}],
        "watermain": [{"sizeAndType": "W", "length": 0, "avgCover": 5}], "catchbasins": {"groups": [{"type": "DOUBLE_CB"}]},
    })
    r = normalize.with_fees(validate.with_warnings(rows)).first()
    assert [w.split(":")[0] for w in r["warnings"]] == ["Sewer A"] * 3 + ["Watermain W"] * 2 + ["Catchbasin group DOUBLE_CB"]
    assert "10.1%" in r["warnings"][2] and "12m" in r["warnings"][1]
    assert [(s["item"], s["runLabel"], s["addMaterials"]) for s in r["sewers"][2:]] == [(3, "VIDEO ($25/m)", 0), (5, "LAYOUT", 5000), (7, "AS BUILT", 5000)]
    assert normalize.with_fees(normal(spark, {})).first()["sewers"] == []


def test_quote(spark):
    record = {
        "sewers": [{"runLabel": "A", "length": 65, "pipeDiameter": 200, "depth": 2}, {"runLabel": "S", "isLineItem": True, "addMaterials": 9}],
        "manholes": [{"description": "divider"}, {"topElevation": 103, "lowInvert": 100, "addMaterials": 5, "addLE": 6}],
        "watermain": [{"length": 65, "pipeDiameter": 150}], "watermainSpecials": [{"quantity": 2, "costEach": 10}], "watermainValves": [{"quantity": 1}],
    }
    rows = normal(spark, record).withColumn("params", params_column())
    q = costs.quote(rows).first()
    assert q["sewer_total"] == pytest.approx(9300 + 65 * 35 + 1.2 * (2 + 0.1 + 0.25) * 65 * 10)
    manhole = lambda d: d * 500 + 400 + 110 * (15 + 5 * d) + 0.5 * d * 10
    assert q["manhole_total"] == pytest.approx(manhole(2) + manhole(3) + 11)
    assert q["watermain_total"] == pytest.approx(9300 + 65 * 51 + 2 * 110 + 585)
    assert (q["sewer_length"], q["manhole_count"], q["watermain_length"]) == (65, 2, 65)
    assert q["grand_total"] == pytest.approx(q["subtotal"] * 1.1)
    assert costs.quote(rows.withColumn("total_override", F.lit(0.0))).first()["grand_total"] == 0


def greedy(truth, found):
    """Pure Python: each true key takes the first free key that is equal."""
    free, out = list(range(len(found))), []
    for key in truth:
        pick = next((i for i in free if found[i] == key), None)
        if pick is not None:
            free.remove(pick)
        out.append(pick)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(["mh1", "mh2", "cb3"]), min_size=1, max_size=6), st.lists(st.sampled_from(["mh1", "mh2", "cb3"]), max_size=6)), min_size=1, max_size=4))
def test_greedy_match_is_one_to_one(spark, groups):
    t = spark.createDataFrame([(g, i, k) for g, (a, _) in enumerate(groups) for i, k in enumerate(a)], "g int, ord int, key string")
    f = spark.createDataFrame([(g, i, k) for g, (_, b) in enumerate(groups) for i, k in enumerate(b)], "g int, ord int, key string")
    got = {(r["g"], r["ord"]): r["match"] for r in compare.greedy_match(t, f, ["g"]).collect()}
    assert got == {(g, i): m for g, (a, b) in enumerate(groups) for i, m in enumerate(greedy(a, b))}


def test_compare_rows(spark):
    cell = lambda n=None, t=None: (n, t)
    schema = "project string, section string, ord int, key string, label struct<num:double,text:string>, length struct<num:double,text:string>"
    truth = spark.createDataFrame([("p", "s", 1, "MH 1", cell(t="MH 1"), cell(10.0)), ("p", "s", 2, "MH 2", cell(t="MH 2"), cell(0.0)), ("p", "s", 3, "MH 9", cell(t="MH 9"), cell(4.0))], schema)
    found = spark.createDataFrame([("p", "s", 1, "mh-2", cell(t="mh-2"), cell(None)), ("p", "s", 2, "mh1", cell(t="mh1"), cell(11.0)), ("p", "s", 3, "X 5", cell(t="X 5"), cell(1.0))], schema)
    cells, extra = compare.compare_rows(truth, found, ["project", "section"], ["label", "length"])
    r = compare.section_report(cells, ["project", "section"]).first()
    # MH 1: label differs as text and length is 10 % off; MH 2: blank length is not counted; MH 9: two missing cells.
    assert (r["total_cells"], r["matching_cells"], r["avg_pct_error"]) == (5, 0, 10.0)
    assert [x["key"] for x in extra.collect()] == ["X 5"]


def test_scoreboard(spark):
    rows = spark.createDataFrame([("a", 1, 50.0, 2, 1), ("a", 2, 50.0, 4, 2), ("b", 1, 90.0, 10, 9), ("c", 1, 0.0, 0, 0)], "project string, ord int, overall double, total_cells int, matching_cells int")
    best = scoreboard.best_of_each(rows, ["project"], "overall", [F.asc("ord")])
    assert sorted((r["project"], r["ord"]) for r in best.collect()) == [("a", 1), ("b", 1), ("c", 1)]
    s = scoreboard.summary(best).first()
    assert (s["projects"], s["mean_accuracy"], s["cell_accuracy"]) == (3, 70, pytest.approx(1000 / 12))
    for values, middle in (([1.0], 1), ([1.0, 2.0], 1), ([1.0, 2.0, 3.0], 2), ([1.0, 2.0, 3.0, 4.0], 2)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert df.agg(scoreboard.lower_median("v").alias("m")).first()["m"] == middle


def test_discovery(spark):
    files = [("p", "Civil plans.pdf", 5), ("p", "big.pdf", 900), ("p", "quote.pdf", 9999), ("p", "site plan detail.pdf", 50), ("p", "truth.xlsx", 1), ("q", "only.pdf", 1), ("r", "z.xlsx", 1), ("r", "a.pdf", 1)]
    df = spark.createDataFrame(files, "project string, name string, size long")
    forced = spark.createDataFrame([("r", "chosen.pdf")], "project string, name string")
    got = {r["project"]: (r["drawing"], r["truth"]) for r in discovery.projects(df, forced).collect()}
    assert got == {"p": ("Civil plans.pdf", "truth.xlsx"), "r": ("chosen.pdf", "z.xlsx")}
    outputs = spark.createDataFrame([("p", "eval_run_9.xlsx", 1), ("p", "eval_2026-01-01.xlsx", 1)], "project string, name string, size long")
    assert discovery.latest_output(outputs).first()["generated"] == "eval_run_9.xlsx"
    assert [r["project"] for r in discovery.without_output(df.select("project").distinct(), outputs).orderBy("project").collect()] == ["q", "r"]


def test_migrated_rules():
    r = learning.migrated({"promptAdditions": ["read all labels carefully", {"rule": "prefer storm sewers first"}]}, "2026-01-01")
    assert [x["rule"] for x in r.prompt] == ["read all labels carefully", "prefer storm sewers first"] and r.prompt[0]["addedBy"] == "migrated"
    assert learning.migrated({}, "x") == learning.Rules()


def test_suggestions_take_the_rule_of_their_action(spark):
    full = '{"action": "%s", "component": "sewers", "reasoning": "r", "promptAddition": "p", "heuristicRule": "h"}'
    texts = [full % a for a in ("PROMPT_TUNING", "ADD_HEURISTIC", "ADD_FEW_SHOT", "OTHER")] + ['```json\n{"action": "PROMPT_TUNING", "promptAddition": ""}\n```', "", None, "no idea", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "project int, suggestion_json string")
    got = {r["project"]: (r["action"], r["component"], r["rule"], r["error"]) for r in learning.suggestions(df).collect()}
    assert [got[i] for i in range(9)] == [
        ("PROMPT_TUNING", "sewers", "p", None), ("ADD_HEURISTIC", "sewers", "h", None), ("ADD_FEW_SHOT", "sewers", None, None), ("OTHER", "sewers", None, None), ("PROMPT_TUNING", None, None, None),
        (None, None, None, None), (None, None, None, None), (None, None, None, "no JSON"), (None, None, None, None),
    ]


def test_suggestions_are_folded_in_order(spark):
    texts = ["read all labels carefully", "prefer storm sewers first", "check manhole depth values", "count every single valve", "measure pipes between centres", "ignore dashed property lines"]
    rows = [("a", i, f"p{i}", "PROMPT_TUNING", "", t, None, None) for i, t in enumerate(texts)]
    rows += [
        ("a", 10, "p", "PROMPT_TUNING", "sewers", "Read ALL labels carefully!", None, None),  # the first rule has been pushed out, so it is new again
        ("a", 11, "p", "PROMPT_TUNING", None, "measure pipes between centres twice", None, None), ("a", 12, "p", "PROMPT_TUNING", None, None, None, None), ("a", 13, "p", "ADD_HEURISTIC", None, "grates cost nothing", None, None),
        ("a", 14, "p", "ADD_HEURISTIC", None, "grates cost nothing", None, None), ("a", 15, "p", None, None, None, "down", None), ("a", 16, "p", "ADD_FEW_SHOT", None, None, None, None),
        ("a", 17, "p", "ADD_FEW_SHOT", None, None, None, "NEW"), ("a", 18, "p", "ADD_FEW_SHOT", None, None, None, "old"), ("a", 19, "p", "ADD_FEW_SHOT", None, None, None, "third"), ("a", 20, "p", "ADD_FEW_SHOT", None, None, None, "fourth"),
        ("b", 1, "p", "OTHER", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "run string, ord long, project string, action string, component string, rule string, error string, example string").repartition(3)
    rules = spark.createDataFrame([("b", "prompt", 2, "second", None), ("b", "prompt", 1, "first", "sewers"), ("b", "heuristic", 1, "h", None), ("c", "prompt", 1, "x", None)], "run string, kind string, ord int, rule string, component string")
    examples = spark.createDataFrame([("a", "Old")], "run string, name string")
    got = {r["run"]: r for r in learning.applied_runs(df, rules, examples).collect()}
    a, b = got["a"], got["b"]
    assert [x["rule"] for x in a["prompt"]] == [*texts[2:], "Read ALL labels carefully!"] and [x["component"] for x in a["prompt"]] == ["general"] * 4 + ["sewers"]
    assert [x["rule"] for x in a["heuristics"]] == ["grates cost nothing"] and a["examples"] == ["old", "new", "third"]
    assert [(d["ord"], d["applied"], d["reason"]) for d in a["details"][6:]] == [
        (10, True, "prompt rule for sewers"), (11, False, "duplicate rule"), (12, False, "no actionable suggestion"), (13, True, "heuristic"), (14, False, "duplicate heuristic"), (15, False, "down"),
        (16, False, "missing sheets"), (17, True, "example"), (18, False, "known example"), (19, True, "example"), (20, False, "examples are full"),
    ]
    assert (a["applied"], a["rejected"]) == (10, 5) and (b["applied"], b["rejected"]) == (0, 1)
    assert [(x["rule"], x["component"]) for x in b["prompt"]] == [("first", "sewers"), ("second", None)] and [x["rule"] for x in b["heuristics"]] == ["h"] and set(got) == {"a", "b"}
    bare = learning.applied_runs(df, scoped=False).where("run = 'a'").first()
    assert {x["component"] for x in bare["prompt"]} == {None}


def test_rule_columns(spark):
    rules = spark.createDataFrame([([("check every pipe size twice", None), ("x", "sewers"), ("y", "general")],)], "rules array<struct<rule:string,component:string>>")
    kept = rules.select(learning.applies_to(F.col("rules"), "manholes").alias("k")).first()["k"]
    assert [k["rule"] for k in kept] == ["check every pipe size twice", "y"]
    dup = lambda t: rules.select(learning.is_duplicate(F.transform("rules", lambda r: r["rule"]), F.lit(t)).alias("d")).first()["d"]
    assert dup("Check every pipe size once") and not dup("check something else entirely") and not dup("a b")
    queue = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["a", "b", "c", "d"],)], "q array<string>")
    assert [r["x"] for r in queue.select(ordinals.pushed(F.col("q"), F.lit("n"), 3).alias("x")).collect()] == [["a", "b", "n"], ["b", "c", "n"], ["b", "c", "d", "n"]]


def test_gate(spark):
    rows = spark.createDataFrame([(0, 0), (3, 7), (2, 8), (0, 5)], "applied long, rejected long")
    assert [r["passed"] for r in learning.gate(rows).orderBy(F.monotonically_increasing_id()).collect()] == [False, True, False, False]


def test_statistics(spark):
    e = statistics.count_accuracy(F.col("p"), F.col("a"))
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 4), (9, 4)], "p int, a int")
    assert [r["x"] for r in df.select(e.alias("x")).collect()] == [1, 0, 0.75, -0.25]


def test_global_position(spark):
    df = spark.createDataFrame([(x,) for x in (5, 9000, -3, 7, 4096, 12345)], "k long")
    got = {r["k"]: r["position"] for r in ordinals.global_position(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_layout(spark):
    rows = normal(spark, {
        "manholes": [{"description": f"MH {i}", "depth": 0, "topElevation": 0} for i in range(45)],
        "catchbasins": {"groups": [{"type": "DOUBLE_CB", "quantity": 2}, {"type": "OTHER", "quantity": 9}]},
        "sewers": [{"runLabel": "S", "depth": 0, "length": 3}], "watermain": [{"length": 1}] * 9, "watermainSpecials": [{"specialName": "T"}] * 20,
    }).withColumn("params", params_column())
    cells = layout.cell_writes(rows)
    got = {(r["sheet"], r["ref"]): (r["num"], r["text"], r["force"]) for r in cells.collect()}
    assert got["MANHOLES (1)", "B50"][1] == "MH 39" and ("MANHOLES (1)", "B51") not in got
    assert got["MANHOLES (1)", "J11"] == (0.0, None, True) and ("MANHOLES (1)", "C11") not in got
    assert got["MANHOLES (1)", "C54"][0] == 2 and ("MANHOLES (1)", "C53") not in got and got["MANHOLES (1)", "F60"][0] == 715
    assert ("SEWERS (1)", "G14") not in got and got["SEWERS (1)", "C14"][0] == 3
    assert ("WATERMAIN (1)", "C20") not in got and got["WATERMAIN (1)", "B40"][1] == "T" and got["WATERMAIN (1)", "L5"][0] == 84
    formulas = spark.createDataFrame([("MANHOLES (1)", "J11"), ("MANHOLES (1)", "B11")], "sheet string, ref string")
    kept = {(r["sheet"], r["ref"]) for r in layout.guarded(cells, formulas).collect()}
    assert ("MANHOLES (1)", "J11") in kept and ("MANHOLES (1)", "B11") not in kept


def test_formulas():
    assert layout.shifted_formula("C11-D$7+SUM(E11:E12)", 4) == "C15-D$7+SUM(E15:E16)"
    assert layout.shifted_formula("LOG10(C1)", 1) == "LOG11(C2)"
    cells = {"J11": {"formula": "C11-D11"}, "J12": {"shared": "J11"}, "J13": {"shared": "J99"}}
    assert layout.expanded_formulas(cells) == {"J11": "C11-D11", "J12": "C12-D12"}
