import json

from pyspark.sql import functions as F

from gradeline.functions import leaves
from gradeline.operators import sections

LEAVES = [
    # JSON, number, text, truth
    ("12.50", 12.5, "12.5", True), ('"12.5m"', None, "12.5m", True), ('"0x1F"', 31.0, "0x1F", True), ('""', 0.0, "", False), ("false", 0.0, "false", False), ('"false"', None, "false", True),
    ("true", 1.0, "true", True), ("null", None, None, False), ("0", 0.0, "0", False), ('"0"', 0.0, "0", True), ("-3e2", -300.0, "-300", True), ("[]", 0.0, "", True), ("[1, null]", None, "1,", True),
    ('["4"]', 4.0, "4", True), ("{}", None, "[object Object]", True), ("1000000", 1000000.0, "1000000", True), ("0.00010", 0.0001, "0.0001", True),
]


def test_leaves_keep_their_type(spark):
    df = spark.createDataFrame([(i, '{"a": {"b": %s}}' % j) for i, (j, *_) in enumerate(LEAVES)], "i int, j string").select("i", leaves.leaf(F.parse_json(F.col("j")), "a.b").alias("x"))
    k, t = leaves.kind(F.col("x")), leaves.shown(F.col("x"))
    got = {r["i"]: r for r in df.select("i", leaves.number_of(k, t).alias("n"), leaves.text_of(k, t).alias("t"), leaves.truth_of(k, t).alias("y"), leaves.text_or(k, t, "else").alias("d")).collect()}
    for i, (j, n, t, y) in enumerate(LEAVES):
        assert (got[i]["n"], got[i]["t"], got[i]["y"], got[i]["d"]) == (n, t, y, t if y else "else"), j


def test_sections_and_heads(spark):
    record = {
        "confidence": "0.8", "date": "", "catchbasins": {"groups": [{"quantity": "3"}, {"type": 0, "depth": True}], "laborRates": {"scbLabor": "210"}},
        "sewers": [{"runLabel": 12, "isLineItem": "false", "pipeDiameter": "825", "slope": 11}, {"isLineItem": False, "length": "0", "pipeDiameter": None, "slope": "x"}, "no object"],
        "watermain": [{"pipeDiameter": "oops"}], "manholes": {"not": "a list"},
    }
    df = sections.parsed(spark.createDataFrame([("p", json.dumps(record)), ("q", "no JSON"), ("r", None), ("s", "[1]")], "project string, response_json string"))
    head = {r["project"]: r for r in sections.heads(df, "2024-01-01").collect()}
    assert set(head) == {"p", "q", "r", "s"} and (head["p"]["confidence"], head["p"]["date"], head["p"]["scbLabor"], head["p"]["dcbLabor"], head["p"]["templateType"]) == (0.8, "2024-01-01", 210.0, 250.0, "SHORT")
    rows = lambda name: [r.asDict() for r in sections.section(df, name, ["project"]).orderBy("item").collect()]
    sewers = rows("sewers")
    assert [(s["item"], s["runLabel"], s["isLineItem"], s["length"], s["pipeDiameter"], s["slope"]) for s in sewers] == [(1, "12", True, None, 750.0, 1.1), (2, "", False, 0.0, None, None), (3, "", False, None, None, None)]
    assert [(g["type"], g["quantity"], g["depth"], g["wallThickness"]) for g in rows("catchbasins.groups")] == [("SINGLE_CB", 3.0, 2.2, 4.0), ("SINGLE_CB", 0.0, 1.0, 4.0)]
    assert [(w["pipeDiameter"], w["ocSc"], w["avgCover"]) for w in rows("watermain")] == [(0.0, 1.1, 1.8)] and rows("manholes") == [] and rows("watermainValves") == []


def test_leaf_rows_are_those_of_heads_and_sections_from_one_pass(spark):
    """one row for each field, as the wide readers have them, and each response is read once."""
    values = [json.loads(j) for j, *_ in LEAVES] + ["825", -5, 11, None]
    record = lambda k: {
        **{f: values[(k + i) % len(values)] for i, f in enumerate(("projectName", "jobNumber", "date", "confidence"))},
        **{s: [{f: values[(k + i * 3 + j) % len(values)] for i, f in enumerate(fields)} for j in range(k % 3)] + ["no object", None][: k % 2 + 1] for s, fields in sections.FIELDS.items() if "." not in s},
        "catchbasins": {"groups": [{"quantity": values[k % len(values)]}, {}], "laborRates": {"scbLabor": values[k % len(values)]}},
    }
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    texts = [(str(k), json.dumps(record(k))) for k in range(25)] + [("q", "no JSON"), ("r", None), ("s", "[1]"), ("t", '{"sewers": {"not": "a list"}}')]
    df = spark.createDataFrame(texts, "id string, response_json string").repartition(2)
    made = sections.leaf_rows(sections.parsed(df.withColumn("response_json", F.udf(count, "string")("response_json"))), "2024-01-01", ["id"], name="id")
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert seen.value == len(texts)
    want = []
    wide = sections.parsed(df)
    for s, fields in sections.FIELDS.items():
        for r in sections.section(wide, s, ["id"]).collect():
            for f, (how, *_) in fields.items():
                want.append((r["id"], s, r["item"], f, *((None, str(r[f]).lower() if how == "flag" else r[f]) if how in ("text", "flag") else (r[f], None))))
    for r in sections.heads(wide, "2024-01-01", name="id", keep=["id"]).collect():
        want += [(r["id"], "head", 0, f, None, r[c]) for f, c in (("projectName", "project"), ("jobNumber", "jobNumber"), ("date", "date"))]
        want += [(r["id"], "head", 0, f, r[f], None) for f in ("confidence", "scbLabor", "dcbLabor", "dicbFC", "ddicbFC")]
    assert got == sorted(want, key=repr) and len(got) > 1000
