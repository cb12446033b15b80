"""Queries over whole records, workbooks, scoreboards and files that are built from the supplied tables, with their SQL.

Lines of 25 orders each make a project. Its lines become the sewers, manholes, watermain and catchbasins of a raw JSON
record, which the library parses, normalises, validates, prices and lays out; the SQL computes the same from the lines.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions import display, pipes
from gradeline.operators import compare, discovery, layout, learning, normalize, ordinals, publish, scoreboard, sections, statistics, validate
from gradeline.plans.registry import query, read
from gradeline.sources import files as file_source
from gradeline.sources import records as record_source
from gradeline.sources import workbooks
from gradeline.sources.constants import CATCHBASIN_ROWS, DEFAULT_PARAMS, LABOR_RATES, PARAM_CELLS
from gradeline.sources.scoreboards import scoreboard_fields
from gradeline.stages import cut

_AS_OF = "2024-01-01"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_SIZES = "[" + ", ".join(f"{d}.0" for d in pipes.DIAMETERS) + "]"
_SNAP = f"list_sort(list_transform({_SIZES}, lambda d: {{'off': abs(p_size * 15.0 - d), 'size': d}}))[1].size"

# The records as SQL: one table for each list of the normalised record.
_RECORDS = f"""
    r AS MATERIALIZED (SELECT l_orderkey // 25 AS project, l.*, p_name, p_size, p_brand, abs(l_tax) AS tax, abs(l_discount) AS off,
                 row_number() OVER (PARTITION BY l_orderkey // 25 ORDER BY {_ORDER}) AS ord FROM lineitem l JOIN part p ON p_partkey = l_partkey),
    projects AS (SELECT DISTINCT project FROM r),
    s AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ord) AS item, CASE WHEN l_linenumber = 7 THEN '' ELSE p_name || ' ' || ord END AS label,
                 l_linenumber = 1 AS fee, CASE l_linenumber WHEN 2 THEN NULL WHEN 3 THEN 0.0 ELSE l_quantity - 3 END AS length, {_SNAP} AS dia,
                 CASE WHEN tax * 3000 > 10 THEN tax * 3000 / 10 ELSE tax * 3000 END AS slope, nullif(off * 120, 0) AS depth, tax * 100 AS materials
          FROM r WHERE l_returnflag = 'N'),
    m AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ord) AS item, p_name || ' ' || ord AS label, CASE WHEN l_linenumber < 7 THEN 100.0 + l_linenumber END AS top,
                 98.5 AS low, p_size * 15.0 AS out_dia, CASE WHEN l_linenumber % 2 = 0 THEN '1' END AS kind, tax * 100 AS materials, l_quantity AS le, off * 30 AS depth, {_SNAP} AS dia
          FROM r WHERE l_returnflag = 'A'),
    g AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ord) AS item,
                 CASE WHEN p_size % 7 = 0 THEN 'SINGLE_CB' ELSE ['SINGLE_CB', 'DOUBLE_CB', 'DITCH_INLET_CB', 'DOUBLE_DITCH_INLET_CB', 'ODD_CB'][p_size % 5 + 1] END AS kind,
                 l_quantity - 10 AS quantity, coalesce(nullif(off * 20, 0), 2.2) AS depth FROM r WHERE l_returnflag = 'A' AND l_linenumber = 1),
    w AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ord) AS item, p_brand || ' ' || ord AS label, l_quantity - 3 AS length, {_SNAP} AS dia,
                 coalesce(nullif(tax * 100, 0), 1.1) AS oc, coalesce(nullif(off * 60, 0), 1.8) AS cover FROM r WHERE l_returnflag = 'R' AND l_linenumber <= 4),
    sp AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ord) AS item, p_name AS label, l_linenumber::DOUBLE AS quantity, l_quantity AS cost,
                  coalesce(nullif(tax * 1000, 0), 100) AS anode FROM r WHERE l_returnflag = 'R' AND l_linenumber IN (5, 6)),
    v AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ord) AS item, p_brand AS label, l_quantity AS cost FROM r WHERE l_returnflag = 'R' AND l_linenumber = 7)"""


def _raw(spark, sf_dir) -> DataFrame:
    """(project, response_json): a raw record of each project, numbers as text, as null or as no number at all."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", "p_brand")
    lines = read(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumn("project", F.floor(F.col("l_orderkey") / 25).cast("long"))
    lines = lines.withColumn("ord", F.row_number().over(Window.partitionBy("project").orderBy(*_ORDER.split(", "))))
    flag, n, q = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity")
    tax, off, named = F.abs("l_tax"), F.abs("l_discount"), F.concat_ws(" ", "p_name", "ord")
    text = lambda c: c.cast("string")
    some = lambda c: F.when(c != 0, text(c))
    size = text(F.col("p_size") * 15.0)
    lists = {
        "sewers": (flag == "N", dict(
            runLabel=F.when(n == 7, "").otherwise(named), isLineItem=n == 1, length=F.when(n == 2, "abc").when(n == 3, " ").otherwise(text(q - 3)), pipeDiameter=size,
            slope=text(tax * 3000), depth=some(off * 120), addMaterials=text(tax * 100))),
        "manholes": (flag == "A", dict(
            description=named, topElevation=F.when(n < 7, text(n + 100.0)), lowInvert=F.lit(98.5), pipeOutDiameter=size, structureType=F.when(n % 2 == 0, "1").otherwise(""),
            addMaterials=text(tax * 100), addLE=q, depth=text(off * 30), diameter=size)),
        "groups": ((flag == "A") & (n == 1), dict(
            type=F.when(F.col("p_size") % 7 != 0, F.element_at(F.array(*[F.lit(x) for x in ("SINGLE_CB", "DOUBLE_CB", "DITCH_INLET_CB", "DOUBLE_DITCH_INLET_CB", "ODD_CB")]), F.col("p_size") % 5 + 1)),
            quantity=text(q - 10), depth=off * 20)),
        "watermain": ((flag == "R") & (n <= 4), dict(sizeAndType=F.concat_ws(" ", "p_brand", "ord"), length=q - 3, pipeDiameter=size, ocSc=some(tax * 100), avgCover=off * 60)),
        "watermainSpecials": ((flag == "R") & n.isin(5, 6), dict(specialName=F.col("p_name"), quantity=n, costEach=q, anodeCost=text(tax * 1000))),
        "watermainValves": ((flag == "R") & (n == 7), dict(valveSize=F.col("p_brand"), quantity=F.lit("1"), valveCost=q, boxCost=F.lit("none"), laborPerValve=F.lit(0))),
    }
    # A line is written as JSON at once and kept in one list, so few values are collected and sorted. A line is in one list; one of a catchbasin is a manhole's, too.
    written = lambda k: F.when(lists[k][0], F.to_json(F.struct(*[c.alias(f) for f, c in lists[k][1].items()])))
    main = [k for k in lists if k != "groups"]
    lines = lines.select(
        "project", "ord", F.coalesce(*[F.when(lists[k][0], F.lit(k)) for k in main]).alias("list"), F.coalesce(*[written(k) for k in main]).alias("entry"), written("groups").alias("group"),
    )
    # A record's rows have numbers of their own, so nothing else is compared.
    made = lines.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("ord", "list", "entry", "group"))).alias("lines"))
    entries = lambda k: F.col("lines.group") if k == "groups" else F.filter("lines", lambda x: x["list"] == k)["entry"]
    shown = lambda k: F.concat(F.lit(f'"{k}":['), F.array_join(entries(k), ","), F.lit("]"))
    basins = F.concat(F.lit('"catchbasins":{'), shown("groups"), F.lit("}"))
    whole = F.concat_ws(",", shown("manholes"), basins, *[shown(k) for k in ("sewers", "watermain", "watermainSpecials", "watermainValves")])
    return made.select(F.col("project").cast("string").alias("project"), F.concat(F.lit("{"), whole, F.lit("}")).alias("response_json"))


def _responses(spark, sf_dir) -> DataFrame:
    """(project, response): the raw records, parsed as VARIANT."""
    return sections.parsed(_raw(spark, sf_dir)).select("project", "response")


def _parsed(spark, sf_dir, schema: str = record_source.RAW_SCHEMA) -> DataFrame:
    # Records are few bytes and much work each, so their partitions are not to be merged by size.
    return record_source.parsed(_raw(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project"), schema=schema)


def _records(spark, sf_dir) -> DataFrame:
    return normalize.normalized(_parsed(spark, sf_dir), _AS_OF)


def _rounded(df: DataFrame) -> DataFrame:
    def rounded(c: str):
        """To six places; in decimals, which is slow, only where the seventh could be a 5 or digits run out."""
        scaled = F.col(c) * 1e6
        near = F.rint(scaled)
        return F.when((F.abs(F.col(c)) < 1e9) & (F.abs(scaled - near) < 0.49), (near + 0.0) / 1e6).otherwise(F.round(c, 6))

    return df.select(*[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""
    WITH {_RECORDS}
    SELECT project::VARCHAR AS project, CASE WHEN count(*) OVER (PARTITION BY project) > 40 THEN 'LONG' ELSE 'SHORT' END AS template, 0.5::DOUBLE AS confidence, item::INTEGER AS item, label,
           fee, length, dia, round(slope, 6) AS slope, round(depth, 6) AS depth, round(materials, 6) AS materials, 0.0::DOUBLE AS le FROM s
""")
def normalized_sewers(spark, sf_dir):
    """Typed sewer rows of the raw records, with the template that their number asks for."""
    heads = sections.heads(_responses(spark, sf_dir), _AS_OF, keep=["response"]).withColumnRenamed("templateType", "template")
    rows = sections.section(heads, "sewers", ["project", "template", "confidence"])
    return _rounded(rows.select(
        "project", "template", "confidence", "item", F.col("runLabel").alias("label"), F.col("isLineItem").alias("fee"), "length", F.col("pipeDiameter").alias("dia"), "slope", "depth",
        F.col("addMaterials").alias("materials"), F.col("addLE").alias("le"),
    ))


@query(f"""
    WITH {_RECORDS}
    SELECT project::VARCHAR AS project, item::INTEGER AS item, label, top, low, out_dia, kind, round(materials, 6) AS materials, le, round(depth, 6) AS depth, dia FROM m
""")
def normalized_manholes(spark, sf_dir):
    """Manhole rows of the normalised records; the outlet keeps its diameter, the manhole's own is brought to a standard size."""
    rows = sections.section(_responses(spark, sf_dir), "manholes", ["project"])
    return _rounded(rows.select(
        "project", "item", F.col("description").alias("label"), F.col("topElevation").alias("top"), F.col("lowInvert").alias("low"), F.col("pipeOutDiameter").alias("out_dia"),
        F.col("structureType").alias("kind"), F.col("addMaterials").alias("materials"), F.col("addLE").alias("le"), "depth", F.col("diameter").alias("dia"),
    ))


@query(f"""
    WITH {_RECORDS}
    SELECT project::VARCHAR AS project, 'run' AS block, item::INTEGER AS item, label, length AS a, dia AS b, round(oc, 6) AS c, round(cover, 6) AS d FROM w
    UNION ALL SELECT project::VARCHAR, 'special', item, label, quantity, cost, round(anode, 6), 0 FROM sp
    UNION ALL SELECT project::VARCHAR, 'valve', item, label, cost, 285, 150, 150 FROM v
    UNION ALL SELECT project::VARCHAR, 'basin', item, kind, quantity, 4, round(depth, 6), 0 FROM g
    UNION ALL SELECT project::VARCHAR, 'rates', 0, '', 200, 250, 465, 715 FROM projects
""")
def normalized_watermain(spark, sf_dir):
    """Watermain runs, specials and valves, catchbasin groups and rates of the normalised records, with their defaults."""
    responses = cut(_responses(spark, sf_dir))  # made once, as responses of a table are
    block = lambda name, rows, label, *columns: rows.select("project", F.lit(name).alias("block"), "item", F.col(label).alias("label"), *[F.col(c).alias(k) for k, c in zip("abcd", columns, strict=True)])
    of = lambda name: sections.section(responses, name, ["project"])
    basins = of("catchbasins.groups")
    rates = sections.heads(responses, _AS_OF).withColumn("item", F.lit(0)).withColumn("label", F.lit(""))
    parts = [
        block("run", of("watermain"), "sizeAndType", "length", "pipeDiameter", "ocSc", "avgCover"),
        block("special", of("watermainSpecials"), "specialName", "quantity", "costEach", "anodeCost", "thrustBlock"),
        block("valve", of("watermainValves"), "valveSize", "valveCost", "boxCost", "anodeCost", "laborPerValve"),
        block("basin", basins, "type", "quantity", "wallThickness", "depth", "grateEach"),
        block("rates", rates, "label", *LABOR_RATES),
    ]
    return _rounded(scoreboard.union_all(parts))


_NUM = "regexp_replace({}::VARCHAR, '\\.0$', '')"


@query(rf"""
    WITH {_RECORDS},
    x AS (
        SELECT project, 1 AS part, item, 1 AS rule, 'Sewer ' || label || ': zero or negative length' AS warning FROM s WHERE NOT fee AND length <= 0
        UNION ALL SELECT project, 1, item, 2, 'Sewer ' || label || ': unusual depth ' || {_NUM.format('depth')} || 'm (outside 0.5-10m range)' FROM s WHERE NOT fee AND depth > 0 AND (depth < 0.5 OR depth > 10)
        UNION ALL SELECT project, 1, item, 4, 'Sewer ' || label || ': slope ' || {_NUM.format('slope')} || '% seems too high — may be ‰ not %' FROM s WHERE NOT fee AND slope > 10
        UNION ALL SELECT project, 2, item, 1, 'Watermain ' || label || ': zero or negative length' FROM w WHERE length <= 0
        UNION ALL SELECT project, 2, item, 2, 'Watermain ' || label || ': unusual cover ' || {_NUM.format('cover')} || 'm (outside 1.0-4.0m)' FROM w WHERE cover < 1 OR cover > 4
        UNION ALL SELECT project, 3, item, 1, 'Catchbasin group ' || kind || ': zero quantity' FROM g WHERE quantity <= 0)
    SELECT project::VARCHAR AS project, (row_number() OVER (PARTITION BY project ORDER BY part, item, rule) - 1)::INTEGER AS place, warning FROM x
""")
def record_warnings(spark, sf_dir):
    """All warnings about the records, with their numbers, in order."""
    # Of each record that is read, only what the rules look at is taken out and coerced.
    records = normalize.normalized(_parsed(spark, sf_dir, record_source.schema_of(validate.FIELDS)), _AS_OF, only=validate.FIELDS)
    return validate.with_warnings(records).select("project", F.posexplode("warnings").alias("place", "warning"))


@query("""
    SELECT p_partkey, p_size > 25 AS odd, CASE WHEN p_size > 25 THEN 'Sewer ' || p_name || ': non-standard diameter ' || (p_size + 0.5) || 'mm' END AS warning FROM part
""")
def diameter_warnings(spark, sf_dir):
    """Warnings about diameters that are no standard size, which normalised records don't have."""
    odd = F.col("p_size") > 25
    run = F.struct(F.col("p_name").alias("runLabel"), F.lit(False).alias("isLineItem"), F.lit(1.0).alias("length"), F.lit(1.0).alias("depth"), F.when(odd, F.col("p_size") + 0.5).otherwise(300.0).alias("pipeDiameter"), F.lit(1.0).alias("slope"))
    found = validate.sewer_warnings(run)
    return read(spark, sf_dir, "part").select("p_partkey", odd.alias("odd"), F.try_element_at(F.filter(found, lambda w: w.isNotNull()), F.lit(1)).alias("warning"))


@query(f"""
    WITH {_RECORDS}, n AS (SELECT project, count(*) AS n, coalesce(sum(CASE WHEN NOT fee THEN length END), 0) AS len FROM s GROUP BY 1)
    SELECT project::VARCHAR AS project, (n + k.i)::INTEGER AS item, k.label, CASE k.i WHEN 1 THEN len * 25 ELSE 5000 END::DOUBLE AS amount
    FROM n, (VALUES (1, 'VIDEO ($25/m)'), (3, 'LAYOUT'), (5, 'AS BUILT')) k(i, label)
""")
def fees_of_records(spark, sf_dir):
    """Fee rows that are appended to the records' sewers."""
    rows = normalize.with_fees(_records(spark, sf_dir)).select("project", F.inline(F.slice("sewers", -3, 3)))
    return rows.select("project", "item", F.col("runLabel").alias("label"), F.col("addMaterials").alias("amount"))


# Cells of each list, as column:value[:how], where how is t for text, z for zero written, f for forced.
_CELLS = {
    "s": ("SEWERS (1)", 14, 55, "B:label:t C:length D:dia F:slope G:depth:f H:materials"),
    "m": ("MANHOLES (1)", 11, 50, "B:label:t C:top D:low F:out_dia G:kind:t H:materials I:le J:depth:zf L:dia:zf"),
    "w": ("WATERMAIN (1)", 13, 19, "B:label:t C:length D:dia F:oc:z J:cover:zf"),
    "sp": ("WATERMAIN (1)", 24, 40, "B:label:t C:quantity D:cost E:0.0:z F:anode"),
    "v": ("WATERMAIN (1)", 24, 40, "O:label:t P:1.0 Q:cost R:285.0 S:150.0 T:150.0"),
}


def _cell_sql() -> str:
    parts = ["SELECT project, 'MANHOLES (1)' AS sheet, 'B2' AS ref, NULL::DOUBLE AS num, project::VARCHAR AS text, false AS force FROM projects", f"SELECT project, 'MANHOLES (1)', 'B5', NULL, '{_AS_OF}', false FROM projects"]
    for section, (sheet, cells) in PARAM_CELLS.items():
        values = ", ".join(f"('{ref}', {DEFAULT_PARAMS[section][name]}::DOUBLE)" for ref, name in cells.items())
        parts.append(f"SELECT project, '{sheet}', k.ref, k.num, NULL, false FROM projects, (VALUES {values}) k(ref, num)")
    for table, (sheet, first, last, cells) in _CELLS.items():
        for c in cells.split():
            column, value, how = (c.split(":") + [""])[:3]
            num, text = ("NULL", f"nullif({value}, '')") if "t" in how else (value if "z" in how else f"nullif({value}, 0)", "NULL")
            parts.append(f"SELECT project, '{sheet}', '{column}' || (item + {first - 1}), {num}, {text}, {str('f' in how).lower()} FROM {table} WHERE item <= {last - first + 1}")
    row = "CASE kind WHEN 'SINGLE_CB' THEN 53 WHEN 'DOUBLE_CB' THEN 54 WHEN 'DITCH_INLET_CB' THEN 55 ELSE 56 END"
    for column, value in (("C", "nullif(quantity, 0)"), ("D", "4.0"), ("E", "depth")):
        parts.append(f"SELECT project, 'MANHOLES (1)', '{column}' || {row}, {value}, NULL, false FROM g WHERE kind <> 'ODD_CB'")
    for ref, value in (("C59", 200), ("C60", 250), ("F59", 465), ("F60", 715)):
        parts.append(f"SELECT project, 'MANHOLES (1)', '{ref}', {value}, NULL, false FROM projects")
    return "cells AS MATERIALIZED (SELECT project::VARCHAR AS project, sheet, ref, round(num, 6) AS num, text, force FROM (" + " UNION ALL ".join(parts) + ") WHERE num IS NOT NULL OR text IS NOT NULL)"


def _params():
    return F.struct(*[F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]).alias(s) for s, fields in DEFAULT_PARAMS.items()])


def _writes(spark, sf_dir) -> DataFrame:
    return _rounded(layout.raw_writes(_parsed(spark, sf_dir).withColumn("params", _params()), _AS_OF))


def _shown(spark, sf_dir, more=lambda heads: []) -> DataFrame:
    """The cells that the records' workbooks show once all is written, from typed rows of each section; ``more`` adds cells of each project."""
    responses = cut(_responses(spark, sf_dir))  # made once, as responses of a table are
    parts = [layout.section_writes(sections.section(responses, name, ["project"]), name) for name in layout.BLOCKS]
    heads = sections.heads(responses, _AS_OF).withColumn("params", _params())
    return _rounded(scoreboard.union_all([layout.head_writes(heads), *more(heads), layout.basin_writes(sections.section(responses, "catchbasins.groups", ["project"])), *parts]))


@query(f"WITH {_RECORDS}, {_cell_sql()} SELECT * FROM cells")
def workbook_writes(spark, sf_dir):
    """Every cell that the records write into a template: header, parameters, rows within their blocks, catchbasins and rates."""
    return _writes(spark, sf_dir)


@query(f"""
    WITH {_RECORDS}, {_cell_sql()}, k AS (SELECT unnest(range(11, 56, 2)) AS i),
    formulas AS (SELECT 'MANHOLES (1)' AS sheet, unnest(['C' || i, 'J' || i, 'L' || i]) AS ref FROM k UNION ALL SELECT 'SEWERS (1)', unnest(['C' || i, 'G' || i]) FROM k)
    SELECT * FROM cells c WHERE force OR NOT EXISTS (SELECT 1 FROM formulas f WHERE f.sheet = c.sheet AND f.ref = c.ref)
""")
def guarded_writes(spark, sf_dir):
    """The writes that leave formulas of a template alone, unless they are forced."""
    k = spark.range(11, 56, 2)
    refs = lambda sheet, columns: k.select(F.lit(sheet).alias("sheet"), F.explode(F.array(*[F.concat(F.lit(c), F.col("id").cast("string")) for c in columns])).alias("ref"))
    return layout.guarded(_writes(spark, sf_dir), refs("MANHOLES (1)", "CJL").unionByName(refs("SEWERS (1)", "CG")))


_BASIN = "CASE kind WHEN 'SINGLE_CB' THEN 53 WHEN 'DOUBLE_CB' THEN 54 WHEN 'DITCH_INLET_CB' THEN 55 ELSE 56 END"
# The cells that a sheet shows: of catchbasin groups of one type the last one, and the types, which stand in the template.
_SHEETS = _cell_sql() + f""",
    basins AS (SELECT project::VARCHAR AS path, {_BASIN} AS row, max_by(quantity, item) FILTER (quantity <> 0) AS quantity, 4.0 AS wall, round(max_by(depth, item), 6) AS depth
               FROM g WHERE kind <> 'ODD_CB' GROUP BY project, kind),
    c AS MATERIALIZED (
        SELECT project AS path, sheet, regexp_extract(ref, '^[A-Z]+') AS col, regexp_extract(ref, '[0-9]+$')::INTEGER AS row, num, text FROM cells
        WHERE NOT (sheet = 'MANHOLES (1)' AND regexp_matches(ref, '^[C-G]5[3-6]$'))
        UNION ALL SELECT path, 'MANHOLES (1)', k.col, row, CASE k.col WHEN 'C' THEN quantity WHEN 'D' THEN wall ELSE depth END, NULL FROM basins, (VALUES ('C'), ('D'), ('E')) k(col)
        WHERE k.col <> 'C' OR quantity IS NOT NULL
        UNION ALL SELECT project::VARCHAR, 'MANHOLES (1)', 'B', k.row, NULL, k.kind FROM projects, (VALUES (53, 'SINGLE_CB'), (54, 'DOUBLE_CB'), (55, 'DITCH_INLET_CB'), (56, 'DOUBLE_DITCH_INLET_CB')) k(row, kind))"""


def _cells(spark, sf_dir) -> DataFrame:
    """The cells that the records' workbooks show: what is written, and the catchbasin types of the template."""
    types = F.array(*[F.struct(F.lit("MANHOLES (1)").alias("sheet"), F.lit(f"B{row}").alias("ref"), F.lit(None).cast("double").alias("num"), F.lit(kind).alias("text"), F.lit(False).alias("force")) for kind, row in CATCHBASIN_ROWS.items()])
    # Each workbook has one head, so its template's cells come with it.
    both = _shown(spark, sf_dir, lambda heads: [heads.select("project", F.inline(types))])
    row, column = F.ltrim("ref", F.lit(string.ascii_uppercase)).cast("int"), F.rtrim("ref", F.lit(string.digits))
    return both.select(F.col("project").alias("path"), "sheet", row.alias("row"), column.alias("col"), "num", "text")


def _section_sql(sections: list[tuple]) -> str:
    values = ", ".join(f"('{s}', '{sheet}', {a}, {b}, '{c}', '{n}')" for s, sheet, a, b, columns in sections for c, n in columns)
    return f"""
    spec(section, sheet, first, last, col, name) AS (VALUES {values}),
    inside AS (SELECT c.path, spec.section, spec.first, c.row, c.col, spec.name, c.num, c.text FROM c JOIN spec ON spec.sheet = c.sheet AND spec.col = c.col AND c.row BETWEEN spec.first AND spec.last),
    keyed AS (SELECT path, section, row AS sheet_row, first, text AS key, row_number() OVER (PARTITION BY path, section ORDER BY row) AS ord FROM inside WHERE col = 'B' AND text <> '')"""


# What is compared in each section, from the sheets' description.
_COMPARED = [
    ("MANHOLES - Structures", "MANHOLES (1)", 11, 50, (("B", "Description"), ("H", "Add Mtrls"), ("I", "Add L&E"))),
    ("MANHOLES - Catchbasins", "MANHOLES (1)", 53, 56, (("B", "CB Type"), ("C", "QNTY"), ("E", "DPTHm"), ("F", "$GT ea"), ("G", "$/ADDMAT"))),
    ("SEWERS", "SEWERS (1)", 14, 55, (("B", "Run Label"), ("C", "Length"), ("D", "Pipe Dia"), ("E", "Type/Class"), ("F", "Slope"), ("G", "Depth"), ("H", "Add Mtrls"), ("I", "Add L&E"))),
    ("WATERMAIN", "WATERMAIN (1)", 13, 19, (("B", "Size & Type"), ("C", "Length"), ("D", "Pipe Dia"), ("F", "OC/SC"), ("J", "Avg Cover"))),
]


@query(f"""
    WITH {_RECORDS}, {_SHEETS}, {_section_sql(_COMPARED)}
    SELECT k.path, k.section, k.ord::INTEGER AS ord, (k.first + k.ord - 1)::INTEGER AS row, k.key, i.col AS "column", i.name AS column_name, i.num, i.text
    FROM keyed k JOIN inside i ON i.path = k.path AND i.section = k.section AND i.row = k.sheet_row
""")
def section_cells(spark, sf_dir):
    """Cells of rows with a key in the compared sections; a row's number is its place among them."""
    return workbooks.section_rows(_cells(spark, sf_dir)).select("path", "section", "ord", "row", "key", "column", "column_name", "num", "text")


@query(f"""
    WITH {_RECORDS}, {_SHEETS},
    t AS (SELECT path, row, max(text) FILTER (col = 'B') AS label, max(num) FILTER (col = 'C') AS c, max(num) FILTER (col = 'D') AS d, max(num) FILTER (col = 'F') AS f, max(num) FILTER (col = 'G') AS g,
                 max(text) FILTER (col = 'G') AS gt, max(num) FILTER (col = 'J') AS j, sheet FROM c GROUP BY path, sheet, row)
    SELECT path, 'manholes' AS block, row, coalesce(label, '') AS label, coalesce(c, 0) AS a, coalesce(d, 0) AS b, coalesce(nullif(gt::DOUBLE, 0), 1) AS c, coalesce(f, 0) AS d FROM t
    WHERE sheet = 'MANHOLES (1)' AND row BETWEEN 11 AND 60 AND (coalesce(label, '') <> '' OR coalesce(c, 0) <> 0)
    UNION ALL SELECT path, 'sewers', row, coalesce(label, ''), coalesce(c, 0), coalesce(d, 0), coalesce(f, 0), coalesce(g, 0) FROM t
    WHERE sheet = 'SEWERS (1)' AND row BETWEEN 14 AND 55 AND (coalesce(label, '') <> '' OR coalesce(c, 0) <> 0)
    UNION ALL SELECT path, 'watermain', row, coalesce(label, ''), coalesce(c, 0), coalesce(d, 0), coalesce(nullif(f, 0), 1.1), coalesce(nullif(j, 0), 1.8) FROM t
    WHERE sheet = 'WATERMAIN (1)' AND row BETWEEN 13 AND 19 AND (coalesce(label, '') <> '' OR coalesce(c, 0) <> 0)
""")
def dataset_table(spark, sf_dir):
    """The ground-truth dataset of workbooks: rows with a label or a first number, manholes down to the catchbasins."""
    kept = cut(publish.dataset_records(_cells(spark, sf_dir)))
    parts = [("manholes", "description", "topElevation", "lowInvert", "structureType", "pipeOutDiameter"), ("sewers", "runLabel", "length", "pipeDiameter", "slope", "depth"), ("watermain", "sizeAndType", "length", "pipeDiameter", "ocSc", "avgCover")]
    return scoreboard.union_all([
        kept.select("path", F.inline(block)).select("path", F.lit(block).alias("block"), "row", F.col(label).alias("label"), *[F.col(c).alias(k) for k, c in zip("abcd", columns, strict=True)])
        for block, label, *columns in parts
    ])


@query(f"""
    WITH {_RECORDS}, {_SHEETS},
    t AS (SELECT path, sheet, row, max(text) FILTER (col = 'B') AS label, max(num) FILTER (col = 'C') AS c, max(num) FILTER (col = 'D') AS d, max(num) FILTER (col = 'E') AS e, max(num) FILTER (col = 'F') AS f,
                 max(num) FILTER (col = 'H') AS h, max(num) FILTER (col = 'I') AS i, max(num) FILTER (col = 'J') AS j FROM c GROUP BY path, sheet, row),
    good AS (SELECT path FROM t GROUP BY path HAVING bool_or(sheet = 'MANHOLES (1)') AND bool_or(sheet = 'SEWERS (1)'))
    SELECT path, path AS name, 'manholes' AS block, row, label, false AS item, j AS a, coalesce(h, 0) AS b, coalesce(i, 0) AS c FROM t JOIN good USING (path)
    WHERE sheet = 'MANHOLES (1)' AND row BETWEEN 11 AND 50 AND coalesce(label, '') <> ''
    UNION ALL SELECT path, path, 'sewers', row, label, c IS NULL AND d IS NULL, c, d, f FROM t JOIN good USING (path) WHERE sheet = 'SEWERS (1)' AND row BETWEEN 14 AND 55 AND coalesce(label, '') <> ''
    UNION ALL SELECT path, path, 'groups', row, label, false, c, coalesce(d, 4), round(coalesce(e, 2.2), 6) FROM t JOIN good USING (path) WHERE sheet = 'MANHOLES (1)' AND row BETWEEN 53 AND 56 AND coalesce(c, 0) <> 0
    UNION ALL SELECT path, path, 'rates', 0, '', false, 200, 250, 465 FROM good
""")
def example_table(spark, sf_dir):
    """What an example holds of each workbook: manholes, catchbasin groups, sewers and rates."""
    kept = cut(publish.example_records(_cells(spark, sf_dir)).withColumn("name", F.col("projectName")))
    none = F.lit(False).alias("item")
    manholes = kept.select("path", "name", F.inline("manholes")).select("path", "name", F.lit("manholes").alias("block"), "row", F.col("description").alias("label"), none, F.col("depth").alias("a"), F.col("addMaterials").alias("b"), F.col("addLE").alias("c"))
    sewers = kept.select("path", "name", F.inline("sewers")).select("path", "name", F.lit("sewers").alias("block"), "row", F.col("runLabel").alias("label"), F.col("isLineItem").alias("item"), F.col("length").alias("a"), F.col("pipeDiameter").alias("b"), F.col("slope").alias("c"))
    rates = kept.select("path", "name", F.lit("rates").alias("block"), F.lit(0).alias("row"), F.lit("").alias("label"), none, *[F.col(f"catchbasins.laborRates.{r}").alias(k) for r, k in (("scbLabor", "a"), ("dcbLabor", "b"), ("dicbFC", "c"))])
    groups = kept.select("path", "name", F.inline("catchbasins.groups")).select("path", "name", F.lit("groups").alias("block"), "row", F.col("type").alias("label"), none, F.col("quantity").alias("a"), F.col("wallThickness").alias("b"), F.col("depth").alias("c"))
    return scoreboard.union_all([manholes, groups, sewers, rates])


@query("""
    WITH f AS (SELECT p_partkey, p_size % 5 AS k, ['Video inspection', 'LAYOUT', 'As Built ', 'STORM', p_name][p_size % 5 + 1] AS label FROM part)
    SELECT p_partkey, label, k < 3 AS fee, (k = 3 OR k = 1) AS item FROM f
""")
def fee_labels(spark, sf_dir):
    """Labels of standard fees, and rows that are items without a pipe."""
    k = F.col("p_size") % 5
    label = F.element_at(F.array(F.lit("Video inspection"), F.lit("LAYOUT"), F.lit("As Built "), F.lit("STORM"), F.col("p_name")), k + 1)
    length, dia = F.when(k == 1, 0.0).when(k == 3, None).otherwise(5.0), F.when(k == 1, None).when(k == 3, 0.0).otherwise(300.0)
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label"), learning.is_standard_fee(label).alias("fee"), publish.is_line_item(length.cast("double"), dia.cast("double")).alias("item"))


@query("""
    WITH k AS (SELECT p_partkey, ['number', 'text', 'error', 'formula_error', 'formula'][p_size % 5 + 1] AS kind, CASE WHEN p_size % 5 IN (0, 4) THEN p_retailprice END AS num,
                      CASE WHEN p_size % 5 NOT IN (0, 4) THEN p_name END AS text FROM part)
    SELECT 'strict' AS reader, p_partkey::INTEGER AS row, num, text FROM k WHERE kind NOT LIKE '%error'
    UNION ALL SELECT 'lenient', p_partkey, num, text FROM k
""")
def decoded_cells(spark, sf_dir):
    """Cell values as both readers see them: one takes errors for empty, the other for their text."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("number", "text", "error", "formula_error", "formula")]), F.col("p_size") % 5 + 1)
    number = (F.col("p_size") % 5).isin(0, 4)
    cells = read(spark, sf_dir, "part").select(
        F.lit("book").alias("path"), F.lit("S").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.lit("A").alias("col"), kind.alias("kind"),
        F.when(number, F.col("p_retailprice")).alias("num"), F.when(~number, F.col("p_name")).alias("text"),
    )
    return scoreboard.union_all([workbooks.decoded(cells, strict).select(F.lit(n).alias("reader"), "row", "num", "text") for n, strict in (("strict", True), ("lenient", False))])


_TRUE_ROWS = """
    t AS (SELECT project, item AS ord, label || ' #' || item AS key, length AS len, dia, materials, CASE WHEN item % 4 = 0 THEN '12 mm PVC' ELSE 'Concrete ' END AS note FROM s WHERE label <> ''),
    f AS (SELECT project, ord, upper(key) || ' (built)' AS key, len * (1 + (ord % 5) * 0.02) AS len, CASE WHEN ord % 6 = 0 THEN NULL ELSE dia END AS dia, materials,
                 CASE WHEN ord % 4 = 0 THEN '12mm' WHEN ord % 7 = 0 THEN 'steel' ELSE E'\\tCONCRETE' END AS note FROM t WHERE ord % 9 <> 0
          UNION ALL SELECT project, 100000 + ord, 'extra 00' || ord, 1, 1, 1, 'x' FROM t WHERE ord % 11 = 0)"""
_CELL_ROWS = """
    j AS (SELECT t.project, t.ord, f.ord AS match, t.len AS t1, f.len AS f1, t.dia AS t2, f.dia AS f2, t.materials AS t3, f.materials AS f3, t.note AS tn, f.note AS fn FROM t LEFT JOIN f ON f.project = t.project AND f.ord = t.ord),
    n AS (SELECT project, ord, match, 'length' AS col, t1 AS tv, f1 AS fv FROM j UNION ALL SELECT project, ord, match, 'dia', t2, f2 FROM j UNION ALL SELECT project, ord, match, 'materials', t3, f3 FROM j),
    cells AS (
        SELECT project, ord, match IS NOT NULL AS paired, col, CASE WHEN match IS NULL THEN coalesce(tv, 0) <> 0 ELSE NOT (coalesce(tv, 0) = 0 AND coalesce(fv, 0) = 0) END AS counted,
               match IS NOT NULL AND NOT (coalesce(tv, 0) = 0 AND coalesce(fv, 0) = 0) AND tv IS NOT NULL AND fv IS NOT NULL AND abs(tv - fv) / greatest(abs(tv), abs(fv)) < 0.05 AS good,
               CASE WHEN match IS NOT NULL AND tv <> 0 AND fv IS NOT NULL THEN abs((fv - tv) / tv) * 100 END AS err FROM n
        UNION ALL
        SELECT project, ord, match IS NOT NULL, 'note', true, match IS NOT NULL AND CASE WHEN ord % 4 = 0 THEN true ELSE ord % 7 <> 0 END, NULL FROM j)"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """True and generated sewer rows: some missing, some extra, numbers off by up to 8 %, texts with other case and white space."""
    rows = cut(sections.section(_responses(spark, sf_dir), "sewers", ["project"], only=["runLabel", "length", "pipeDiameter", "addMaterials"]).where("runLabel <> ''"))
    cell = lambda n, t: F.struct(n.cast("double").alias("num"), t.cast("string").alias("text"))
    none, ord_ = F.lit(None), F.col("item")
    key = F.concat(F.col("runLabel"), F.lit(" #"), ord_.cast("string"))
    note = F.when(ord_ % 4 == 0, "12 mm PVC").otherwise("Concrete ")
    truth = rows.select("project", ord_.alias("ord"), key.alias("key"), cell(F.col("length"), none).alias("length"), cell(F.col("pipeDiameter"), none).alias("dia"), cell(F.col("addMaterials"), none).alias("materials"), cell(none, note).alias("note"))
    other = F.when(ord_ % 4 == 0, "12mm").when(ord_ % 7 == 0, "steel").otherwise("\tCONCRETE")
    made = rows.where(ord_ % 9 != 0).select(
        "project", ord_.alias("ord"), F.concat(F.upper(key), F.lit(" (built)")).alias("key"), cell(F.col("length") * (1 + (ord_ % 5) * 0.02), none).alias("length"),
        cell(F.when(ord_ % 6 != 0, F.col("pipeDiameter")), none).alias("dia"), cell(F.col("addMaterials"), none).alias("materials"), cell(none, other).alias("note"),
    )
    one = F.lit(1.0)
    extra = rows.where(ord_ % 11 == 0).select("project", (ord_ + 100000).alias("ord"), F.concat(F.lit("extra 00"), ord_.cast("string")).alias("key"), cell(one, none).alias("length"), cell(one, none).alias("dia"), cell(one, none).alias("materials"), cell(none, F.lit("x")).alias("note"))
    return truth, made.unionByName(extra)


@query(f"""
    WITH {_RECORDS}, {_TRUE_ROWS}, {_CELL_ROWS}
    SELECT project::VARCHAR AS project, count(*) FILTER (counted) AS total_cells, count(*) FILTER (good) AS matching_cells, round(coalesce(avg(err) FILTER (counted), 0), 4) AS avg_pct_error,
           round(100.0 * count(*) FILTER (good) / nullif(count(*) FILTER (counted), 0), 4) AS accuracy, count(DISTINCT ord) FILTER (NOT paired) AS missing_rows,
           (SELECT count(*) FROM f WHERE f.project = cells.project AND f.ord >= 100000) AS extra_rows FROM cells GROUP BY project
""")
def section_comparison(spark, sf_dir):
    """Sections compared cell by cell: numbers and texts, rows without a partner, and extra rows, which cost nothing."""
    cells, extra = compare.compare_rows(*_sides(spark, sf_dir), ["project"], ["length", "dia", "materials", "note"])
    report = compare.section_counts(cells, extra, ["project"])
    return report.withColumns({c: F.round(c, 4) for c in ("avg_pct_error", "accuracy")})


@query(f"""
    WITH {_RECORDS}, {_TRUE_ROWS}, {_CELL_ROWS}, x AS (SELECT project, col, ord, row_number() OVER (PARTITION BY project ORDER BY ord, col) AS k FROM cells WHERE counted AND NOT good)
    SELECT project::VARCHAR AS project, string_agg('Row ' || ord || ' [' || col || ']', chr(10) ORDER BY k) FILTER (k <= 15) AS digest, greatest(count(*) - 15, 0) AS more FROM x GROUP BY 1
""")
def difference_digest(spark, sf_dir):
    """The first 15 wrong cells of each project as text."""
    cells, _ = compare.compare_rows(*_sides(spark, sf_dir), ["project"], ["length", "dia", "materials", "note"])
    line = F.concat(F.lit("Row "), F.col("ord").cast("string"), F.lit(" ["), F.col("column"), F.lit("]"))
    wrong = cut(cells.where("counted and not matches").select("project", "ord", "column"))  # ranked and counted
    return compare.diff_digest(wrong, ["project"], [F.asc("ord"), F.asc("column")], line, 15)


_PDF = "project::VARCHAR AS project, project % 3 <> 0 AS has_pdf"
_SIZED = f"""{_RECORDS},
    x AS (SELECT {_PDF}, (SELECT count(*) FROM m WHERE m.project = projects.project) AS manholes, (SELECT count(*) FROM s WHERE s.project = projects.project) AS sewers,
                 (SELECT count(*) FROM w WHERE w.project = projects.project) AS watermain, (SELECT count(*) FROM g WHERE g.project = projects.project) AS groups,
                 (SELECT coalesce(sum(length), 0) FROM s WHERE s.project = projects.project) AS len FROM projects)"""


def _with_pdf(spark, sf_dir) -> DataFrame:
    return _records(spark, sf_dir).withColumn("has_pdf", F.col("project").cast("long") % 3 != 0)


def _counted_with_pdf(spark, sf_dir) -> DataFrame:
    """As above with lists whose entries are only counted."""
    return normalize.listed(_parsed(spark, sf_dir)).withColumn("has_pdf", F.col("project").cast("long") % 3 != 0)


@query(f"WITH {_SIZED} SELECT count(*) AS projects, sum(manholes)::BIGINT AS manholes, sum(sewers)::BIGINT AS sewers, sum(watermain)::BIGINT AS watermain, sum(len) AS sewer_length, count(*) FILTER (has_pdf) AS with_pdf FROM x")
def dataset_totals(spark, sf_dir):
    """Totals over all records."""
    return statistics.dataset_totals(_with_pdf(spark, sf_dir))


@query(f"""WITH {_SIZED} SELECT round(avg(manholes), 6) AS manholes, round(avg(sewers), 6) AS sewers, round(avg(watermain), 6) AS watermain, count(*) FILTER (groups > 0) AS with_catchbasins,
           count(*) FILTER (watermain > 0) AS with_watermain FROM x""")
def profile_means(spark, sf_dir):
    """Mean sizes of records."""
    return _rounded(statistics.profile_means(_counted_with_pdf(spark, sf_dir)))


@query(f"WITH {_SIZED} SELECT project, row_number() OVER (ORDER BY sewers + manholes DESC, project) AS place FROM x")
def complexity_order(spark, sf_dir):
    """Records by their number of sewers and manholes."""
    return statistics.by_complexity(_counted_with_pdf(spark, sf_dir))


@query(f"WITH {_SIZED} SELECT project FROM x WHERE has_pdf AND groups > 0 AND sewers BETWEEN 3 AND 20 ORDER BY project LIMIT 10")
def example_candidates(spark, sf_dir):
    """The first ten records that could serve as examples."""
    return statistics.example_candidates(_counted_with_pdf(spark, sf_dir)).select("project")


@query("""
    SELECT l_suppkey::VARCHAR AS path FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'O' AND l_discount > 0.09) AND bool_or(l_linestatus = 'F' AND l_tax > 0.07 AND l_linenumber = 7)
""")
def workbook_validity(spark, sf_dir):
    """Workbooks that have both required sheets."""
    sheet = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.09), "MANHOLES (1)").when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.07) & (F.col("l_linenumber") == 7), "SEWERS (1)").otherwise("Notes")
    return statistics.complete_workbooks(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), sheet.alias("sheet")))


_STAGES = """
    o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS project, o_totalprice, o_orderpriority, o_custkey FROM orders),
    x AS (
        SELECT project, CASE WHEN k % 2 = 0 THEN 'M' || k WHEN k % 3 = 0 THEN 'S' || k ELSE project END AS name, CASE WHEN k % 5 = 0 THEN o_orderpriority ELSE '' END AS job,
               CASE WHEN k % 4 = 0 THEN 'May 1' WHEN k % 3 = 0 AND k % 8 = 1 THEN 'June 2' ELSE '2024-01-01' END AS date,
               round(CASE WHEN k % 6 = 0 THEN 0.8 WHEN k % 3 = 0 AND k % 7 = 0 THEN 0.9 + 0.8 WHEN k % 7 = 1 THEN 0.9 + 0.6 ELSE 0.9 END / 3, 6) AS confidence,
               CASE WHEN k % 6 = 0 THEN 'low light; ' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'torn; ' ELSE '' END || CASE WHEN k % 7 = 1 THEN 'w; ' ELSE '' END AS warnings FROM o)"""


@query(f"WITH {_STAGES} SELECT project, name, job, date, confidence, warnings FROM x")
def stages_combined(spark, sf_dir):
    """Three section responses of each project as one record: names, dates, the odd confidence and all warnings in order."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    one = lambda c, t: F.when(c, t)
    stages = {
        "manholes": (F.lit(True), dict(projectName=one(k % 2 == 0, F.concat(F.lit("M"), k.cast("string"))), jobNumber=one(k % 5 == 0, F.col("o_orderpriority")), date=one(k % 4 == 0, F.lit("May 1")).otherwise(""),
                                       confidence=one(k % 6 == 0, F.lit("0.8")), warnings=F.when(k % 6 == 0, F.array(F.lit("low light"))))),
        "sewers": (k % 3 == 0, dict(projectName=F.concat(F.lit("S"), k.cast("string")), jobNumber=none, date=one(k % 8 == 1, F.lit("June 2")), confidence=one(k % 7 == 0, F.lit("0.8")), warnings=F.array(F.lit("torn")))),
        "watermain": (k % 7 == 1, dict(projectName=none, jobNumber=none, date=none, confidence=F.lit("0.6"), warnings=F.array(F.lit("w")))),
    }
    orders = read(spark, sf_dir, "orders")
    responses = scoreboard.union_all([
        orders.where(on).select(k.cast("string").alias("project"), F.lit(stage).alias("stage"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("response_json"))
        for stage, (on, fields) in stages.items()
    ])
    names = normalize.combined(record_source.parsed(responses), _AS_OF).select("project", F.col("raw.projectName").alias("name"), F.col("raw.jobNumber").alias("job"), F.col("raw.date").alias("date"), F.col("raw.confidence").cast("double").alias("confidence"), F.col("raw.warnings").alias("w"))
    texts = F.concat(F.array_join(F.transform("w", lambda x: F.concat(x, F.lit("; "))), ""))
    return _rounded(names.select("project", "name", "job", "date", "confidence", texts.alias("warnings")))


_WORDS = ("civil", "servicing", "Drainage", "PLAN", "structural", "detail", "spec", "det-1", "quote", "schedule", "bid", "geotech", "report", "granular", "sand", "estimate moe", "estimate", "budget", "appendix 4", "architectural", "Backup", "additional", "eval_7", "Eval_7", "eval_run_1", "breakdown", "site", "")
_FILES = f"""
    files AS (SELECT (p_size % 13)::VARCHAR AS project, p_name || '-' || {list(_WORDS)!r}[(p_partkey % {len(_WORDS)})::INTEGER + 1] || '-' || p_partkey || ['.pdf', '.xlsx', '.PDF', '.xlsx', '.docx'][(p_partkey // {len(_WORDS)} % 5)::INTEGER + 1] AS name,
                     (p_retailprice * 7)::BIGINT % 1000 AS size FROM part)"""
_POINTS = "CASE WHEN regexp_matches(low, 'civil|servicing|drainage|plan') THEN 1000 ELSE 0 END - CASE WHEN regexp_matches(low, 'structural|detail|spec|det-') THEN 500 ELSE 0 END"


def _runner_sql() -> str:
    parts = []
    rules = [(runner, kind, rule) for runner, both in discovery.RULES.items() for kind, rule in zip(("drawing", "truth"), both, strict=True) if rule]
    for runner, kind, rule in rules:
        where = [f"ends_with({'low' if rule.any_case else 'name'}, '{rule.ending}')", *[f"NOT contains(low, '{w}')" for w in rule.excluded], *[f"NOT contains(name, '{w}')" for w in rule.excluded_exactly]]
        order = None if rule.all_files else f"{_POINTS} DESC, size DESC, name" if rule.plus else "size DESC, name" if rule.largest else "name"
        pick = f" QUALIFY row_number() OVER (PARTITION BY project ORDER BY {order}) = 1" if order else ""
        parts.append(f"SELECT * FROM (SELECT '{runner}' AS runner, '{kind}' AS kind, project, name FROM (SELECT *, lower(name) AS low FROM files) WHERE {' AND '.join(where)}{pick})")
    return " UNION ALL ".join(parts)


def _files(spark, sf_dir) -> DataFrame:
    n = len(_WORDS)
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % n).cast("int") + 1)
    ending = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".xlsx", ".PDF", ".xlsx", ".docx")]), (F.floor(F.col("p_partkey") / n) % 5).cast("int") + 1)
    name = F.concat("p_name", F.lit("-"), word, F.lit("-"), F.col("p_partkey").cast("string"), ending)
    return read(spark, sf_dir, "part").select((F.col("p_size") % 13).cast("string").alias("project"), name.alias("name"), (F.round(F.col("p_retailprice") * 7).cast("long") % 1000).alias("size"))


@query(f"WITH {_FILES} {_runner_sql()}")
def runner_choices(spark, sf_dir):
    """The drawing and the true workbook that each runner takes from a folder."""
    files = _files(spark, sf_dir)
    return scoreboard.union_all([
        discovery.picked(files, rule).select(F.lit(runner).alias("runner"), F.lit(kind).alias("kind"), "project", "name")
        for runner, rules in discovery.RULES.items() for kind, rule in zip(("drawing", "truth"), rules, strict=True) if rule
    ])


@query(f"""
    WITH {_FILES}, c AS ({_runner_sql()}), forced AS (SELECT (n_nationkey + 3)::VARCHAR AS project, n_name || '.pdf' AS name FROM nation)
    SELECT t.project, coalesce(f.name, d.name) AS drawing, t.name AS truth FROM (SELECT * FROM c WHERE runner = 'batch' AND kind = 'truth') t
    LEFT JOIN (SELECT * FROM c WHERE runner = 'batch' AND kind = 'drawing') d USING (project) LEFT JOIN forced f USING (project) WHERE d.name IS NOT NULL OR f.name IS NOT NULL
""")
def project_files(spark, sf_dir):
    """Projects with a drawing and a true workbook; a named drawing wins, but still needs the workbook."""
    forced = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).cast("string").alias("project"), F.concat("n_name", F.lit(".pdf")).alias("name"))
    return discovery.projects(_files(spark, sf_dir), forced)


@query("""
    WITH f AS (SELECT user_id AS project, CASE event_type WHEN 'view' THEN 'eval_2026-01-0' || event_id % 9 WHEN 'error' THEN 'eval_run_' || event_id WHEN 'signup' THEN 'eval_run_golden_' || event_id ELSE 'plan_' || event_id END
                    || CASE WHEN event_id % 11 = 0 THEN '.pdf' ELSE '.xlsx' END AS name FROM events)
    SELECT project, max(name) AS generated FROM f WHERE starts_with(name, 'eval_') AND ends_with(name, '.xlsx') GROUP BY 1
""")
def latest_generated(spark, sf_dir):
    """The generated workbook of each project that comes last by name."""
    e, kind = F.col("event_id"), F.col("event_type")
    stem = F.when(kind == "view", F.concat(F.lit("eval_2026-01-0"), (e % 9).cast("string"))).when(kind == "error", F.concat(F.lit("eval_run_"), e.cast("string"))).when(kind == "signup", F.concat(F.lit("eval_run_golden_"), e.cast("string"))).otherwise(F.concat(F.lit("plan_"), e.cast("string")))
    name = F.concat(stem, F.when(e % 11 == 0, ".pdf").otherwise(".xlsx"))
    return discovery.latest_output(read(spark, sf_dir, "events").select(F.col("user_id").alias("project"), name.alias("name")))


@query("""
    WITH p AS (SELECT page_id, substr(url, 8) AS u FROM pages), n AS (SELECT CASE page_id % 5 WHEN 0 THEN '/' || u WHEN 1 THEN split_part(u, '/', 1) ELSE u END AS path FROM p)
    SELECT DISTINCT split_part(path, '/', 1) AS project FROM n WHERE contains(path, '/') AND split_part(path, '/', 1) <> ''
""")
def object_folders(spark, sf_dir):
    """Folders of object names; names at the root have none."""
    u = F.substring("url", 8, 1 << 20)
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), u)).when(F.col("page_id") % 5 == 1, F.split_part(u, F.lit("/"), F.lit(1))).otherwise(u)
    return discovery.folders(read(spark, sf_dir, "pages").select(path.alias("path")))


@query("SELECT page_id, contains(url, '/Fr') AS any_case_only, contains(lower(url), '/fr') AS in_any_case FROM pages WHERE contains(lower(url), '/fr')")
def projects_named_like(spark, sf_dir):
    """Names that contain a text, in its own case and in any."""
    pages = read(spark, sf_dir, "pages")
    exact = discovery.named_like(pages, "/Fr", "url").select("page_id", F.lit(True).alias("_exact"))
    loose = discovery.named_like(pages, "/Fr", "url", any_case=True).join(exact, "page_id", "left")
    return loose.select("page_id", F.coalesce("_exact", F.lit(False)).alias("any_case_only"), F.lit(True).alias("in_any_case"))


_BOARD = """
    b AS (SELECT user_id::VARCHAR AS project, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type <> 'click') AS total_cells, count(*) FILTER (event_type <> 'click' AND value > 10) AS matching_cells,
                 avg(value) FILTER (event_type = 'view') AS mh_structures, avg(value) FILTER (event_type = 'error') AS mh_catchbasins, avg(value) FILTER (event_type = 'purchase') AS sewers,
                 avg(value) FILTER (event_type = 'signup' AND value > 20) AS watermain FROM events GROUP BY 1, 2),
    q AS (SELECT *, coalesce(100.0 * matching_cells / nullif(total_cells, 0), 0) AS overall FROM b)"""


def _board(spark, sf_dir) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    file = F.concat(F.lit("evaluation_scoreboard_"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_task1.csv"))
    mean = lambda on: F.sum(F.when(on, v.cast("decimal(18, 4)"))).cast("double") / F.nullif(F.count(F.when(on, v)), F.lit(0))  # noqa: E731  exact, so that the order of rows does not count
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("project"), display.scoreboard_date(file).alias("day")).agg(
        F.count_if(kind != "click").alias("total_cells"), F.count_if((kind != "click") & (v > 10)).alias("matching_cells"), mean(kind == "view").alias("mh_structures"),
        mean(kind == "error").alias("mh_catchbasins"), mean(kind == "purchase").alias("sewers"), mean((kind == "signup") & (v > 20)).alias("watermain"),
    )
    return rows.withColumn("overall", compare.accuracy(F.col("matching_cells"), F.col("total_cells")))


_MEANS = ("mh_structures", "mh_catchbasins", "sewers", "watermain")
# The same with means over exact sums of values to four places, as lines show which side of a tie they are on.
_EXACT_BOARD = re.sub(r"avg\(value\) FILTER \((.*?)\) AS", r"(sum(value::DECIMAL(18, 4)) FILTER (\1))::DOUBLE / count(value) FILTER (\1) AS", _BOARD)


@query(f"""WITH {_BOARD} SELECT count(*) AS projects, round(coalesce(avg(overall) FILTER (total_cells > 0), 0), 6) AS mean_accuracy, round(coalesce(100.0 * sum(matching_cells) / nullif(sum(total_cells), 0), 0), 6) AS cell_accuracy,
           {", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in _MEANS)} FROM q""")
def category_means(spark, sf_dir):
    """Means of the sections over all rows that have them."""
    return _rounded(scoreboard.summary(_board(spark, sf_dir), _MEANS))


@query(f"WITH {_BOARD} SELECT project, day, total_cells, matching_cells, round(overall, 6) AS overall FROM q WHERE day = (SELECT max(day) FROM q)")
def latest_scoreboard(spark, sf_dir):
    """The rows of the newest day in the files' names."""
    return _rounded(scoreboard.latest_day(_board(spark, sf_dir)).select("project", "day", "total_cells", "matching_cells", "overall"))


@query(f"WITH {_BOARD} SELECT round(coalesce(avg(CASE WHEN matching_cells <> 3 THEN overall END), 0), 6) AS baseline, count(*) FILTER (matching_cells <> 3) AS projects FROM q WHERE total_cells > 0")
def baseline_accuracy(spark, sf_dir):
    """The baseline: the mean of rows with both numbers and at least one cell."""
    rows = _board(spark, sf_dir).withColumn("overall", F.when(F.col("matching_cells") != 3, F.col("overall")))
    return _rounded(scoreboard.baseline(rows))


_SHOWN = "lpad(coalesce(round({})::BIGINT || '%', 'N/A'), 8, ' ')"
_FIXED = "printf('%.1f', {0} + CASE WHEN {0} * 4 = floor({0} * 4) AND ({0} * 20)::BIGINT % 2 = 1 THEN 0.01 ELSE 0 END)"
_GOLDEN = f"rpad(coalesce({_FIXED} || '%', 'N/A'), 6, ' ')"


@query(f"""WITH {_EXACT_BOARD}, d AS (SELECT * FROM q WHERE day = (SELECT max(day) FROM q))
    SELECT 'board' AS layout, rpad('Project ' || project, 50, ' ') || ' │ ' || {" || ' │ ' || ".join(_SHOWN.format(c) for c in _MEANS)} || ' │ ' || lpad({_FIXED.format('overall')} || '%', 8, ' ') || ' │ ' || lpad(total_cells::VARCHAR, 6, ' ') AS line FROM d
    UNION ALL SELECT 'golden', rpad('Project ' || project, 50, ' ') || CASE WHEN total_cells = 0 THEN '│ ERROR  │ ERROR  │ ERROR  │ ERROR  │ ERROR' ELSE '│ ' || {" || ' │ ' || ".join(_GOLDEN.format(c) for c in _MEANS)} || ' │ ' || {_FIXED.format('overall')} || '%' END FROM d
""")
def printed_sections(spark, sf_dir):
    """The newest scoreboard with its sections, as lines of the run's table and of the table of chosen projects."""
    rows = scoreboard.latest_day(_board(spark, sf_dir)).withColumn("project", F.concat(F.lit("Project "), "project"))
    golden = publish.golden_lines(rows.withColumn("failed", F.col("total_cells") == 0))
    return scoreboard.union_all([publish.board_lines(rows).select(F.lit("board").alias("layout"), "line"), golden.select(F.lit("golden").alias("layout"), "line")])


@query("SELECT count(*) FILTER (event_type = 'view') AS processed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('signup', 'click')) AS skipped FROM events")
def run_counters(spark, sf_dir):
    """How many projects were processed, failed and were skipped."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "processed").when(kind == "error", "failed").when(kind.isin("signup", "click"), "skipped")
    return scoreboard.run_counts(read(spark, sf_dir, "events").select(status.alias("status")))


@query(f"""WITH {_BOARD}, d AS (SELECT * FROM q WHERE day = (SELECT max(day) FROM q))
    SELECT rpad(left('Project ' || project, 50), 50, ' ') || ' ' || lpad(printf('%.1f', overall) || '%', 7, ' ') || ' (' || matching_cells || '/' || total_cells || ')' AS line FROM d""")
def printed_scoreboard(spark, sf_dir):
    """The newest scoreboard as text lines."""
    rows = scoreboard.latest_day(_board(spark, sf_dir)).withColumn("project", F.concat(F.lit("Project "), "project"))
    return publish.printed(rows)


@query("""
    WITH k AS (SELECT p_partkey, p_size % 4 AS k, p_size, p_name || CASE WHEN p_size % 2 = 0 THEN ', PHASE 2' ELSE '' END AS name FROM part)
    SELECT p_partkey, trim(name) AS project, CASE k WHEN 0 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS sewers, CASE k WHEN 2 THEN 0 ELSE 55.25 END::DOUBLE AS overall,
           CASE k WHEN 3 THEN 0 ELSE p_size END AS total_cells, CASE WHEN k = 1 THEN 9 ELSE 8 END AS fields FROM k
""")
def scoreboard_fields_quoted(spark, sf_dir):
    """Fields of scoreboard lines with quoted commas, missing sections and numbers that can't be read."""
    k, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    name = F.concat(F.lit(' " '), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, ", PHASE 2").otherwise(""), F.lit('"'))
    line = F.concat(
        name, F.lit(",1.5,N/A,"), F.when(k == 0, "N/A").otherwise(F.concat(size, F.lit(".5"))), F.lit(",3.5,"), F.when(k == 2, "none").otherwise(" 55.25%"), F.lit(","),
        F.when(k == 3, "x").otherwise(F.concat(size, F.lit(".9"))), F.lit(",0"), F.when(k == 1, ",more").otherwise(""),
    )
    fields = scoreboard_fields(line)
    return read(spark, sf_dir, "part").select("p_partkey", *[fields[c].alias(c) for c in ("project", "sewers", "overall", "total_cells", "fields")])


@query("""
    SELECT o_orderkey AS project, count(*) FILTER (l_linenumber % 4 IN (0, 1, 2)) AS rules, coalesce(string_agg(l_linenumber % 4, '' ORDER BY ord) FILTER (l_linenumber % 4 IN (0, 1, 2)), '') AS kinds FROM (
        SELECT l_orderkey AS o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord FROM lineitem) GROUP BY 1
""")
def rules_in_scope(spark, sf_dir):
    """The rules of a list that hold for sewers: without a component, general ones, and those for sewers."""
    kind = F.col("l_linenumber") % 4
    component = F.when(kind == 1, "general").when(kind == 2, "sewers").when(kind == 3, "manholes")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rules = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg(F.array_sort(F.collect_list(F.struct(*order, kind.cast("string").alias("rule"), component.alias("component")))).alias("rules"))
    kept = learning.applies_to(F.col("rules"), "sewers")
    return rules.select("project", F.size(kept).cast("long").alias("rules"), F.array_join(F.transform(kept, lambda r: r["rule"]), "").alias("kinds"))


@query("""
    WITH e AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority || o_orderkey END AS name, o_orderkey % 4 <> 1 AS has FROM orders)
    SELECT name AS project, 2 AS sewers FROM e WHERE name IS NOT NULL AND has ORDER BY ord LIMIT 3
""")
def usable_examples(spark, sf_dir):
    """The first three examples with a name and rows, without their fee rows."""
    k = F.col("o_orderkey")
    row = lambda t: F.struct(F.lit(t).alias("runLabel"))
    rows = read(spark, sf_dir, "orders").select(
        k.alias("ord"), F.when(k % 3 != 0, F.concat("o_orderpriority", k.cast("string"))).alias("projectName"),
        F.when(k % 4 == 2, F.array(F.lit("MH"))).alias("manholes"), F.when(k % 4 != 1, F.array(row("A-B"), row("Video inspection"), row("STORM"), row("AS BUILT drawings"))).alias("sewers"),
    )
    return learning.usable_examples(rows).select(F.col("projectName").alias("project"), F.size("sewers").alias("sewers"))


@query("SELECT upper(n_name) AS project FROM nation WHERE n_nationkey > 4 ORDER BY n_nationkey LIMIT 2")
def example_additions(spark, sf_dir):
    """Examples that may be added: new names in any case, the first of each, up to three in all."""
    nation = read(spark, sf_dir, "nation")
    held = nation.where("n_nationkey = 4").select(F.col("n_name").alias("projectName"))
    again = nation.select(F.upper("n_name").alias("projectName"), F.col("n_nationkey").cast("long").alias("ord")).where("ord >= 4")
    more = nation.where("n_nationkey = 5").select(F.lower("n_name").alias("projectName"), F.lit(5000).cast("long").alias("ord"))
    return learning.addable_examples(held, again.unionByName(more)).select(F.col("projectName").alias("project"))


@query("""
    SELECT row_number() OVER (ORDER BY source, ord) AS place, name FROM (SELECT 0 AS source, n_nationkey AS ord, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)
""")
def all_examples(spark, sf_dir):
    """Built-in examples and then the added ones; the lists are short."""
    builtin = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))
    added = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord"))
    both = learning.all_examples(builtin, added)
    return ordinals.numbered(both, [], "ord", "place").select(F.col("place").cast("long").alias("place"), "name")


@query("""
    WITH k AS (SELECT p_partkey AS project, p_size % 5 AS k, p_name FROM part)
    SELECT project, CASE k WHEN 0 THEN 'PROMPT_TUNING' WHEN 1 THEN 'ADD_HEURISTIC' WHEN 2 THEN 'ADD_FEW_SHOT' END AS action, CASE k WHEN 0 THEN 'sewers' END AS component,
           CASE k WHEN 0 THEN 'Read ' || p_name WHEN 1 THEN p_name || ' is standard' END AS rule, CASE WHEN k = 3 THEN 'no JSON' END AS error FROM k
""")
def replayed_suggestions(spark, sf_dir):
    """Suggestions from replayed texts, with or without a code fence; an empty text suggests nothing, other texts are errors."""
    k = F.col("p_size") % 5
    made = F.to_json(F.struct(
        F.element_at(F.array(F.lit("PROMPT_TUNING"), F.lit("ADD_HEURISTIC"), F.lit("ADD_FEW_SHOT"), F.lit("x"), F.lit("y")), k + 1).alias("action"), F.when(k == 0, "sewers").when(k == 1, "").alias("component"),
        F.lit("as the drawings show").alias("reasoning"), F.concat(F.lit("Read "), "p_name").alias("promptAddition"), F.concat("p_name", F.lit(" is standard")).alias("heuristicRule"),
    ))
    text = F.when(k == 3, F.concat(F.lit("I suggest "), "p_name")).when(k == 1, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(k == 4, "").otherwise(made)
    return learning.suggestions(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), text.alias("suggestion_json")))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 >= 0.8 THEN 'high' WHEN l_discount * 10 >= 0.6 THEN 'medium' ELSE 'low' END AS band,
           CASE l_linenumber % 3 WHEN 0 THEN '-' WHEN 1 THEN 'STD' ELSE 'LRG' END AS kind, CASE WHEN l_tax <> 0 THEN 'Y' ELSE 'N' END AS block, CASE WHEN l_tax = 0 THEN '-' ELSE (l_linenumber + 0.5)::VARCHAR END AS shown FROM lineitem
""")
def record_labels(spark, sf_dir):
    """Confidence bands, structure labels, thrust blocks and dashes."""
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "").when(n % 3 == 1, "1").otherwise("2")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", display.confidence_band(F.col("l_discount") * 10).alias("band"), display.structure_label(kind).alias("kind"),
        display.yes_no(F.col("l_tax")).alias("block"), display.or_dash(F.when(F.col("l_tax") != 0, n + 0.5).otherwise(0.0)).alias("shown"),
    )


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord FROM lineitem)
    SELECT l_orderkey, string_agg('line ' || l_linenumber, '; ' ORDER BY ord) FILTER (ord <= 3) AS warnings, string_agg(ord || '. line ' || l_linenumber, chr(10) ORDER BY ord) AS rules,
           'Focus on pages ' || string_agg(l_linenumber::VARCHAR, ', ' ORDER BY ord) || '.' AS pages FROM l GROUP BY 1
""")
def prompt_texts(spark, sf_dir):
    """The first warnings, numbered rules and the sentence about pages."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
    named = F.transform("x", lambda e: F.concat(F.lit("line "), e["l_linenumber"].cast("string")))
    return lines.select("l_orderkey", display.first_warnings(named).alias("warnings"), display.numbered_rules(named).alias("rules"), display.page_focus(F.transform("x", lambda e: e["l_linenumber"])).alias("pages"))


@query("""
    WITH q AS (SELECT o_orderkey AS k, o_totalprice AS s, o_custkey * 1.0 AS m, o_custkey % 7 AS n, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority END AS note FROM orders), t AS (SELECT *, s + m AS sub FROM q),
    money AS (SELECT k, unnest([{'l': 1, 'p': 'item', 'q': (n + 0.5) || ' m', 'd': 'Sewer Installation', 'a': s}, {'l': 2, 'p': 'item', 'q': n || ' ea', 'd': 'Manholes & Catchbasins', 'a': m},
                {'l': 3, 'p': 'item', 'q': '0 m', 'd': 'Watermain Installation', 'a': 0}, {'l': 4, 'p': 'total', 'q': NULL, 'd': 'SUB TOTAL', 'a': sub}, {'l': 5, 'p': 'total', 'q': NULL, 'd': 'MARKUP (25%)', 'a': sub * 0.25},
                {'l': 6, 'p': 'total', 'q': NULL, 'd': 'GRAND TOTAL', 'a': sub * 1.25}]) AS e FROM t),
    words AS (SELECT k, unnest([{'l': 7, 'p': 'scope', 'd': 'Supply and install ' || (n + 0.5) || 'm of storm/sanitary sewer'}, {'l': 8, 'p': 'scope', 'd': 'Supply and install ' || n || ' manholes/catchbasins'},
                {'l': 9, 'p': 'scope', 'd': 'Supply and install 0m of watermain'}, {'l': 10, 'p': 'scope', 'd': 'Excavation, backfill, and compaction'}, {'l': 11, 'p': 'scope', 'd': 'Granular and crushed stone bedding'},
                {'l': 12, 'p': 'scope', 'd': 'Trucking of excess material'}, {'l': 13, 'p': 'scope', 'd': 'All fittings and connections as shown on drawings'}, {'l': 14, 'p': 'exclusion', 'd': 'Rock excavation'},
                {'l': 15, 'p': 'exclusion', 'd': 'Dewatering (if required)'}, {'l': 16, 'p': 'exclusion', 'd': 'Asphalt and curb restoration'}, {'l': 17, 'p': 'exclusion', 'd': 'Permits and inspection fees'}, {'l': 18, 'p': 'exclusion', 'd': 'HST'},
                {'l': 19, 'p': 'note', 'd': note}, {'l': 20, 'p': 'validity', 'd': 'This quotation is valid for 30 days from the date above.'}]) AS e FROM t)
    SELECT k AS project, e.l::INTEGER AS line, e.p AS part, e.q AS quantity, e.d AS description, '$' || format('{:,.2f}', e.a::DOUBLE) AS amount FROM money
    UNION ALL SELECT k, e.l, e.p, NULL, e.d, NULL FROM words WHERE e.d IS NOT NULL
""")
def quote_document(spark, sf_dir):
    """All lines of each quote: items, totals, scope, exclusions, notes and validity."""
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 7
    q = read(spark, sf_dir, "orders").select(
        k.alias("project"), F.col("o_totalprice").alias("sewer_total"), (F.col("o_custkey") * 1.0).alias("manhole_total"), F.lit(0.0).alias("watermain_total"), (n + 0.5).alias("sewer_length"), n.alias("manhole_count"),
        F.lit(0.0).alias("watermain_length"), F.lit(0.25).alias("markup"), F.when(k % 9 == 0, F.col("o_orderpriority")).alias("notes"),
    )
    q = q.withColumn("subtotal", F.col("sewer_total") + F.col("manhole_total"))
    return publish.quote_lines(q.withColumn("grand_total", F.col("subtotal") * 1.25))


@query("SELECT doc_id, base64(encode(coalesce(text, ''))) AS content, length(coalesce(text, '')) AS n FROM documents")
def encoded_contents(spark, sf_dir):
    """Whole contents as base64 text for a response."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.cast("binary").alias("content"), F.length(text).cast("long").alias("n"))
    return file_source.encoded(docs, "content").drop("id").withColumn("content", F.regexp_replace("content", "\\s", ""))


@query("""
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS size FROM documents), k AS (SELECT DISTINCT sha256 FROM d WHERE doc_id % 3 = 0)
    SELECT doc_id, sha256 FROM d WHERE size > 2000 AND sha256 NOT IN (SELECT sha256 FROM k)
""")
def uncached_contents(spark, sf_dir):
    """Large contents that the store of every third document does not have."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return file_source.uncached(docs, file_source.content_keys(docs.where("doc_id % 3 = 0")), 2000).select("doc_id", "sha256")
