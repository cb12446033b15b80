"""Registered queries over the supplied tables and the SQL that checks them.

Each query applies the operator of the library that it is named after to a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions import display, matching, pipes, tokens, values
from gradeline.operators import compare, costs, discovery, layout, learning, ordinals, scoreboard, statistics, validate
from gradeline.plans import books, names, records, runs, stored, typed  # noqa: F401  (register their queries)
from gradeline.plans.registry import ORACLE, QUERIES, query, read  # noqa: F401
from gradeline.sources import files
from gradeline.sources.constants import DEFAULT_PARAMS
from gradeline.sources.scoreboards import naive_fields

FLAGSHIP = "cell_compare_tolerance"
_SIZES = "[" + ", ".join(f"{d}.0" for d in pipes.DIAMETERS) + "]"


def _snapped(value: str) -> str:
    """SQL of the nearest standard size of a positive value."""
    return f"list_sort(list_transform({_SIZES}, lambda d: {{'off': abs({value} - d), 'size': d}}))[1].size"


@query(f"SELECT p_partkey, {_snapped('p_retailprice')} AS diameter, {_snapped('p_size * 15.0')} AS small_diameter FROM part")
def snap_nearest(spark, sf_dir):
    """The nearest standard diameter."""
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", pipes.standard_diameter(F.col("p_retailprice")).alias("diameter"), pipes.standard_diameter(F.col("p_size") * 15.0).alias("small_diameter"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 10 THEN l_quantity / 10 ELSE l_quantity END AS slope FROM lineitem")
def slope_repair(spark, sf_dir):
    """Slopes in percent."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pipes.percent_slope(F.col("l_quantity")).alias("slope"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_discount, 0), 2.2) AS depth, coalesce(nullif(l_tax, 0), 4.0) AS wall FROM lineitem")
def or_default(spark, sf_dir):
    """Defaults for zero and missing numbers."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", values.or_default(F.col("l_discount"), 2.2).alias("depth"), values.or_default(F.col("l_tax"), 4).alias("wall"))


_PREFIX = r"'^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE)"


@query(rf"""
    SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_size || 'mm', {_PREFIX} AS size,
           TRY_CAST(nullif(regexp_extract(p_brand, {_PREFIX} AS brand,
           TRY_CAST(nullif(regexp_extract(' -.' || p_size || 'e1x', {_PREFIX} AS small
    FROM part
""")
def parse_float_prefix(spark, sf_dir):
    """Numbers that texts begin with."""
    size = F.col("p_size").cast("string")
    return read(spark, sf_dir, "part").select(
        "p_partkey", values.number_prefix(F.concat(size, F.lit("mm"))).alias("size"), values.number_prefix(F.col("p_brand")).alias("brand"),
        values.number_prefix(F.concat(F.lit(" -."), size, F.lit("e1x"))).alias("small"),
    )


@query("""
    SELECT event_id, coalesce(nullif(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0), 0.5) AS k,
           coalesce(json_extract_string(props, '$.k'), '') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_kept FROM events
""")
def json_props_normalize(spark, sf_dir):
    """Typed fields of JSON with string leaves."""
    k = F.from_json("props", "k string")["k"]
    return read(spark, sf_dir, "events").select(
        "event_id", values.or_default(values.number(k), 0.5).alias("k"), values.text_or(k).alias("k_text"), values.number(k).alias("k_kept")
    )


_FOUND = "l_quantity * (1 + ((l_partkey % 5) - 2) * 0.03)"


@query(f"""
    WITH c AS (
        SELECT l_returnflag, l_linestatus, l_quantity AS t, {_FOUND} AS f, l_discount AS t2,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE round(l_discount * 1.04, 4) END AS f2 FROM lineitem),
    d AS (
        SELECT l_returnflag, l_linestatus, 'quantity' AS field, t, f FROM c UNION ALL SELECT l_returnflag, l_linestatus, 'discount', t2, f2 FROM c),
    e AS (
        SELECT *, NOT (coalesce(t, 0) = 0 AND coalesce(f, 0) = 0) AS counted,
               CASE WHEN t IS NULL OR f IS NULL THEN t IS NULL AND f IS NULL WHEN t = 0 AND f = 0 THEN true
                    ELSE abs(t - f) / greatest(abs(t), abs(f)) < 0.05 END AS same FROM d)
    SELECT l_returnflag, l_linestatus, field, count(*) FILTER (counted) AS total_cells, count(*) FILTER (counted AND same) AS matching_cells,
           round(coalesce(avg(CASE WHEN counted AND t <> 0 THEN abs((f - t) / t) * 100 END), 0), 4) AS avg_pct_error,
           round(100.0 * count(*) FILTER (counted AND same) / nullif(count(*) FILTER (counted), 0), 4) AS accuracy
    FROM e GROUP BY ALL
""")
def cell_compare_tolerance(spark, sf_dir):
    """Cells of two sides compared with tolerance, and each section's report."""
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "lineitem")
    found = F.col("l_quantity") * (1 + ((F.col("l_partkey") % 5) - 2) * 0.03)
    partly = F.when(F.col("l_partkey") % 7 != 0, F.round(F.col("l_discount") * 1.04, 4))
    sides = F.array(*[
        F.struct(F.lit(n).alias("field"), t.alias("truth_num"), none.alias("truth_text"), f.alias("found_num"), none.alias("found_text"), F.lit(True).alias("paired"))
        for n, t, f in (("quantity", F.col("l_quantity"), found), ("discount", F.col("l_discount"), partly))
    ])
    cells = compare.compared_cells(rows.select("l_returnflag", "l_linestatus", F.inline(sides)))
    report = compare.section_report(cells, ["l_returnflag", "l_linestatus", "field"])
    return report.withColumns({c: F.round(c, 4) for c in ("avg_pct_error", "accuracy")})


def _lines(spark, sf_dir) -> DataFrame:
    """Lines with an ordinal in their order, since order and line number are no key."""
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return line.withColumn("ord", F.row_number().over(order))


_LINES_SQL = """
    lines AS (
        SELECT l.*, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""
_MATCH_SQL = f"""
    WITH RECURSIVE {_LINES_SQL},
    t AS (SELECT l_orderkey, ord, p_name || ' ' || (l_linenumber % 3) || CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN '77' ELSE '' END AS key
          FROM lines),
    f AS (SELECT l_orderkey, ord, upper(p_name) || '-' || (l_linenumber % 3) || ' (as built)' AS key FROM lines WHERE (l_partkey + l_linenumber) % 11 <> 0),
    tk AS (SELECT *, trim(lower(regexp_replace(key, '\\(.*?\\)', '', 'g'))) AS plain FROM t),
    fk AS (SELECT *, trim(lower(regexp_replace(key, '\\(.*?\\)', '', 'g'))) AS plain FROM f),
    tb AS (SELECT *, regexp_replace(plain, '[^a-z0-9]', '', 'g') AS bare, regexp_replace(plain, '[^0-9]', '', 'g') AS digits FROM tk),
    fb AS (SELECT *, regexp_replace(plain, '[^a-z0-9]', '', 'g') AS bare, regexp_replace(plain, '[^0-9]', '', 'g') AS digits FROM fk),
    choices AS (
        SELECT tb.l_orderkey, tb.ord, list(fb.ord ORDER BY fb.ord) FILTER (fb.ord IS NOT NULL) AS c
        FROM tb LEFT JOIN fb ON tb.l_orderkey = fb.l_orderkey
             AND (tb.plain = fb.plain OR tb.bare = fb.bare OR ((contains(tb.bare, fb.bare) OR contains(fb.bare, tb.bare)) AND tb.digits = fb.digits))
        GROUP BY ALL),
    step AS (
        SELECT l_orderkey, 0::BIGINT AS ord, []::BIGINT[] AS used, NULL::BIGINT AS pick FROM (SELECT DISTINCT l_orderkey FROM tb)
        UNION ALL
        SELECT s.l_orderkey, c.ord, CASE WHEN p.pick IS NULL THEN s.used ELSE list_append(s.used, p.pick) END, p.pick
        FROM step s JOIN choices c ON c.l_orderkey = s.l_orderkey AND c.ord = s.ord + 1,
             LATERAL (SELECT list_filter(coalesce(c.c, []), lambda x: NOT list_contains(s.used, x))[1] AS pick) p)
"""


@query(_MATCH_SQL + "SELECT l_orderkey, ord, pick AS match FROM step WHERE ord > 0")
def fuzzy_greedy_match(spark, sf_dir):
    """Rows paired one to one by matching keys, in order."""
    return _matched(spark, sf_dir)[2]


def _matched(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    place = (F.col("l_linenumber") % 3).cast("string")
    other = F.when((F.col("l_partkey") + F.col("l_linenumber")) % 5 == 0, "77").otherwise("")  # no found row has such a number
    truth = lines.select("l_orderkey", "ord", F.concat(F.col("p_name"), F.lit(" "), place, other).alias("key"))
    kept = lines.where((F.col("l_partkey") + F.col("l_linenumber")) % 11 != 0)
    found = kept.select("l_orderkey", "ord", F.concat(F.upper("p_name"), F.lit("-"), place, F.lit(" (as built)")).alias("key"))
    return truth, found, compare.greedy_match(truth, found, ["l_orderkey"])


@query(_MATCH_SQL + """
    , m AS (SELECT l_orderkey, ord, pick FROM step WHERE ord > 0)
    SELECT f.l_orderkey, f.ord FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.l_orderkey = f.l_orderkey AND m.pick = f.ord)
""")
def extra_rows(spark, sf_dir):
    """Found rows that no true row took."""
    _, found, matched = _matched(spark, sf_dir)
    return compare.extra_rows(found, matched, ["l_orderkey"]).select("l_orderkey", "ord")


@query("""
    SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, ts, event_id) = 1
""")
def scoreboard_dedup_best(spark, sf_dir):
    """The best row of each project; the first of equal ones."""
    best = scoreboard.best_of_each(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value", [F.asc("ts"), F.asc("event_id")])
    return best.select("event_id", "user_id", "event_type", "value")


_PROJECTS = """
    p AS (SELECT user_id AS project, count(*) FILTER (event_type <> 'click') AS total_cells, count(*) FILTER (event_type <> 'click' AND value > 10) AS matching_cells FROM events GROUP BY 1),
    q AS (SELECT *, coalesce(100.0 * matching_cells / nullif(total_cells, 0), 0) AS overall FROM p)"""


def _projects(spark, sf_dir) -> DataFrame:
    other = F.col("event_type") != "click"
    cells = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("project")).agg(
        F.count_if(other).alias("total_cells"), F.count_if(other & (F.col("value") > 10)).alias("matching_cells")
    )
    return cells.withColumn("overall", compare.accuracy(F.col("matching_cells"), F.col("total_cells")))


@query(f"""
    WITH {_PROJECTS}
    SELECT count(*) AS projects, round(coalesce(avg(overall) FILTER (total_cells > 0), 0), 4) AS mean_accuracy,
           round(coalesce(100.0 * sum(matching_cells) / nullif(sum(total_cells), 0), 0), 4) AS cell_accuracy FROM q
""")
def scoreboard_summary(spark, sf_dir):
    """Mean accuracy of projects and accuracy over all cells."""
    return scoreboard.summary(_projects(spark, sf_dir)).select("projects", *[F.round(c, 4).alias(c) for c in ("mean_accuracy", "cell_accuracy")])


@query(f"""
    WITH {_PROJECTS}
    SELECT round(avg(overall), 4) AS mean, round(list(overall ORDER BY overall DESC)[count(*) // 2 + 1], 4) AS median,
           (SELECT project FROM q ORDER BY overall DESC, project LIMIT 1) AS best, (SELECT project FROM q ORDER BY overall, project DESC LIMIT 1) AS worst FROM q
""")
def scoreboard_spread(spark, sf_dir):
    """Mean, lower median, best and worst project."""
    return scoreboard.spread(_projects(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("mean", "median")})


@query(f"WITH {_PROJECTS} SELECT project, total_cells, matching_cells, round(overall, 4) AS overall FROM q WHERE overall < 95 AND total_cells > 0 ORDER BY q.overall, project LIMIT 5")
def worst_projects(spark, sf_dir):
    """The five failing projects with the lowest accuracy."""
    return learning.failing(_projects(spark, sf_dir), 5).withColumn("overall", F.round("overall", 4))


@query("SELECT event_type, list(value ORDER BY value DESC)[count(*) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY 1")
def median_lower_desc(spark, sf_dir):
    """The middle of each descending list, without interpolation."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(scoreboard.lower_median("value").alias("median"))


_SEWER = DEFAULT_PARAMS["sewers"]
_PRICE = "CASE dia " + " ".join(f"WHEN {d} THEN {p}" for d, p in costs.SEWER_PRICES.items()) + f" ELSE {costs.OTHER_SEWER_PRICE} END"


@query(f"""
    WITH r AS (SELECT l_orderkey, l_quantity AS len, {_snapped('p_size * 15.0')} AS dia, l_discount * 20 AS depth FROM lineitem JOIN part ON p_partkey = l_partkey),
    c AS (SELECT l_orderkey, len, ({_SEWER['dayCostPerDay']} + {_SEWER['extraPerDay']}) * (len / {_SEWER['productionMPerDay']}) + len * {_PRICE}
                 + greatest({_SEWER['minTrenchWidth']}, dia * 0.0025 + 0.6) * (depth + 0.1 + dia * 0.00125) * len * {_SEWER['truckingPerCM']} AS cost FROM r)
    SELECT l_orderkey, sum(len) AS sewer_length, round(sum(cost), 6) AS sewer_total, round(sum(cost) * {_SEWER['marginFactor']}, 6) AS grand_total FROM c GROUP BY 1
""")
def run_cost_rollup(spark, sf_dir):
    """Sewer costs of each order, with margin."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), pipes.standard_diameter(F.col("p_size") * 15.0).alias("dia"))
    params = F.struct(*[F.lit(v).alias(k) for k, v in _SEWER.items()])
    rows = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    cost = costs.sewer_cost(F.col("l_quantity"), F.col("dia"), F.col("l_discount") * 20, params)
    sums = rows.select("l_orderkey", "l_quantity", cost.alias("cost")).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sewer_length"), F.sum("cost").alias("_c"))
    return sums.select("l_orderkey", "sewer_length", F.round("_c", 6).alias("sewer_total"), F.round(F.col("_c") * _SEWER["marginFactor"], 6).alias("grand_total"))


_MANHOLE, _WATERMAIN = DEFAULT_PARAMS["manholes"], DEFAULT_PARAMS["watermain"]


@query(f"""
    WITH r AS (
        SELECT l_orderkey, l_returnflag AS k, l_linenumber = 1 AS fee, l_quantity AS q, {_snapped('p_size * 15.0')} AS dia, l_discount * 20 AS depth,
               CASE WHEN l_discount > 0.02 THEN 2.0 + l_tax * 10 ELSE 2.0 END AS deep, l_tax * 100 AS extra FROM lineitem JOIN part ON p_partkey = l_partkey),
    c AS (
        SELECT l_orderkey,
               CASE WHEN k = 'N' AND NOT fee THEN ({_SEWER['dayCostPerDay']} + {_SEWER['extraPerDay']}) * (q / {_SEWER['productionMPerDay']}) + q * {_PRICE}
                    + greatest({_SEWER['minTrenchWidth']}, dia * 0.0025 + 0.6) * (depth + 0.1 + dia * 0.00125) * q * {_SEWER['truckingPerCM']} ELSE 0 END AS s,
               CASE WHEN k = 'A' THEN deep * 500 + 400 + {_MANHOLE['laborPerHr']} * (15 + deep * 5) + deep * 0.5 * {_MANHOLE['truckingPerCM']} + extra + 7 ELSE 0 END AS m,
               CASE WHEN k = 'R' AND NOT fee THEN ({_WATERMAIN['dayCostPerDay']} + {_WATERMAIN['extraPerDay']}) * (q / {_WATERMAIN['productionMPerDay']})
                         + q * CASE dia WHEN 100 THEN 32 WHEN 150 THEN 51 WHEN 200 THEN 84 WHEN 250 THEN 156 WHEN 300 THEN 194 ELSE 84 END
                    WHEN k = 'R' THEN 2 * (q + 100 + 30) + (extra + 285 + 150 + 150) ELSE 0 END AS w,
               CASE WHEN k = 'N' AND NOT fee THEN q ELSE 0 END AS sl, CASE WHEN k = 'A' THEN 1 ELSE 0 END AS mc, CASE WHEN k = 'R' AND NOT fee THEN q ELSE 0 END AS wl
        FROM r)
    SELECT l_orderkey AS project, round(sum(s), 6) AS sewer_total, round(sum(m), 6) AS manhole_total, round(sum(w), 6) AS watermain_total, sum(sl) AS sewer_length,
           sum(mc)::INTEGER AS manhole_count, sum(wl) AS watermain_length, round(sum(s) + sum(m) + sum(w), 6) AS subtotal,
           CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE round((sum(s) + sum(m) + sum(w)) * {_SEWER['marginFactor']}, 6) END AS grand_total
    FROM c GROUP BY l_orderkey
""")
def quote_totals(spark, sf_dir):
    """Quotes of records that are built from each order's lines; an override of 0 counts."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), pipes.standard_diameter(F.col("p_size") * 15.0).alias("dia"))
    kind, fee, q, extra = F.col("l_returnflag"), F.col("l_linenumber") == 1, F.col("l_quantity"), F.col("l_tax") * 100
    number = lambda v: F.lit(float(v))
    sewer = F.struct(fee.alias("isLineItem"), q.alias("length"), F.col("dia").alias("pipeDiameter"), (F.col("l_discount") * 20).alias("depth"))
    top = F.when(F.col("l_discount") > 0.02, F.col("l_tax") * 10 + 102.0).otherwise(0.0)
    manhole = F.struct(top.alias("topElevation"), number(100).alias("lowInvert"), extra.alias("addMaterials"), number(7).alias("addLE"))
    run = F.struct(q.alias("length"), F.col("dia").alias("pipeDiameter"))
    special = F.struct(number(2).alias("quantity"), q.alias("costEach"), number(100).alias("anodeCost"), number(30).alias("laborEach"))
    valve = F.struct(number(1).alias("quantity"), extra.alias("valveCost"), number(285).alias("boxCost"), number(150).alias("anodeCost"), number(150).alias("laborPerValve"))
    lists = {
        "sewers": F.when(kind == "N", sewer), "manholes": F.when(kind == "A", manhole), "watermain": F.when((kind == "R") & ~fee, run),
        "watermainSpecials": F.when((kind == "R") & fee, special), "watermainValves": F.when((kind == "R") & fee, valve),
    }
    records = read(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("project")).agg(*[F.collect_list(v).alias(k) for k, v in lists.items()])
    params = F.struct(*[F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]).alias(s) for s, fields in DEFAULT_PARAMS.items()])
    quotes = costs.quote(records.withColumns({"params": params, "total_override": F.when(F.col("project") % 50 == 0, 0.0)}))
    return quotes.drop("markup").withColumns({c: F.round(c, 6) for c in ("sewer_total", "manhole_total", "watermain_total", "subtotal", "grand_total")})


@query("""
    WITH n AS (SELECT l_orderkey, count(*) AS n, coalesce(sum(CASE WHEN l_linenumber <> 1 THEN l_quantity END), 0) AS len FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n + 1 AS item, 'VIDEO ($25/m)' AS runLabel, len * 25 AS addMaterials FROM n
    UNION ALL SELECT l_orderkey, n + 3, 'LAYOUT', 5000 FROM n UNION ALL SELECT l_orderkey, n + 5, 'AS BUILT', 5000 FROM n
""")
def append_fee_rows(spark, sf_dir):
    """Three fee rows for each order."""
    return costs.fee_rows(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", F.col("l_linenumber") == 1)


@query(r"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = 1 AS fee, l_quantity - 3 AS length, l_extendedprice / 5000 AS depth, l_tax * 200 AS slope,
                      'Sewer ' || l_orderkey || '-' || l_linenumber || ': ' AS name FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, name || 'zero or negative length' AS warning FROM r WHERE NOT fee AND length <= 0
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, name || 'unusual depth ' || regexp_replace(depth::VARCHAR, '\.0$', '') || 'm (outside 0.5-10m range)' FROM r WHERE NOT fee AND depth > 0 AND (depth < 0.5 OR depth > 10)
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, name || 'slope ' || regexp_replace(slope::VARCHAR, '\.0$', '') || '% seems too high — may be ‰ not %' FROM r WHERE NOT fee AND slope > 10
""")
def validation_warnings(spark, sf_dir):
    """Warnings about lines taken as sewer runs."""
    run = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("runLabel"), (F.col("l_linenumber") == 1).alias("isLineItem"), (F.col("l_quantity") - 3).alias("length"),
        (F.col("l_extendedprice") / 5000).alias("depth"), F.lit(100.0).alias("pipeDiameter"), (F.col("l_tax") * 200).alias("slope"),
    )
    rows = read(spark, sf_dir, "lineitem").withColumn("run", run)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.filter(validate.sewer_warnings(F.col("run")), lambda w: w.isNotNull())).alias("warning"))


@query("""
    SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_nationkey * 1.5 ELSE 110.0 END::DOUBLE AS "laborPerHr", CASE WHEN n_regionkey = 2 THEN 0.0 ELSE 1.1 END::DOUBLE AS "marginFactor",
           10.0::DOUBLE AS "truckingPerCM" FROM nation
""")
def param_override_merge(spark, sf_dir):
    """Default parameters with each nation's overrides; an override of 0 counts."""
    given = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("laborPerHr"), F.col("n_nationkey") * 1.5)).when(
        F.col("n_regionkey") == 2, F.create_map(F.lit("marginFactor"), F.lit(0.0))
    )
    empty = F.create_map().cast("map<string,double>")
    merged = costs.merged_params(DEFAULT_PARAMS["manholes"], F.coalesce(given.cast("map<string,double>"), empty))
    return read(spark, sf_dir, "nation").select("n_nationkey", merged.alias("p")).select("n_nationkey", "p.laborPerHr", "p.marginFactor", "p.truckingPerCM")


_SCORE = "CASE WHEN contains(name, '/en') OR contains(name, '/fr') THEN 1000 ELSE 0 END + CASE WHEN contains(name, 'ref=') OR contains(name, '#top') THEN -500 ELSE 0 END"


@query(f"""
    WITH f AS (SELECT page_id, split_part(url, '/', 3) AS project, lower(url) AS name, url, length(coalesce(html, '')) AS size FROM pages),
    s AS (SELECT *, {_SCORE} AS score FROM f WHERE NOT contains(name, 'm.'))
    SELECT project, url AS name, size, score FROM s QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, size DESC, url) = 1
""")
def file_score_pick(spark, sf_dir):
    """The best file of each host by words in its name and its size."""
    files = read(spark, sf_dir, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("project"), F.col("url").alias("name"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("size")
    )
    rule = discovery.FileRule("", ("m.",), ("/en", "/fr"), ("ref=", "#top"))
    return discovery.picked(files, rule).select("project", "name", "size", "score")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def skip_existing(spark, sf_dir):
    """Documents without an output; labels of good quality stand for outputs, others for other files."""
    made = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.when(F.col("quality") == 1, "eval_").otherwise("draft_"), F.col("doc_id").cast("string")).alias("name"))
    return discovery.without_output(read(spark, sf_dir, "documents").select("doc_id", "source"), made, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def golden_subset(spark, sf_dir):
    """Documents on a list of names."""
    names = read(spark, sf_dir, "labels").where("quality = 0")
    return discovery.only_named(read(spark, sf_dir, "documents").select("doc_id", "source"), names, "doc_id")


def _word_sql(text: str, more: int) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-zA-Z0-9_]+'), lambda w: length(w) > {more}))"


@query(f"""
    WITH r AS (SELECT item_id, {_word_sql('text', 3)} AS w FROM benchmark)
    SELECT a.item_id, b.item_id AS duplicate_of, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS overlap
    FROM r a JOIN r b ON b.item_id < a.item_id WHERE len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) > 0.1
""")
def rule_dedup_overlap(spark, sf_dir):
    """Pairs of texts that share many words."""
    return learning.overlapping_rules(read(spark, sf_dir, "benchmark"), "item_id", "text", 0.1).withColumn("overlap", F.round("overlap", 6))


@query(f"""
    WITH e AS (SELECT item_id, text, {_word_sql('text', 2)} AS d FROM benchmark),
    t AS (SELECT doc_id, coalesce(text, '') AS text, {_word_sql("coalesce(text, '')", 2)} AS w FROM documents),
    tw AS (SELECT doc_id, unnest(w) AS word FROM t), ew AS (SELECT item_id, unnest(d) AS word FROM e),
    n AS (SELECT doc_id, item_id, count(*) AS a FROM tw JOIN ew USING (word) GROUP BY 1, 2),
    s AS (SELECT t.doc_id, e.item_id, coalesce(n.a, 0) AS a, contains(lower(t.text), lower(e.text)) AS own FROM t CROSS JOIN e LEFT JOIN n ON n.doc_id = t.doc_id AND n.item_id = e.item_id),
    k AS (SELECT doc_id AS target, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, item_id) AS rank, item_id AS example, a * 1.5 AS score FROM s WHERE a < 3 AND NOT own)
    SELECT target, rank::INTEGER AS rank, example, score FROM k WHERE rank <= 3
""")
def example_top3(spark, sf_dir):
    """The three most similar benchmark items of each document, by their whole texts, without its own."""
    items = read(spark, sf_dir, "benchmark").where("text is not null")
    examples = items.select(F.col("item_id").alias("example"), F.col("item_id").alias("ord"), F.col("text").alias("name"), F.col("text").alias("description"))
    return learning.ranked_examples(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"), F.coalesce("text", F.lit("")).alias("name")), examples)


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def fifo_keep5(spark, sf_dir):
    """The newest five of each user."""
    return ordinals.newest(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INTEGER AS shard FROM documents")
def round_robin_shard(spark, sf_dir):
    """The shard of each document in turn."""
    return ordinals.round_robin(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size > 0 GROUP BY 1")
def histogram_desc(spark, sf_dir):
    """Counts by size, the most frequent first."""
    return statistics.histogram(read(spark, sf_dir, "part"), "p_size")


@query("SELECT min(c_acctbal) AS least, max(c_acctbal) AS largest, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > 0")
def depth_range(spark, sf_dir):
    """Range and mean of positive values."""
    return statistics.positive_range(read(spark, sf_dir, "customer"), "c_acctbal").withColumn("mean", F.round("mean", 4))


@query("""
    WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k, o_orderpriority FROM orders)
    SELECT o_orderstatus, string_agg(o_orderkey || ' (' || o_orderpriority || ')', chr(10) ORDER BY k) FILTER (k <= 10) AS digest, greatest(count(*) - 10, 0) AS more FROM r GROUP BY 1
""")
def topn_diff_digest(spark, sf_dir):
    """The first ten lines of each group and how many are left."""
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(" ("), F.col("o_orderpriority"), F.lit(")"))
    return compare.diff_digest(read(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], line)


@query("""
    WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS applied, count(*) FILTER (event_type = 'purchase') AS rejected FROM events GROUP BY 1),
    r AS (SELECT *, applied / nullif(applied + rejected, 0) AS rate FROM c)
    SELECT user_id, applied, rejected, round(rate, 6) AS apply_rate, CASE WHEN applied = 0 THEN false ELSE rate >= 0.3 END AS passed,
           CASE WHEN applied = 0 THEN 'no changes' WHEN rate < 0.3 THEN 'low apply rate' ELSE 'promoted' END AS reason FROM r
""")
def gate_decision(spark, sf_dir):
    """Whether enough suggestions were applied."""
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("applied"), F.count_if(F.col("event_type") == "purchase").alias("rejected")
    )
    return learning.gate(counts).withColumn("apply_rate", F.round("apply_rate", 6))


@query("""
    WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
    c AS (SELECT n_regionkey AS project, 'B' || (i + 13) AS ref, NULL::DOUBLE AS num, n_name AS text, false AS force FROM n WHERE i <= 4
          UNION ALL SELECT n_regionkey, 'C' || (i + 13), nullif(n_nationkey, 0), NULL, false FROM n WHERE i <= 4
          UNION ALL SELECT n_regionkey, 'G' || (i + 13), nullif(n_nationkey % 3, 0), NULL, true FROM n WHERE i <= 4)
    SELECT project, 'SEWERS (1)' AS sheet, ref, num, text, force FROM c WHERE num IS NOT NULL OR text IS NOT NULL
""")
def sheet_cell_unpivot(spark, sf_dir):
    """Rows as cells of a sheet, in order, without those beyond its block."""
    row = F.struct("n_nationkey", F.col("n_name").alias("runLabel"), F.col("n_nationkey").cast("double").alias("length"), (F.col("n_nationkey") % 3).cast("double").alias("depth"))
    records = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("project")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    columns = tuple(c for c in layout.BLOCKS["sewers"][3] if c[1] in ("runLabel", "length", "depth"))
    cells = layout.rows_to_cells(F.col("rows"), "SEWERS (1)", 14, 17, columns)
    return records.select("project", F.inline(cells)).where("num is not null or text is not null")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def content_hash_manifest(spark, sf_dir):
    """The content key of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return files.content_keys(docs).select("doc_id", "sha256", F.octet_length("content").cast("long").alias("size"))


_LINE = """'"' || p_name || CASE WHEN p_partkey % 5 = 0 THEN ', PHASE 2' ELSE '' END || '",1.5,N/A,2.5,3.5,' || p_size || ',' || p_size || ',0'"""


@query(f"""
    WITH l AS (SELECT p_partkey, string_split({_LINE}, ',') AS f FROM part)
    SELECT p_partkey, trim(f[1], '"') AS project, TRY_CAST(trim(f[6]) AS DOUBLE) AS overall, TRY_CAST(trim(f[7]) AS INTEGER) AS total_cells FROM l
""")
def split_csv_naive(spark, sf_dir):
    """Fields of lines split at every comma."""
    name = F.concat(F.lit('"'), F.col("p_name"), F.when(F.col("p_partkey") % 5 == 0, ", PHASE 2").otherwise(""), F.lit('"'))
    size = F.col("p_size").cast("string")
    line = F.concat(name, F.lit(",1.5,N/A,2.5,3.5,"), size, F.lit(","), size, F.lit(",0"))
    return read(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in naive_fields(line).items()])


@query("""
    SELECT event_type, round(CASE WHEN a = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - abs(p - a) * 1.0 / a END, 6) AS count_accuracy
    FROM (SELECT event_type, count(*) AS a, count(DISTINCT user_id) AS p FROM events GROUP BY 1)
""")
def count_accuracy(spark, sf_dir):
    """Agreement of two counts."""
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("a"), F.countDistinct("user_id").alias("p"))
    return counts.select("event_type", F.round(statistics.count_accuracy(F.col("p"), F.col("a")), 6).alias("count_accuracy"))


@query("""
    WITH r AS (SELECT p_partkey, lower(trim(p_brand)) AS k, p_size FROM part), s AS (
        SELECT k, p_size FROM (SELECT lower(trim(upper(p_brand) || ' ')) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE chr(32) || chr(9) || ' b' END AS k, p_size, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY k ORDER BY p_partkey) = 1)
    SELECT p_partkey, r.p_size, s.p_size AS found_p_size FROM r LEFT JOIN s USING (k)
""")
def first_label_join(spark, sf_dir):
    """Rows with the value of the first row of the same label."""
    part = read(spark, sf_dir, "part").withColumn("all", F.lit(1))
    found = part.withColumn("p_brand", F.concat(F.upper("p_brand"), F.lit(" \t"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" B")))
    return statistics.label_join(part, found, ["all"], "p_brand", "p_partkey", "p_size").select("p_partkey", "p_size", "found_p_size")


@query(r"""
    SELECT page_id, translate(CASE WHEN strpos(url, '.example') > 0 THEN left(url, strpos(url, '.example') - 1) || substr(url, strpos(url, '.example') + 8) ELSE url END, '-_', '  ') AS shown,
           regexp_replace(url, '[^a-zA-Z0-9\-_ ]', '', 'g') AS safe FROM pages
""")
def file_names(spark, sf_dir):
    """Names for display and for files; the host's ending stands for the file's here."""
    shown = display.project_name(F.regexp_replace("url", r"^(.*?)\.example", "$1.pdf"))
    return read(spark, sf_dir, "pages").select("page_id", shown.alias("shown"), display.safe_name(F.col("url")).alias("safe"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal = 0 AND signbit(c_acctbal) THEN '$-' ELSE '$' END || format('{:,.2f}', abs(c_acctbal)) AS amount FROM customer")
def currency_text(spark, sf_dir):
    """Amounts as text; a zero below nothing keeps its sign."""
    return read(spark, sf_dir, "customer").select("c_custkey", display.currency(F.col("c_acctbal")).alias("amount"))


@query(f"""
    SELECT doc_id, len(list_intersect({_word_sql("coalesce(d.text, '')", 2)}, {_word_sql("coalesce(b.text, '')", 2)})) AS shared
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
""")
def shared_words_whole(spark, sf_dir):
    """Words that each document's whole text shares with the whole text of a benchmark item, for all rows."""
    items = read(spark, sf_dir, "benchmark")
    item = items.select(F.col("item_id").alias("_item"), F.col("text").alias("_other"))
    docs = read(spark, sf_dir, "documents").crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("_n"))))
    both = docs.join(item, F.try_mod("doc_id", "_n") == F.col("_item"), "left")
    words = (tokens.word_set(F.coalesce(c, F.lit("")), 2) for c in ("text", "_other"))
    return both.select("doc_id", tokens.shared_words(*words).alias("shared"))


@query(r"""
    WITH k AS (SELECT p_partkey, [p_name || ' ' || p_size, p_name, '(note) ', p_brand, p_name][p_size % 5 + 1] AS a,
                      [upper(p_name) || '-' || p_size || ' (new)', 'the ' || p_name || E'\t', p_name, p_brand || '1', p_type][p_size % 5 + 1] AS b FROM part),
    n AS (SELECT p_partkey, trim(lower(regexp_replace(a, '\(.*?\)', '', 'g')), E' \t') AS a, trim(lower(regexp_replace(b, '\(.*?\)', '', 'g')), E' \t') AS b FROM k),
    x AS (SELECT *, regexp_replace(a, '[^a-z0-9]', '', 'g') AS pa, regexp_replace(b, '[^a-z0-9]', '', 'g') AS pb, regexp_replace(a, '[^0-9]', '', 'g') AS da, regexp_replace(b, '[^0-9]', '', 'g') AS db FROM n)
    SELECT p_partkey, a = b OR pa = pb OR ((contains(pa, pb) OR contains(pb, pa)) AND da = db) AS same FROM x
""")
def keys_match(spark, sf_dir):
    """Keys that name the same thing: equal ones, longer ones, empty ones, other numbers and other words."""
    size = F.col("p_size").cast("string")
    at = lambda *c: F.element_at(F.array(*c), F.col("p_size") % 5 + 1)
    a = at(F.concat_ws(" ", "p_name", size), F.col("p_name"), F.lit("(note) "), F.col("p_brand"), F.col("p_name"))
    b = at(F.concat(F.upper("p_name"), F.lit("-"), size, F.lit(" (new)")), F.concat(F.lit("the "), "p_name", F.lit("\t")), F.col("p_name"), F.concat("p_brand", F.lit("1")), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", matching.keys_match(a, b).alias("same"))
