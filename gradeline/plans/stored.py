"""Queries that write files with the library's sinks and read them with its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.operators import learning, publish, scoreboard
from gradeline.operators.ordinals import numbered
from gradeline.plans import records
from gradeline.plans.registry import query, read
from gradeline.sources import files, scoreboards, workbooks
from gradeline.sources import records as record_source
from gradeline.stages import new_folder


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part UNION ALL SELECT -p_partkey - 1, NULL, p_brand, NULL, NULL, NULL FROM part WHERE p_size > 40")
def json_written(spark, sf_dir):
    """Rows written as JSON lines, nulls included, and read again."""
    part = read(spark, sf_dir, "part")
    none = part.where("p_size > 40").select((-F.col("p_partkey") - 1).alias("p_partkey"), "p_brand")
    path = new_folder(spark, "json")
    files.write_json(part.unionByName(none, allowMissingColumns=True), path)
    return spark.read.schema(part.schema).json(path)


@query(f"""WITH {records._BOARD}, d AS (SELECT * FROM q WHERE day = (SELECT max(day) FROM q))
    SELECT 'Project, ' || project AS project, mh_structures IS NULL AS no_structures, sewers IS NULL AS no_sewers, round(overall, 1) AS overall, total_cells::INTEGER AS total_cells, matching_cells::INTEGER AS matching_cells FROM d""")
def scoreboard_written(spark, sf_dir):
    """The newest scoreboard written as a CSV file, with commas in names and sections without cells, and read again."""
    rows = scoreboard.latest_day(records._board(spark, sf_dir)).withColumn("project", F.concat(F.lit("Project, "), "project"))
    path = new_folder(spark, "board")
    scoreboards.write_scoreboard(rows, path)
    back = scoreboards.read_scoreboards(spark, path)
    return back.select("project", F.col("mh_structures").isNull().alias("no_structures"), F.col("sewers").isNull().alias("no_sewers"), "overall", "total_cells", "matching_cells")


@query("""
    SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'purchase' THEN event_id % 3 <> 0 WHEN 'view' THEN event_id % 2 = 0 ELSE false END AS again FROM events
""")
def retryable_failures(spark, sf_dir):
    """Which failed calls are worth another attempt: too many requests, server errors and aborts are, others are not."""
    kind, k = F.col("event_type"), F.col("event_id")
    message = F.when(kind == "error", "The request was ABORTED").when(kind == "view", F.when(k % 2 == 0, "Resource exhausted, try later").otherwise("Bad request")).otherwise("failed")
    status = F.when(kind == "purchase", F.when(k % 3 == 0, 404).when(k % 3 == 1, 429).otherwise(503))
    return read(spark, sf_dir, "events").select("event_id", record_source.is_retryable(message, status).alias("again"))


@query("""
    SELECT 'prompt' AS kind, (n_nationkey + 1)::BIGINT AS place, 'Rule of ' || n_name AS text FROM nation UNION ALL SELECT 'heuristic', r_regionkey + 1, r_name FROM region
    UNION ALL SELECT 'example', row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier
""")
def state_listed(spark, sf_dir):
    """A state of rules in its first form, written as a file, read and brought to the second form, with the names of all examples."""
    names = lambda table, key, text: read(spark, sf_dir, table).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, F.concat(*text).alias("t")))), lambda x: x["t"]).alias("l"))
    prompt, heuristics = names("nation", "n_nationkey", (F.lit("Rule of "), F.col("n_name"))), names("region", "r_regionkey", (F.col("r_name"),))
    lifted = prompt.select(F.transform("l", lambda t: F.struct(t.alias("rule"))).alias("promptAdditions")).crossJoin(heuristics.select(F.col("l").alias("heuristics")))  # one row each
    path = new_folder(spark, "rules")
    lifted.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
    rules = files.read_rules(spark, path, "2024-01-01")
    return publish.learned_state(rules, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("projectName")))


@query("""
    SELECT 'brand=' || p_brand AS project, sum(octet_length(encode(p_name)) + 1)::BIGINT AS size FROM part GROUP BY 1
""")
def manifest_sizes(spark, sf_dir):
    """Sizes of the files below each project's folder, listed without reading them."""
    path = new_folder(spark, "files")
    read(spark, sf_dir, "part").select(F.col("p_name").alias("value"), F.regexp_replace("p_brand", "#", "_").alias("brand")).write.partitionBy("brand").text(path)
    found = files.manifest(spark, path, "*.txt").groupBy("project").agg(F.sum("size").cast("long").alias("size"))
    return found.select(F.regexp_replace("project", "_", "#").alias("project"), "size")


@query(f"WITH {records._RECORDS}, {records._SHEETS} SELECT path, sheet, row, col, num, text FROM c WHERE sheet = 'SEWERS (1)' AND row BETWEEN 14 AND 20")
def sheet_rows(spark, sf_dir):
    """A range of rows of one sheet of all workbooks."""
    return workbooks.row_range(records._cells(spark, sf_dir), "SEWERS (1)", 14, 20)


@query("SELECT project, accepted, rank FROM (SELECT o_orderkey AS project, o_totalprice AS accepted, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 20")
def worst_first(spark, sf_dir):
    """The twenty smallest orders as failing projects, worst first: what a limit before processing lets through."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), (F.col("o_totalprice") / 1e9).alias("overall"), F.lit(1).alias("total_cells"), F.col("o_totalprice").alias("accepted"))
    first = learning.failing(rows, 20)
    return numbered(first.select("project", "accepted", F.struct("accepted", "project").alias("_key")), [], "_key", "rank").select("project", "accepted", F.col("rank").cast("long").alias("rank"))
