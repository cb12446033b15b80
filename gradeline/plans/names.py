"""Queries that match names without a group: all rows are one group."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.operators import compare, pairing
from gradeline.plans.registry import query, read

_NAMES_SQL = r"""
    t AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE p_name || ' ' || (p_partkey % 700) END AS key FROM part),
    f AS (SELECT 10000000 - p_partkey AS ord, CASE WHEN p_partkey % 17 = 0 THEN 'The ' || p_name ELSE upper(p_name) || '-' || (p_partkey % 700) || ' (as built)' END AS key FROM part WHERE p_partkey % 11 <> 0),
    tb AS (SELECT ord, regexp_replace(trim(lower(regexp_replace(key, '\(.*?\)', '', 'g'))), '[^a-z0-9]', '', 'g') AS bare FROM t),
    fb AS (SELECT ord, regexp_replace(trim(lower(regexp_replace(key, '\(.*?\)', '', 'g'))), '[^a-z0-9]', '', 'g') AS bare FROM f),
    td AS (SELECT DISTINCT bare, regexp_replace(bare, '[^0-9]', '', 'g') AS digits FROM tb),
    fd AS (SELECT DISTINCT bare, regexp_replace(bare, '[^0-9]', '', 'g') AS digits FROM fb),
    linked AS (SELECT td.bare, fd.bare AS other FROM td JOIN fd ON td.digits = fd.digits AND (contains(td.bare, fd.bare) OR contains(fd.bare, td.bare)))"""


def _names(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    place = (k % 700).cast("string")
    truth = part.select(F.lit(1).alias("all"), k.alias("ord"), F.when(k % 13 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", place)).alias("key"))
    changed = F.when(k % 17 == 0, F.concat(F.lit("The "), "p_name")).otherwise(F.concat(F.upper("p_name"), F.lit("-"), place, F.lit(" (as built)")))
    return truth, part.where(k % 11 != 0).select(F.lit(1).alias("all"), (10_000_000 - k).alias("ord"), changed.alias("key"))


@query(f"WITH {_NAMES_SQL} SELECT bare, other FROM linked")
def names_linked(spark, sf_dir):
    """Distinct names of parts and the changed names that they match, found by their rarest pieces."""
    truth, found = _names(spark, sf_dir)
    return pairing.linked_keys(truth, found, [])


@query(f"""
    WITH RECURSIVE {_NAMES_SQL},
    choices AS (SELECT tb.ord, list(fb.ord ORDER BY fb.ord) AS c FROM tb JOIN linked USING (bare) JOIN fb ON fb.bare = linked.other GROUP BY 1),
    turns AS (SELECT *, row_number() OVER (ORDER BY ord) AS turn FROM choices),
    step AS (
        SELECT 0::BIGINT AS turn, NULL::BIGINT AS ord, []::BIGINT[] AS used, NULL::BIGINT AS pick
        UNION ALL
        SELECT c.turn, c.ord, CASE WHEN p.pick IS NULL THEN s.used ELSE list_append(s.used, p.pick) END, p.pick
        FROM step s JOIN turns c ON c.turn = s.turn + 1, LATERAL (SELECT list_filter(c.c, lambda x: NOT list_contains(s.used, x))[1] AS pick) p)
    SELECT t.ord, step.pick AS match FROM t LEFT JOIN step ON step.ord = t.ord
""")
def names_paired(spark, sf_dir):
    """All parts and their changed names paired one to one, in order, as one group of any size."""
    truth, found = _names(spark, sf_dir)
    return compare.greedy_match(truth, found, ["all"]).select("ord", "match")
