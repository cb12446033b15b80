"""Queries over runs of the learning loop: each customer is a run, each of its orders a project with a replayed suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.operators import learning
from gradeline.plans.registry import query, read

_WORDS = ("alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing")
_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 3))"
_REPEATS = f"len(list_filter({{}}, lambda p: len(list_intersect({_SET.format('p')}, w.words)) / greatest(len({_SET.format('p')}), len(w.words)) > 0.6)) > 0"
_RUNS_SQL = f"""
    o AS (SELECT o_custkey AS run, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn,
                 'Always ' || {_LIST}[o_orderkey % 7 + 1] || ' ' || {_LIST}[o_orderkey // 7 % 5 + 1] || ' values' AS text FROM orders),
    s AS (SELECT run, k, turn, CASE WHEN k % 6 <= 2 THEN 'PROMPT_TUNING' WHEN k % 6 = 3 THEN 'ADD_HEURISTIC' WHEN k % 6 = 4 THEN 'ADD_FEW_SHOT' WHEN k % 12 <> 5 THEN 'OTHER' END AS action,
                 CASE WHEN k % 6 <= 2 AND k % 9 <> 0 THEN text WHEN k % 6 = 3 THEN 'Default: ' || text END AS rule, CASE k % 4 WHEN 0 THEN 'sewers' WHEN 3 THEN 'watermain' ELSE 'general' END AS component,
                 k % 12 = 5 AS broken, CASE WHEN k % 5 <> 0 THEN 'proj ' || (k % 3) END AS name FROM o),
    w AS (SELECT *, CASE WHEN rule IS NULL THEN [] ELSE {_SET.format('rule')} END AS words FROM s),
    step AS (
        SELECT run, 0::BIGINT AS turn, NULL::BIGINT AS k, NULL::VARCHAR AS action, NULL::VARCHAR AS reason, []::VARCHAR[] AS prompt, []::VARCHAR[] AS heuristics, []::VARCHAR[] AS names FROM (SELECT DISTINCT run FROM o)
        UNION ALL
        SELECT w.run, w.turn, w.k, CASE WHEN d.reason IN ('no JSON', 'missing sheets') THEN 'ERROR' ELSE w.action END, d.reason,
               CASE WHEN d.reason LIKE 'prompt rule%' THEN list_append(CASE WHEN len(step.prompt) >= 5 THEN step.prompt[2:] ELSE step.prompt END, w.rule) ELSE step.prompt END,
               CASE WHEN d.reason = 'heuristic' THEN list_append(step.heuristics, w.rule) ELSE step.heuristics END, CASE WHEN d.reason = 'example' THEN list_append(step.names, w.name) ELSE step.names END
        FROM step JOIN w ON w.run = step.run AND w.turn = step.turn + 1, LATERAL (SELECT CASE
            WHEN w.broken THEN 'no JSON' WHEN w.action = 'ADD_FEW_SHOT' AND w.name IS NULL THEN 'missing sheets' WHEN w.action = 'ADD_FEW_SHOT' AND len(step.names) >= 3 THEN 'examples are full'
            WHEN w.action = 'ADD_FEW_SHOT' AND list_contains(step.names, w.name) THEN 'known example' WHEN w.action = 'ADD_FEW_SHOT' THEN 'example'
            WHEN w.action = 'PROMPT_TUNING' AND w.rule IS NOT NULL THEN CASE WHEN {_REPEATS.format('step.prompt')} THEN 'duplicate rule' ELSE 'prompt rule for ' || w.component END
            WHEN w.action = 'ADD_HEURISTIC' THEN CASE WHEN {_REPEATS.format('step.heuristics')} THEN 'duplicate heuristic' ELSE 'heuristic' END ELSE 'no actionable suggestion' END AS reason) d),
    details AS (SELECT *, coalesce(reason LIKE 'prompt rule%' OR reason IN ('heuristic', 'example'), false) AS applied FROM step WHERE turn > 0)"""


def _suggested(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in _WORDS])
    word = lambda n: F.element_at(words, (n + 1).cast("int"))
    text = F.concat(F.lit("Always "), word(k % 7), F.lit(" "), word(F.floor(k / 7) % 5), F.lit(" values"))
    action = F.when(k % 6 <= 2, "PROMPT_TUNING").when(k % 6 == 3, "ADD_HEURISTIC").when(k % 6 == 4, "ADD_FEW_SHOT").otherwise("OTHER")
    made = F.to_json(F.struct(
        action.alias("action"), F.when(k % 4 == 0, "sewers").when(k % 4 == 1, "").when(k % 4 == 3, "watermain").alias("component"), F.lit("see the drawings").alias("reasoning"),
        F.when(k % 9 == 0, "").otherwise(text).alias("promptAddition"), F.concat(F.lit("Default: "), text).alias("heuristicRule"),
    ))
    name = F.concat(F.when(k % 2 == 0, "Proj ").otherwise("PROJ "), (k % 3).cast("string"))
    texts = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), k.alias("ord"), k.cast("string").alias("project"), F.when(k % 5 != 0, name).alias("example"), F.when(k % 12 == 5, "Sorry, no idea").otherwise(made).alias("suggestion_json")
    )
    return learning.suggestions(texts, keep=["run", "ord", "example"])


@query(f"WITH RECURSIVE {_RUNS_SQL} SELECT run, k AS ord, k::VARCHAR AS project, action, applied, reason FROM details")
def learning_details(spark, sf_dir):
    """What becomes of each suggestion of each run: rules that repeat, the oldest that go, examples that are full or known, errors."""
    return learning.applied_runs(_suggested(spark, sf_dir)).select("run", F.inline("details"))


@query(f"""
    WITH RECURSIVE {_RUNS_SQL},
    n AS (SELECT run, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied AND action IS DISTINCT FROM 'ERROR') AS rejected, max_by(prompt, turn) AS prompt, max_by(heuristics, turn) AS heuristics,
                 max_by(names, turn) AS names FROM details GROUP BY run), r AS (SELECT *, applied / nullif(applied + rejected, 0) AS rate FROM n)
    SELECT run, array_to_string(prompt, ' | ') AS prompt, len(heuristics)::INTEGER AS heuristics, array_to_string(names, ', ') AS examples, applied, rejected, round(rate, 6) AS apply_rate,
           CASE WHEN applied = 0 THEN false ELSE rate >= 0.3 END AS passed, CASE WHEN applied = 0 THEN 'no changes' WHEN rate < 0.3 THEN 'low apply rate' ELSE 'promoted' END AS reason FROM r
""")
def learning_runs(spark, sf_dir):
    """The rules and examples of each run after its suggestions, and whether the gate lets them pass."""
    runs = learning.applied_runs(_suggested(spark, sf_dir))
    told = runs.select("run", F.array_join(F.transform("prompt", lambda r: r["rule"]), " | ").alias("prompt"), F.size("heuristics").alias("heuristics"), F.array_join("examples", ", ").alias("examples"), "applied", "rejected")
    return learning.gate(told).withColumn("apply_rate", F.round("apply_rate", 6))
