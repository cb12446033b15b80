"""Connected components of a narrow edge table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.shared import delete, join_by_key, new_dir


def _stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the smallest node reachable.

    In each round a node takes the smallest label of itself and its neighbours, and then the label
    of its label, so long chains shrink by halves. Labels are written after every round; a label
    that very many nodes share is joined by broadcast, all others by shuffle.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, kept = _stored(both, "edges")
    total = both.count()
    degree = both.groupBy("b").agg(F.count(F.lit(1)).alias("group_size"))
    labels, last = _stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = join_by_key(both, labels.select(F.col("node").alias("b"), "label"), "b", degree, total)
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked, middle = _stored(
            labels.join(least, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels"
        )
        sizes = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("group_size"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = join_by_key(hooked.drop("moved"), up, "label", sizes, total)
        labels, current = _stored(jumped.select("node", F.least("label", "up").alias("label")), "labels")
        moved = not hooked.where("moved").isEmpty()
        delete(both.sparkSession, last)
        delete(both.sparkSession, middle)
        last = current
        if not moved:
            delete(both.sparkSession, kept)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("the components did not settle")
