"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.stages import cut


def global_position(df: DataFrame, order: str, into: str = "position") -> DataFrame:
    """Add the position (from 0) of each row by a column, however many rows there are and however its values are spread."""
    return numbered(df, [], order, into).withColumn(into, (F.col(into) - 1).cast("long"))


def round_robin(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Add the shard of each row: its position modulo the number of shards."""
    return global_position(df, order).withColumn("shard", (F.col("position") % shards).cast("int")).drop("position")


def newest(df: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The newest rows of each group, as a queue that drops its oldest entry for each new one."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def pushed(queue, entry, most: int):
    """A queue column with one more entry; a full one loses its oldest, an overfull one stays overfull."""
    kept = F.when(F.size(queue) >= most, F.slice(queue, 2, F.greatest(F.size(queue) - 1, F.lit(0)))).otherwise(queue)
    return F.concat(kept, F.array(entry))


def numbered(df: DataFrame, by: list[str], order: str, into: str) -> DataFrame:
    """Add the place (from 1) of each row in its group by ``order``, for groups of any size.

    Rows are dealt by ranges of group and order, so a large group lies on many tasks; each task numbers its own rows of
    a group, and only the numbers of rows by task and group are summed up in order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *by, order).withColumn("_lane", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*by, "_lane").orderBy(order))
    sizes = dealt.groupBy(*by, "_lane").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_lane")) - F.col("_n")).where("_before > 0").drop("_n")
    placed = dealt.withColumn("_inside", inside).join(before, [*by, "_lane"], "left")
    return placed.withColumn(into, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_lane", "_inside", "_before")
