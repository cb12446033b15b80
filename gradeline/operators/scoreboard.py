"""Scoreboards: one row for each project, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.operators.compare import accuracy


def latest_day(rows: DataFrame, day: str = "day") -> DataFrame:
    """The rows of the newest day; a broadcast of one value."""
    last = rows.agg(F.max(day).alias("_last"))
    return rows.join(F.broadcast(last), F.col(day) == F.col("_last"), "left_semi")


def best_of_each(rows: DataFrame, by: list[str], score: str, order: list) -> DataFrame:
    """The best row of each group; of equal ones the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def project_report(sections: DataFrame, by: str = "project") -> DataFrame:
    """Overall accuracy of each project from its sections' cells."""
    total, good = F.sum("total_cells"), F.sum("matching_cells")
    return sections.groupBy(by).agg(total.alias("total_cells"), good.alias("matching_cells"), accuracy(good, total).alias("overall"))


def summary(rows: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """One row: projects, mean accuracy of those with cells, accuracy over all cells, category means without missing ones."""
    filled = F.col("total_cells") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("projects"),
        F.coalesce(F.avg(F.when(filled, F.col("overall"))), F.lit(0.0)).alias("mean_accuracy"),
        accuracy(F.sum("matching_cells"), F.sum("total_cells")).alias("cell_accuracy"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in categories],
    )


def lower_median(value: str) -> Column:
    """The middle value, of two middle ones the lower, as a mergeable aggregate."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value})")


def spread(rows: DataFrame, score: str = "overall", name: str = "project") -> DataFrame:
    """Mean, lower median, best and worst project; of equal ones the first name is best and the last is worst."""
    return rows.agg(
        F.avg(score).alias("mean"),
        lower_median(score).alias("median"),
        F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("best"),
        F.max_by(name, F.struct(-F.col(score), F.col(name))).alias("worst"),
    )


def run_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("processed", "failed", "skipped")])


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of the shards, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def baseline(rows: DataFrame) -> DataFrame:
    """Mean of the rows with two numbers and at least one cell; 0 without any."""
    usable = rows.where("overall is not null and total_cells is not null and total_cells > 0")
    return usable.agg(F.coalesce(F.avg("overall"), F.lit(0.0)).alias("baseline"), F.count(F.lit(1)).alias("projects"))
