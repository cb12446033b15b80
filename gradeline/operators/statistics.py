"""Statistics of record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions.values import trimmed
from gradeline.operators.ordinals import numbered
from gradeline.stages import cut


#: Sheets that a whole workbook has.
REQUIRED_SHEETS = ("MANHOLES (1)", "SEWERS (1)")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Counts of positive values, the most frequent first, then the smallest."""
    return rows.where(F.col(value) > 0).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(value))


def positive_range(rows: DataFrame, value: str) -> DataFrame:
    """Least, largest and mean of the positive values."""
    return rows.where(F.col(value) > 0).agg(F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean"))


def dataset_totals(records: DataFrame) -> DataFrame:
    """One row of totals over normalised records with has_pdf."""
    lengths = F.aggregate("sewers", F.lit(0.0), lambda a, s: a + F.coalesce(s["length"], F.lit(0.0)))
    return records.agg(
        F.count(F.lit(1)).alias("projects"), F.sum(F.size("manholes")).alias("manholes"), F.sum(F.size("sewers")).alias("sewers"),
        F.sum(F.size("watermain")).alias("watermain"), F.sum(lengths).alias("sewer_length"), F.count_if("has_pdf").alias("with_pdf"),
    )


def count_accuracy(predicted: Column, actual: Column) -> Column:
    """1 less the relative error of a count; 1 for none of none, 0 for some of none. It may be negative."""
    return F.when(actual == 0, F.when(predicted == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.abs(predicted - actual) * 1.0, actual))


def first_labels(rows: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """The first row of each label in trimmed lower case."""
    keyed = rows.withColumn("_label", F.lower(trimmed(F.col(label))))
    rank = F.row_number().over(Window.partitionBy(*by, "_label").orderBy(order))
    return keyed.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def label_join(truth: DataFrame, found: DataFrame, by: list[str], label: str, order: str, value: str) -> DataFrame:
    """Each true row with the value of the first found row of its label; one found row may serve several."""
    right = first_labels(found, by, label, order).select(*by, "_label", F.col(value).alias(f"found_{value}"))
    return truth.withColumn("_label", F.lower(trimmed(F.col(label)))).join(right, [*by, "_label"], "left").drop("_label")


def profile_means(records: DataFrame) -> DataFrame:
    """Mean sizes, and projects with catchbasins and with watermain."""
    return records.agg(
        F.avg(F.size("manholes")).alias("manholes"), F.avg(F.size("sewers")).alias("sewers"), F.avg(F.size("watermain")).alias("watermain"),
        F.count_if(F.size("catchbasins.groups") > 0).alias("with_catchbasins"), F.count_if(F.size("watermain") > 0).alias("with_watermain"),
    )


def by_complexity(records: DataFrame) -> DataFrame:
    """(project, place): records with the most sewers and manholes first."""
    key = F.struct((-(F.size("sewers") + F.size("manholes"))).alias("less"), "project")
    keys = cut(records.select("project", key.alias("_key")))  # dealing rows by ranges reads them twice, and records are much work
    return numbered(keys, [], "_key", "place").select("project", "place")


def example_candidates(records: DataFrame, keep: int = 10) -> DataFrame:
    """Records with a drawing and catchbasins and 3 to 20 sewer rows, the first few."""
    good = F.col("has_pdf") & (F.size("catchbasins.groups") > 0) & F.size("sewers").between(3, 20)
    return records.where(good).orderBy("project").limit(keep)


def complete_workbooks(cells: DataFrame, sheets: tuple[str, ...] = REQUIRED_SHEETS, by: str = "path") -> DataFrame:
    """Paths of workbooks that have all required sheets."""
    return cells.groupBy(by).agg(*[F.max(F.col("sheet") == s).alias(f"_{i}") for i, s in enumerate(sheets)]).where(
        " and ".join(f"_{i}" for i in range(len(sheets)))
    ).select(by)
