"""A running scoreboard over files that are dropped into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeline.functions.display import scoreboard_date
from gradeline.operators.scoreboard import summary
from gradeline.sources.scoreboards import SCHEMA


def scoreboard_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    rows = spark.readStream.schema(SCHEMA).option("header", True).option("nullValue", "N/A").option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return rows.select("*", scoreboard_date(F.col("_metadata.file_name")).alias("day"))


def best_so_far(stream: DataFrame) -> DataFrame:
    """Each project's best row of each day, kept as state."""
    best = F.max_by(F.struct("overall", "total_cells", "matching_cells"), F.col("overall")).alias("best")
    return stream.groupBy("day", "project").agg(best).select("day", "project", "best.*")


def run_summaries(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the newest day's summary after every batch of files."""

    def emit(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("day").alias("_last"))
        rows = batch.join(F.broadcast(newest), F.col("day") == F.col("_last"), "left_semi")
        summary(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return best_so_far(stream).writeStream.outputMode("complete").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
