"""Scoreboard files: a CSV for each day and task, with N/A for sections without cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.functions.display import scoreboard_date
from gradeline.functions.values import number_prefix, trimmed

COLUMNS = ("mh_structures", "mh_catchbasins", "sewers", "watermain", "overall")
SCHEMA = "project string, " + ", ".join(f"{c} double" for c in COLUMNS) + ", total_cells int, matching_cells int"
HEADER = "Project,MH_Structures,MH_Catchbasins,Sewers,Watermain,Overall,TotalCells,MatchingCells"


def quoted_fields(line: Column) -> Column:
    """Fields of a line split at commas outside quotation marks, trimmed and without the marks; an open mark reaches to the end."""
    parts = F.split(line, '"')  # every other part is inside
    mark = F.lit("\u0001")
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", "\u0001")).otherwise(p)), "")
    return F.transform(F.split(joined, mark), trimmed)


def scoreboard_fields(line: Column) -> dict[str, Column]:
    """Typed fields of a line; numbers that can't be read are 0, sections without cells NULL. ``fields`` counts them."""
    f = quoted_fields(line)
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    section = lambda i: number_prefix(F.nullif(at(i), F.lit("N/A")))
    whole = lambda i: F.coalesce(F.regexp_extract(at(i), r"^[+-]?\d+", 0).try_cast("long"), F.lit(0)).cast("int")
    sections = {c: section(i) for i, c in enumerate(COLUMNS[:-1], 1)}
    return {"project": at(0), **sections, "overall": F.coalesce(number_prefix(at(5)), F.lit(0.0)), "total_cells": whole(6), "matching_cells": whole(7), "fields": F.size(f)}


def read_scoreboards(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows with the day of their file's name and an ordinal; quoted names may hold commas. Headers and lines of fewer than 8 fields don't count."""
    lines = spark.read.text(list(paths)).select(
        trimmed(F.col("value")).alias("value"), F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at")
    )
    fields = scoreboard_fields(F.col("value"))
    rows = lines.where((F.col("value") != "") & (F.col("value") != HEADER)).select(*[c.alias(n) for n, c in fields.items()], "_file", "_at")
    return rows.where("fields >= 8").select(
        "project", *COLUMNS, "total_cells", "matching_cells", scoreboard_date(F.col("_file")).alias("day"), F.struct(F.col("_file").alias("file"), F.col("_at").alias("at")).alias("ord")
    )


def _named(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """(path, name, day) of the files of a folder, by their names alone; NULL is no folder or no such file."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.nullif(F.regexp_extract(name, r"evaluation_scoreboard_(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("day"))


def local_scoreboards(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """Rows of all files of the newest day that a file name of a folder has.

    If there is no such day, or its files have no rows, those of ``combined.csv`` in the folder count, even if there are none; without
    that file, those of the one file ``evaluation_scoreboard_<day>.csv`` of the newest day that any file name in ``root`` has.
    """
    dated = _named(spark, folder, "*evaluation_scoreboard_*.csv")
    newest = dated.agg(F.max("day")).first()[0] if dated is not None else None
    if newest:
        paths = [r["path"] for r in dated.where(F.contains("name", F.lit(newest))).select("path").collect()]  # names of one day
        rows = read_scoreboards(spark, *sorted(paths))
        if not rows.isEmpty():
            return rows
    combined = _named(spark, folder, "combined.csv")
    if combined is not None and not combined.isEmpty():
        return read_scoreboards(spark, f"{folder.rstrip('/')}/combined.csv")
    dated = _named(spark, root, "*evaluation_scoreboard_*.csv") if root else None
    newest = dated.agg(F.max("day")).first()[0] if dated is not None else None
    if not newest:
        raise FileNotFoundError(f"no scoreboards in {folder}")
    return read_scoreboards(spark, f"{root.rstrip('/')}/evaluation_scoreboard_{newest}.csv")


def naive_fields(line) -> dict:
    """Fields of a line that is split at every comma, quoted or not; a comma in a name shifts all fields."""
    f = F.split(line, ",")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    return {
        "project": F.regexp_replace(at(0), '^"|"$', ""),
        "overall": number_prefix(at(5)),
        "total_cells": number_prefix(at(6)).cast("int"),
    }


def read_scoreboards_naive(spark: SparkSession, *paths: str) -> DataFrame:
    """What a reader without quoting sees: rows whose overall accuracy is no number are dropped."""
    lines = spark.read.text(list(paths)).where((F.col("value") != HEADER) & (F.trim("value") != ""))
    return lines.select(*[c.alias(n) for n, c in naive_fields(F.col("value")).items()]).where("overall is not null and total_cells is not null")


def write_scoreboard(rows: DataFrame, path: str) -> None:
    """One CSV with accuracies of one place."""
    shown = rows.select("project", *[F.round(c, 1).alias(c) for c in COLUMNS], "total_cells", "matching_cells")
    shown.toDF(*HEADER.split(",")).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "N/A").csv(path)
