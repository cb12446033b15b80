"""Manifests of drawings and workbooks, content hashes, and JSON sources and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger drawings are not read.
LARGEST_DRAWING = 50 * 1024 * 1024
#: Larger drawings are kept in the shared store by content.
LEAST_CACHED = 4 * 1024 * 1024


def manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(project, path, name, size, modified) of the files below a folder, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return in_projects(files, root).select("project", "path", "name", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def in_projects(files: DataFrame, root: str) -> DataFrame:
    """Add project (the first folder below ``root``) and name (the base name, however deep the file lies); files in no folder are left out."""
    bare = "/" + re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", root).strip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:", ""), "^/*", "/")
    start = F.instr(below, F.lit(bare.rstrip("/") + "/"))
    rest = F.when(start > 0, F.substr(below, start + len(bare.rstrip("/")) + 1)).otherwise(F.ltrim(below, F.lit("/")))
    first = F.split_part(rest, F.lit("/"), F.lit(1))
    named = files.withColumns({"project": first, "name": F.element_at(F.split("path", "/"), -1)})
    return named.where(F.contains(rest, F.lit("/")) & (first != ""))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Names with sizes in kilobytes and times."""
    return manifest(spark, root).select("path", F.round(F.col("size") / 1024, 1).alias("kilobytes"), "modified")


def drawings(spark: SparkSession, root: str, largest: int = LARGEST_DRAWING) -> DataFrame:
    """Contents of the drawings that are not too large; the limit is applied to the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    return in_projects(files.where(F.col("length") <= largest), root).select("project", "path", "content")


def content_keys(files: DataFrame) -> DataFrame:
    """The SHA-256 of each content, which is its key in the store."""
    return files.withColumn("sha256", F.sha2(F.coalesce("content", F.lit(b"")), 256))


def uncached(files: DataFrame, stored: DataFrame, least: int = LEAST_CACHED) -> DataFrame:
    """Large contents that the store (sha256) does not have."""
    return content_keys(files).where(F.length("content") > least).join(stored.select("sha256").distinct(), "sha256", "left_anti")


def read_rules(spark: SparkSession, path: str, today: str):
    """The rules' state; an absent file is an empty state."""
    from gradeline.operators.learning import migrated

    try:
        text = spark.read.option("wholetext", True).text(path).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = None
    return migrated(json.loads(text[0]) if text else {}, today)


def rules_rows(spark: SparkSession, rules) -> DataFrame:
    """The state's lists as rows (kind, position, rule, component)."""
    rows = [(k, i, r["rule"], r.get("component")) for k, rs in (("prompt", rules.prompt), ("heuristic", rules.heuristics)) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "kind string, position int, rule string, component string")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def encoded(rows: DataFrame, *columns: str) -> DataFrame:
    """Binary columns as base64 text, with an id for the response."""
    return rows.withColumns({c: F.base64(c) for c in columns}).withColumn("id", F.uuid())
