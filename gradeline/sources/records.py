"""Raw extraction records: JSON with string leaves, one for each project or one for each stage.

The model call that makes these records is outside the engine: a replay table of
(project, stage, response_json) stands for it, and ``extract_with`` runs an injected client.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.shipping import ship


def _list(*names: str) -> str:
    return "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"


# Fields of the raw record.
MANHOLE = ("description", "topElevation", "lowInvert", "highInvert", "pipeOutDiameter", "structureType", "addMaterials", "addLE", "depth", "drop", "diameter")
CATCHBASIN = ("type", "quantity", "wallThickness", "depth", "grateEach", "addMaterials")
RATES = ("scbLabor", "dcbLabor", "dicbFC", "ddicbFC")
SEWER = ("runLabel", "isLineItem", "lineItemType", "length", "pipeDiameter", "typeClass", "slope", "depth", "addMaterials", "addLE")
WATERMAIN = ("sizeAndType", "length", "pipeDiameter", "ocSc", "addMaterials", "addLE", "avgCover")
SPECIAL = ("specialName", "quantity", "costEach", "thrustBlock", "anodeCost", "laborEach")
VALVE = ("valveSize", "quantity", "valveCost", "boxCost", "anodeCost", "laborPerValve")

RAW_SCHEMA = (
    f"projectName string, jobNumber string, date string, manholes {_list(*MANHOLE)}, "
    f"catchbasins struct<groups:{_list(*CATCHBASIN)},laborRates:struct<{','.join(f'{r}:string' for r in RATES)}>>, "
    f"sewers {_list(*SEWER)}, watermain {_list(*WATERMAIN)}, watermainSpecials {_list(*SPECIAL)}, watermainValves {_list(*VALVE)}, "
    "confidence string, warnings array<string>"
)
LISTS = {"manholes": MANHOLE, "sewers": SEWER, "watermain": WATERMAIN, "watermainSpecials": SPECIAL, "watermainValves": VALVE}
STAGES = ("locator", "manholes", "sewers", "watermain")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(project, raw) of JSON files with one record, or an array of records, each."""
    texts = spark.read.option("wholetext", True).text(path)
    one = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_colons(RAW_SCHEMA)}>>")).otherwise(F.array(F.from_json("value", RAW_SCHEMA)))
    return texts.select(F.explode(one).alias("raw")).select(F.col("raw.projectName").alias("project"), "raw")


def _colons(schema: str) -> str:
    """A column list as the field list of a struct."""
    out = []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
    return ",".join(out)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """(project, stage, response_json) from JSON lines."""
    return spark.read.schema("project string, stage string, response_json string").json(path)


def schema_of(only: dict[str, tuple[str, ...]]) -> str:
    """The raw record with its head and those lists and fields that ``only`` names; catchbasin groups are the list "groups"."""
    lists = [f"{s} {_list(*[n for n in names if n in only[s]])}" for s, names in LISTS.items() if s in only]
    if "groups" in only:
        lists.append(f"catchbasins struct<groups:{_list(*[n for n in CATCHBASIN if n in only['groups']])}>")
    return ", ".join(["projectName string, jobNumber string, date string", *lists, "confidence string, warnings array<string>"])


def parsed(responses: DataFrame, column: str = "response_json", schema: str = RAW_SCHEMA) -> DataFrame:
    """Add the raw record; a response that is no JSON gives NULL."""
    return responses.withColumn("raw", F.from_json(column, schema))


def extract_with(manifest: DataFrame, make_client: Callable[[], Callable[[str, str, bytes], str]], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Run an injected client for each drawing and stage; a failure gives its message and no response."""

    ship(manifest.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for project, content in zip(batch["project"], batch["content"], strict=True):
                for stage in stages:
                    try:
                        rows.append((project, stage, client(project, stage, content), None))
                    except Exception as e:  # one drawing must not stop the others
                        rows.append((project, stage, None, str(e)))
            yield pd.DataFrame(rows, columns=["project", "stage", "response_json", "error"])

    return manifest.select("project", "content").mapInPandas(run, "project string, stage string, response_json string, error string")


def retryable(message: str, status: int | None) -> bool:
    """Whether a failed call is worth another attempt: too many requests, an abort, or a server error."""
    low = message.lower()
    return status == 429 or (status is not None and 500 <= status < 600) or "resource exhausted" in low or "429" in low or "abort" in low


def is_retryable(message: Column, status: Column) -> Column:
    """``retryable`` of columns."""
    low = F.lower(message)
    said = F.contains(low, F.lit("resource exhausted")) | F.contains(low, F.lit("429")) | F.contains(low, F.lit("abort"))
    return F.coalesce((status == 429) | ((status >= 500) & (status < 600)), F.lit(False)) | F.coalesce(said, F.lit(False))


def with_retry(call: Callable[[], str], attempts: int = 3, first_delay: float = 10.0, sleep: Callable[[float], None] | None = None, jitter: Callable[[], float] = lambda: 0.0) -> str:
    """Call again after 1, 2, 4 ... times the first delay, if the error is retryable."""
    import time

    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not retryable(str(e), getattr(e, "status", None)):
                raise
            (sleep or time.sleep)(first_delay * 2**k + jitter())
    raise AssertionError("unreachable")
