"""Places that the driver and all executors share, and other helpers for multi-stage jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.shipping import ship

_local: dict[str, str] = {}

#: A key is heavy if it has more than one in this many rows, so there are at most so many heavy keys.
HEAVY_PARTS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _local:
        _local["root"] = tempfile.mkdtemp(prefix="gradeline-")
        atexit.register(shutil.rmtree, _local["root"], ignore_errors=True)
    return "file://" + _local["root"]


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Send the package to the workers, and make Arrow batches small enough for rows with whole texts.

    The default of 10,000 rows would hold many megabytes twice for each task.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared root."""
    return f"{shared_root(spark)}/gradeline/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that a finished step no longer needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Spark drops the shuffle files of a query when it ends.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write(df: DataFrame, path: str, *parts: str) -> None:
    """Write a table to the shared root; the shuffle files behind it go."""
    with settings(df.sparkSession, TIDY):
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)


class Tables:
    """Tables that cut the lineage: written to the shared root and read again. Those of finished steps can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = new_dir(self.spark, what)
        write(df, path)
        held = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(held)] = held, path
        return held

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                delete(self.spark, self.paths.pop(id(t))[1])


def written(df: DataFrame, what: str) -> DataFrame:
    """A table that stays until the shared folder is cleared."""
    return Tables(df.sparkSession).keep(df, what)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_by_key(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """Inner join where ``right`` has one row for each key and ``left`` may have very many.

    ``sizes`` has (key, group_size). A key with more than 1/1000 of ``total`` rows, of which
    there are fewer than 1000, is joined by broadcast; all others by shuffle, so no task gets
    more than its share. ``right`` must be narrow.
    """
    least = max(total // HEAVY_PARTS, 1)
    heavy_keys = sizes.where(F.col("group_size") > least).select(key)
    heavy = right.join(F.broadcast(heavy_keys), key, "left_semi")
    light = right.join(F.broadcast(heavy_keys), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(
        left.join(F.broadcast(heavy_keys), key, "left_anti").join(light.hint("merge"), key)
    )
