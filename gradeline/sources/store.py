"""A commit log and a store of contents in a folder of any file system that Spark knows.

An entry of a log is a small JSON file with the entry's number as its name. It is written beside and then renamed to a name
that must not exist, so of two writers that want the same number one wins and the other one learns of it. How strict that is
is up to the file system's rename: on HDFS and stores with conditional renames it is atomic.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.sources.files import content_keys


class Conflict(Exception):
    """Another writer has taken the number."""


class Log:
    """Numbered entries, put only if absent."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _renamed(self, name: str, to: str) -> None:
        """Rename a file to a name that must not exist."""
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = getattr(self._hadoop, "Options$Rename").NONE
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self._conf)
        try:
            context.rename(self._path(name), self._path(to), options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(to) from None
            raise

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def numbers(self, most: int | None = None) -> list[int]:
        """The numbers of all entries, or of the newest ones, newest first."""
        found = sorted((int(m[1]) for m in (re.fullmatch(r"v(\d+)\.json", n) for n in self._names()) if m), reverse=True)
        return found[:most]

    def get(self, number: int) -> dict:
        return json.loads(self._read(f"v{number:06d}.json"))

    def put(self, number: int, entry: dict) -> None:
        """Add an entry; ``Conflict`` if the number is taken."""
        beside = f"beside-{uuid.uuid4().hex}"
        self._write(beside, json.dumps(entry))
        try:
            self._renamed(beside, f"v{number:06d}.json")
        except BaseException:
            self._delete(beside)
            raise


class Versions:
    """Versions of a state: each writer's candidate lies beside, is promoted unless another version has come since, and older ones can come back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.log = Log(spark, folder)
        self.candidate: tuple[str, int] | None = None

    def numbers(self, most: int = 10) -> list[int]:
        """The newest versions, newest first."""
        return self.log.numbers(most)

    def current(self) -> dict:
        found = self.numbers(1)
        return self.log.get(found[0]) if found else {}

    def propose(self, state: dict) -> None:
        """Write a candidate, made from the version that is the newest now."""
        self.discard()
        name = f"candidate-{uuid.uuid4().hex}.json"
        self.candidate = name, (self.numbers(1) or [0])[0]
        self.log._write(name, json.dumps(state))

    def promote(self) -> int:
        """Make the candidate the next version; ``Conflict``, and the candidate stays, if another writer was first."""
        name, base = self.candidate
        self.log._renamed(name, f"v{base + 1:06d}.json")
        self.candidate = None
        return base + 1

    def discard(self) -> None:
        if self.candidate:
            self.log._delete(self.candidate[0])
            self.candidate = None

    def rollback(self, number: int) -> int:
        """Make an older version the newest again; a candidate goes."""
        self.propose(self.log.get(number))
        return self.promote()


class ContentStore:
    """Contents by their SHA-256, each held once.

    A batch writes the contents that no committed batch has, and then appends itself to the log. If another writer was
    first, the batch drops what that one has committed and tries the next number, so a content belongs to one batch only.
    What is not in the log was left by a writer that died, and nobody reads it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/log")

    def _batch(self, entry: dict) -> DataFrame:
        return self.spark.read.schema("sha256 string, size long, content binary").parquet(f"{self.folder}/{entry['batch']}")

    def contents(self, after: int = 0) -> DataFrame:
        """(sha256, size, content) of all batches, or of those after a number."""
        batches = [self._batch(self.log.get(n)) for n in sorted(self.log.numbers()) if n > after]
        return reduce(DataFrame.unionByName, batches) if batches else self.spark.createDataFrame([], "sha256 string, size long, content binary")

    def _written(self, rows: DataFrame) -> dict:
        name = f"batch-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return {"batch": name}

    def put(self, files: DataFrame) -> int:
        """Store the contents (content; NULL is empty) that are not there yet; how many there were."""
        seen = (self.log.numbers(1) or [0])[0]
        keyed = content_keys(files).select("sha256", F.octet_length(F.coalesce("content", F.lit(b""))).cast("long").alias("size"), F.coalesce("content", F.lit(b"")).alias("content"))
        new = keyed.join(self.contents().select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])
        entry = self._written(new)
        while True:
            count = self._batch(entry).count()
            if not count:
                self.log._fs.delete(self.log._hadoop.Path(f"{self.folder}/{entry['batch']}"), True)
                return 0
            try:
                self.log.put(seen + 1, entry)
                return count
            except Conflict:
                since, seen, old = self.contents(seen).select("sha256"), self.log.numbers(1)[0], entry
                entry = self._written(self._batch(old).join(since, "sha256", "left_anti"))
                self.log._fs.delete(self.log._hadoop.Path(f"{self.folder}/{old['batch']}"), True)
