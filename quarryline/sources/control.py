"""Small tables that runs leave to each other: versions, a pointer for each, and a check for conflicts.

A version is a folder of its own. It counts once a pointer with its number exists, and a number can
be taken once, so of two writers that read the same version one wins and the other is told. What is
absent or cannot be read is no version: a reader goes on to the one before, and finds an empty table
if there is none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions that are kept; a reader of an older one has to be done by then.
KEPT = 5


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class ControlTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/pointers")
        if not self._store.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._store.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def read(self) -> tuple[int, DataFrame]:
        """(number, rows) of the newest version that can be read; 0 and no rows if none can."""
        for version in reversed(self.versions()):
            try:
                named = self.spark.read.text(f"{self.path}/pointers/{version:012d}").first()
                rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{named[0]}")
                rows.limit(1).collect()
                return version, rows
            except Exception:  # noqa: BLE001  whatever is wrong with a version, the one before it counts
                continue
        return 0, self.spark.createDataFrame([], self.schema)

    def was_set(self) -> bool:
        """Whether there is a version that can be read; an empty one counts."""
        return self.read()[0] > 0

    def write(self, rows: DataFrame, based_on: int) -> int:
        """The number of a new version, written after ``based_on``; raises Conflict if another writer was faster."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        latest = max(self.versions(), default=0)
        newest, _ = self.read() if latest != based_on else (based_on, None)
        if newest != based_on:
            self._drop(name)
            raise Conflict(f"{self.path} is at version {newest}, not {based_on}")
        version = latest + 1
        try:
            out = self._store.create(self._path(f"{self.path}/pointers/{version:012d}"), False)
        except Exception as error:
            self._drop(name)
            raise Conflict(f"{self.path}: version {version} was taken") from error
        out.write(bytearray(name.encode()))
        out.close()
        self._forget(version)
        return version

    def update(self, merge: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Merge into the newest version; where another writer was faster, into the one that it left."""
        for attempt in range(tries):
            version, rows = self.read()
            try:
                return self.write(merge(rows), version)
            except Conflict:
                if attempt == tries - 1:
                    raise
        raise Conflict(self.path)

    def _drop(self, name: str) -> None:
        self._store.delete(self._path(f"{self.path}/data/{name}"), True)

    def _forget(self, version: int) -> None:
        for old in self.versions():
            if old <= version - KEPT:
                pointer = f"{self.path}/pointers/{old:012d}"
                named = self.spark.read.text(pointer).first()
                if named:
                    self._drop(named[0])
                self._store.delete(self._path(pointer), False)


def recurrence_table(spark: SparkSession, path: str) -> ControlTable:
    """The store of titles that filters keep dropping."""
    return ControlTable(spark, path, "key string, title string, why string, bucket string, n long, first date, last date")


def id_table(spark: SparkSession, path: str) -> ControlTable:
    """Ids: of offers that were seen in a list, of messages of the last list, or of the highest number given."""
    return ControlTable(spark, path, "id long")


def save_high_water(table: ControlTable, highest: int) -> int:
    """Keep the highest number given, if it is a number above nought and above the one kept; the version that holds it."""
    if isinstance(highest, bool) or not isinstance(highest, int) or highest <= 0:
        raise ValueError(f"a number given is a whole one above nought: {highest}")
    fresh = table.spark.createDataFrame([(highest,)], "id long")
    return table.update(lambda rows: rows.unionByName(fresh).agg(F.max("id").alias("id")))


def high_water(table: ControlTable) -> int:
    """The highest number kept, or 0."""
    return table.read()[1].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
