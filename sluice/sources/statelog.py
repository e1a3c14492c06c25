"""Keyed state in the shared folder: a base table, the changes since, and a commit file for each save.

A save is numbered after the state that it was loaded from. Its commit file is created only if there is none of that number,
so of two writers that started from the same state the second one is refused. File systems that cannot create a file
exclusively (some object stores) need a single writer.
"""

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

# So many changes are read besides the base; with more, a new base is written.
CHANGES = 10


class StateConflict(RuntimeError):
    """Another writer has saved in between."""


@dataclass(frozen=True)
class Commit:
    number: int
    kind: str
    folder: str


class StateLog:
    """Rows of `schema` by `keys`, the latest of each key counting.

    `changes` tables have an optional column `removed`; true ends a key. A base and its changes are removed when
    the base after the next one is written, so tables that were loaded before stay readable for a while.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list, changes: int = CHANGES):
        self.spark, self.path, self.schema, self.keys, self.changes = spark, path.rstrip("/"), schema, keys, changes
        self.stored = T.StructType([*schema.fields, T.StructField("removed", T.BooleanType())])
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[Commit]:
        """All commits that are there, by number: those since the base before the last one."""
        folder = self._path(f"{self.path}/commits")
        if not self.fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self.fs.listStatus(folder)]
        return [self._opened(int(name)) for name in sorted(names) if name.isdigit()]

    def _name(self, number):
        return f"{self.path}/commits/{number:012d}"

    def _opened(self, number):
        stream = self.fs.open(self._path(self._name(number)))
        try:
            kind, _, folder = bytes(stream.readAllBytes()).decode().partition(" ")
        finally:
            stream.close()
        return Commit(number, kind or "void", folder)

    def number(self) -> int:
        """The number of the state that is in force; 0 before the first save."""
        return max((commit.number for commit in self.commits()), default=0)

    def load(self) -> tuple[int, DataFrame]:
        """(number, rows) of the state in force."""
        return self._state(self.commits())

    def _state(self, commits):
        """A writer that ended before it had written its commit leaves a void number, which changes nothing."""
        number = commits[-1].number if commits else 0
        commits = [commit for commit in commits if commit.kind != "void"]
        bases = [i for i, commit in enumerate(commits) if commit.kind == "base"]
        live = commits[bases[-1]:] if bases else commits
        if not live:
            return number, self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.stored).parquet(f"{self.path}/data/{commit.folder}").withColumn(
            "_number", F.lit(commit.number)) for commit in live]
        if len(parts) == 1:
            return number, self._kept(parts[0])
        rest = [field.name for field in self.stored.fields if field.name not in self.keys]
        latest = reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(
            F.max_by(F.struct(*rest), "_number").alias("_row")).select(*self.keys, "_row.*")
        return number, self._kept(latest)

    def _kept(self, rows):
        return rows.where(~F.coalesce("removed", F.lit(False))).select(*self.schema.names)

    def save(self, changes: DataFrame, number: int) -> int:
        """Commit the rows that differ from state `number`; returns the new number, or raises `StateConflict`."""
        if "removed" not in changes.columns:
            changes = changes.withColumn("removed", F.lit(False))
        number = self._commit(changes, number + 1, "change")
        commits = self.commits()
        bases = [commit.number for commit in commits if commit.kind == "base"]
        if number - max(bases, default=0) >= self.changes:
            number = self.replace(self._state(commits)[1], number)
        return number

    def replace(self, rows: DataFrame, number: int) -> int:
        """Commit a whole state in place of state `number`, and remove what only older states need."""
        before = self.commits()
        number = self._commit(rows.withColumn("removed", F.lit(False)), number + 1, "base")
        bases = [commit.number for commit in before if commit.kind == "base"]
        for commit in before:
            if commit.number < max(bases, default=0):
                self.fs.delete(self._path(self._name(commit.number)), False)
                if commit.folder:
                    self.fs.delete(self._path(f"{self.path}/data/{commit.folder}"), True)
        return number

    def _commit(self, rows, number, kind):
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        rows.select(*self.stored.names).write.parquet(f"{self.path}/data/{folder}")
        commit = self._path(self._name(number))
        try:
            if self.number() >= number:
                raise StateConflict(f"{self.path} has state {number} already")
            stream = self.fs.create(commit, False)
        except Exception as refused:
            self.fs.delete(self._path(f"{self.path}/data/{folder}"), True)
            if isinstance(refused, StateConflict) or self.fs.exists(commit):
                raise StateConflict(f"{self.path} has state {number} already") from refused
            raise
        stream.write(bytearray(f"{kind} {folder}".encode()))
        stream.close()
        return number
