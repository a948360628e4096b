"""Stored notes: numbered snapshots plus numbered batches of changes.

::

    <path>/snapshot=<n>/vault=<vault>/*.parquet     all notes after batch n
    <path>/batch=<n>/kind=<kind>/*.parquet          outcome of command batch n
    <path>/claim=<n>/<writer>                       who has taken number n for a batch to come

A directory counts once its ``_SUCCESS`` mark is there, and no directory is ever
written while it is being read.  A batch stores only what it changed, so applying
commands costs as much as the notes they touch; :meth:`NoteStore.compact` folds
the batches into a new snapshot now and then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators.commands import OUTCOME, Applied, merge_changes

def _found(spark: SparkSession, path: str, prefix: str, name: str) -> list[int]:
    """Numbers of the ``<prefix>=<n>`` directories that hold a file of this name, ascending."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}=*/{name}")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished ``<prefix>=<n>`` directories, ascending."""
    return _found(spark, path, prefix, "_SUCCESS")


def _next_number(spark: SparkSession, path: str) -> int:
    """Above all numbers that snapshots, batches and claims of the store have."""
    used = [n for prefix in ("snapshot", "batch") for n in _finished(spark, path, prefix)]
    return max(used + _found(spark, path, "claim", "*"), default=-1) + 1


def save_notes(notes: DataFrame, path: str, number: int | None = None) -> int:
    """Write all notes as a fresh snapshot and return its number.

    Partitions are cut by vault and split where a vault is large; rows are sorted
    by path, so a folder filter skips most of a vault's row groups.
    """
    spark = notes.sparkSession
    if number is None:
        number = _next_number(spark, path)
    (
        notes.select("vault", "path", "content", "content_hash")
        .hint("rebalance", "vault")
        .sortWithinPartitions("vault", "path")
        .write.mode("overwrite")
        .partitionBy("vault")
        .parquet(f"{path}/snapshot={number}")
    )
    return number


@dataclass(frozen=True)
class NoteStore:
    spark: SparkSession
    path: str

    def _snapshot(self, before: int | None) -> int | None:
        numbers = _finished(self.spark, self.path, "snapshot")
        numbers = [n for n in numbers if before is None or n < before]
        return numbers[-1] if numbers else None

    def _batches(self, after: int, before: int | None) -> list[int]:
        return [
            n
            for n in _finished(self.spark, self.path, "batch")
            if n > after and (before is None or n < before)
        ]

    def _outcome(self, numbers: list[int]) -> DataFrame:
        reader = self.spark.read.schema(f"{OUTCOME}, batch bigint")
        if not numbers:
            return self.spark.createDataFrame([], f"{OUTCOME}, batch bigint")
        return reader.option("basePath", self.path).parquet(
            *[f"{self.path}/batch={n}" for n in numbers]
        )

    def notes(self, before: int | None = None) -> DataFrame:
        """Current notes, or those before batch ``before``."""
        start = self._snapshot(before)
        if start is None:
            snapshot = self.spark.createDataFrame([], S.NOTES)
        else:
            snapshot = self.spark.read.schema(S.NOTES).parquet(f"{self.path}/snapshot={start}")
        numbers = self._batches(-1 if start is None else start, before)
        if not numbers:
            return snapshot
        changed = self._outcome(numbers).filter(F.col("kind") == "change")
        latest = changed.groupBy("vault", "path").agg(F.max("batch").alias("batch"))
        newest = changed.join(latest, ["vault", "path", "batch"]).select(
            "vault", "path", "content", "content_hash", F.col("content").isNull().alias("deleted")
        )
        return merge_changes(snapshot, newest)

    def trash(self, before: int | None = None) -> DataFrame:
        rows = self._outcome(self._batches(-1, before)).filter(F.col("kind") == "trash")
        return rows.select("vault", "path", "content", "content_hash", "deleted_from")

    def results(self, number: int | None = None) -> DataFrame:
        """Results of one batch, or of all."""
        numbers = self._batches(-1, None) if number is None else [number]
        rows = self._outcome(numbers).filter(F.col("kind") == "result")
        return rows.select("batch", "seq", "vault", "path", "content_hash", "status")

    def claim(self, writer: str) -> int:
        """The number of this writer's batch: the one it has, or the next free one."""
        has = _found(self.spark, self.path, "claim", writer)
        if has:
            return has[-1]
        number = _next_number(self.spark, self.path)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claim={number}/{writer}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, False).close()
        return number

    def folded(self, number: int) -> bool:
        """Whether a snapshot holds the batch of this number."""
        start = self._snapshot(None)
        return start is not None and number <= start

    def append(self, applied: Applied, number: int | None = None) -> int:
        """Store what a batch did.  The same number again replaces it."""
        if number is None:
            number = _next_number(self.spark, self.path)
        applied.outcome.write.mode("overwrite").partitionBy("kind").parquet(
            f"{self.path}/batch={number}"
        )
        return number

    def compact(self) -> int | None:
        """Fold all finished batches into a snapshot with the last one's number."""
        start = self._snapshot(None)
        numbers = self._batches(-1 if start is None else start, None)
        if not numbers:
            return start
        return save_notes(self.notes(), self.path, numbers[-1])
