"""Read vault folders into note rows.

Spark's text and binary sources leave out empty files and names that start with
``_`` or ``.``, which are notes like any other here, so folders are walked by the
tasks themselves.  Each level of folders is listed in parallel and shuffled by
name before the next, and the found files are shuffled again before they are
read: a vault with most of the files is spread like the rest, and neither names
nor text pass through the driver.  Folders must be reachable from all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators.checkpoints import checkpoint
from ..operators.commands import TRASH_FOLDER

_FOUND = "vault string, root string, path string, folder boolean"
_READ = "vault string, path string, content string"
# One output batch is closed once it holds this much text or this many notes.
_BATCH_CHARS = 16 << 20
_BATCH_NOTES = 2000


def _is_note(entry: os.DirEntry) -> bool:
    return entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(".md")


def _is_open_folder(entry: os.DirEntry) -> bool:
    """Not a link and not hidden."""
    return (
        entry.is_dir(follow_symlinks=False)
        and not entry.name.startswith(".")
        and entry.name != "node_modules"
    )


def _children(root: str, folder: str) -> Iterator[tuple[str, bool]]:
    with os.scandir(os.path.join(root, folder)) as entries:
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if _is_open_folder(entry):
                yield path, True
            elif _is_note(entry):
                yield path, False


def _walk(expand):
    """Replace each folder row by what ``expand`` finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples(index=False):
                for path, is_folder in expand(r.root, r.path):
                    rows.append((r.vault, r.root, path, is_folder))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=batch.columns)
                        rows = []
            yield pd.DataFrame(rows, columns=batch.columns)

    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["vault", "path", "content"]
    for batch in batches:
        rows, chars = [], 0
        for r in batch.itertuples(index=False):
            with open(os.path.join(r.root, r.path), "rb") as f:
                # Bytes that are not UTF-8 become replacement characters, and
                # the hash is taken of the text read that way.
                content = f.read().decode("utf-8", errors="replace")
            rows.append((r.vault, r.path, content))
            chars += len(content)
            if chars >= _BATCH_CHARS or len(rows) >= _BATCH_NOTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, chars = [], 0
        yield pd.DataFrame(rows, columns=columns)


def _read_found(found: DataFrame, partitions: int) -> DataFrame:
    files = found.select("vault", "root", "path").repartition(partitions, "vault", "path")
    return files.mapInPandas(_read, _READ).withColumn(
        "content_hash", text.content_hash(F.col("content"))
    )


def _partitions(spark: SparkSession, asked: int | None) -> int:
    return asked or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism
    )


def list_files(spark: SparkSession, vaults: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(vault, root, path)`` of every note file below the vaults' folders.

    Folders are listed one level at a time, as many levels as there are, each spread over
    all tasks; a level is checkpointed, so no folder is listed twice.
    """
    n = _partitions(spark, partitions)
    level = vaults.select(
        F.col("name").alias("vault"),
        F.col("path").alias("root"),
        F.lit("").alias("path"),
        F.lit(True).alias("folder"),
    )
    files = None
    while files is None or not level.isEmpty():
        listed = checkpoint(level.repartition(n, "vault", "path").mapInPandas(_walk(_children), _FOUND))
        found = listed.filter(~F.col("folder")).select("vault", "root", "path")
        files = found if files is None else files.unionByName(found)
        level = listed.filter("folder")
    return files


def scan_notes(spark: SparkSession, vaults: DataFrame, partitions: int | None = None) -> DataFrame:
    """All notes ``(vault, path, content, content_hash)`` below the vaults' folders.

    Set ``partitions`` so that each holds at most a few hundred megabytes of text.
    """
    n = _partitions(spark, partitions)
    return _read_found(list_files(spark, vaults, n), n)


def _trash_entries(root: str, _folder: str) -> Iterator[tuple[str, bool]]:
    folder = os.path.join(root, TRASH_FOLDER)
    if not os.path.isdir(folder):
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            if _is_note(entry):
                yield f"{TRASH_FOLDER}/{entry.name}", False


def scan_trash(spark: SparkSession, vaults: DataFrame, partitions: int | None = None) -> DataFrame:
    """Notes lying directly in each vault's trash folder."""
    n = _partitions(spark, partitions)
    tops = vaults.select(
        F.col("name").alias("vault"),
        F.col("path").alias("root"),
        F.lit("").alias("path"),
        F.lit(True).alias("folder"),
    )
    found = tops.repartition(n, "vault").mapInPandas(_walk(_trash_entries), _FOUND)
    return _read_found(found, n)
