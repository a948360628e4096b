"""What the operators of this subpackage share.

Every operator takes a ``notes`` table and uses its ``vault``, ``path`` and
``content`` only, so other columns, whatever their names, do no harm.  A NULL
key part or text reads as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.checkpoints import scratch
from notelake.operators.workers import Task, lean, small_batches  # noqa: F401

BITMAP_BITS = 1 << 26  # 8 MB however large the input is
_BUCKET = 32768  # bits of one bitmap_construct_agg value


def keyed(notes: DataFrame) -> DataFrame:
    """``(vault, path, content)`` of the notes, NULL read as empty."""
    small_batches(notes.sparkSession)
    return notes.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("vault", "path", "content"))
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bitmap(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """A bit for each hash modulo ``BITMAP_BITS``: a filter of fixed size.

    A set bit may be due to another hash, so users of it join exactly afterwards;
    a full bitmap filters nothing and loses nothing.
    """
    at = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    rows = (
        hashes.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in rows:
        start = row["bucket"] * (_BUCKET // 8)
        out[start : start + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.int64) & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def key_hash() -> Column:
    return F.xxhash64("vault", "path")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    width = np.int64 if large else np.int32
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(
    batches: Iterator[pa.RecordBatch], column: str = "content", most: int = 8 << 20, rows: int = 2000
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part holds about ``most`` bytes of text, or one longer text, and ``rows`` texts at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them), one run after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, counts)


def document_notes(documents: DataFrame, text: str = "text", others: Sequence[str] = ()) -> DataFrame:
    """The note form of a documents table: the path is the padded doc_id, so paths sort as ids do (those below 0 do not)."""
    return documents.select(
        F.lit("documents").alias("vault"),
        F.format_string("%019d", F.col("doc_id")).alias("path"),
        F.col(text).alias("content"),
        *others,
    )


def doc_id(path: str = "path") -> Column:
    return F.expr(f"try_cast({path} as bigint)")
