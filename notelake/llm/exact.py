"""Exact duplicates by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm import common

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_299_709_453)
CHUNK = 1 << 16  # bytes hashed at once
COMPARED = 1 << 14  # bytes of a compared chunk
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_POWERS: dict[int, np.ndarray] = {}

MARKS = "vault string, path string, n_chars bigint, n_bytes bigint, f1 bigint, f2 bigint, text_sha256 string"


def _powers(base: int) -> np.ndarray:
    """base**(CHUNK - 1), ..., base, 1 modulo PRIME."""
    if base not in _POWERS:
        out = np.ones(CHUNK, dtype=np.int64)
        done = 1
        while done < CHUNK:
            step = pow(base, done, PRIME)
            out[done : 2 * done] = out[:done] * step % PRIME
            done *= 2
        _POWERS[base] = out[::-1].copy()
    return _POWERS[base]


def combine(left: int, right: int, right_length: int, base: int) -> int:
    """The fingerprint of two adjoining parts from those of the parts."""
    return (left * pow(base, right_length, PRIME) + right) % PRIME


def chunk_fingerprint(data: np.ndarray, base: int) -> int:
    """sum of (byte + 1) * base**(distance to the end); no sum exceeds 2**56."""
    if not len(data):
        return 0
    return int(np.dot(data.astype(np.int64) + 1, _powers(base)[CHUNK - len(data) :])) % PRIME


def fingerprint(text: bytes, base: int, chunk: int = CHUNK) -> int:
    data, value = np.frombuffer(text, dtype=np.uint8), 0
    for start in range(0, len(data), chunk):
        part = data[start : start + chunk]
        value = combine(value, chunk_fingerprint(part, base), len(part), base)
    return value


def normalized(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    flat, at = common.utf8(batch.column(batch.schema.get_field_index("content")))
    whole = flat.tobytes()
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield normalized(whole[start:end])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.pieces(batches, most=2 << 20):
        f1, f2, sizes, sums = [], [], [], []
        for text in _texts(batch):
            f1.append(fingerprint(text, BASES[0]))
            f2.append(fingerprint(text, BASES[1]))
            sizes.append(len(text))
            sums.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pc.cast(pc.utf8_length(batch.column(2)), pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sums, pa.string()),
            ],
            names=["vault", "path", "n_chars", "n_bytes", "f1", "f2", "text_sha256"],
        )


def _chunks(shared: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, most=2 << 20):
            rows: dict[tuple, set] = {}
            for text in _texts(batch):
                f1, f2 = fingerprint(text, BASES[0]), fingerprint(text, BASES[1])
                if not common.in_bitmap(shared, np.array([f1 << 31 ^ f2]))[0]:
                    continue
                for k in range(0, len(text), COMPARED):
                    # A chunk that this batch has sent already need not travel again.
                    rows.setdefault((f1, f2, len(text), k // COMPARED), set()).add(text[k : k + COMPARED])
            flat = [(*key, chunk) for key, found in rows.items() for chunk in found]
            columns = list(zip(*flat, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i], pa.int64()) for i in range(4)] + [pa.array(columns[4], pa.binary())],
                names=["f1", "f2", "n_bytes", "k", "chunk"],
            )

    return emit


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """One row per note with the note that stays for its text.

    Texts are equal when they are so without the characters ``[\\x20\\x09-\\x0D]``.
    Two modular polynomials are computed chunk by chunk and put together by
    shifting with the length of what follows, so a huge note never needs a pass
    in one piece.  Texts of equal fingerprints and length are compared chunk by
    chunk; a clash, should there be one, is split by SHA-256.

    Returns ``vault, path, keep_vault, keep_path, group_size, kept, text_sha256``.
    Of equal texts the one with most code points stays, then the smallest
    ``(vault, path)``.  Of rows that repeat a key and text, one stays.  NULL texts are
    empty texts, all empty texts are equal; an empty table gives no rows.
    """
    notes = common.keyed(notes)
    marks = common.stored(
        notes.mapInArrow(common.lean(_mark), MARKS).withColumn("row", F.monotonically_increasing_id()), "fingerprints"
    )
    key = ["f1", "f2", "n_bytes"]
    counted = common.stored(marks.groupBy(*key).count().where("count > 1"), "fingerprint-groups")
    shared = common.bitmap(counted.select((F.shiftleft("f1", 31).bitwiseXOR(F.col("f2"))).alias("h")))
    clashes = common.stored(
        notes.mapInArrow(common.lean(_chunks(shared)), "f1 bigint, f2 bigint, n_bytes bigint, k bigint, chunk binary")
        .groupBy(*key, "k")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .where("least <> most")
        .select(*key)
        .distinct(),
        "fingerprint-clashes",
    )
    split = F.lit("")
    if not clashes.isEmpty():
        marks = marks.join(clashes.withColumn("clash", F.lit(True)), key, "left")
        split = F.when(F.col("clash"), F.col("text_sha256")).otherwise("")
    marks = marks.withColumn("split", split)
    key.append("split")
    # Written once, so that the join below shuffles both sides and a hot text can be split.
    groups = common.stored(
        marks.groupBy(*key)
        .agg(
            F.min(F.struct((-F.col("n_chars")).alias("n"), "vault", "path", "row")).alias("keep"),
            F.count("*").alias("group_size"),
        )
        .where("group_size > 1"),
        "equal-texts",
    )
    return marks.join(groups, key, "left").select(
        "vault",
        "path",
        F.coalesce("keep.vault", "vault").alias("keep_vault"),
        F.coalesce("keep.path", "path").alias("keep_path"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
