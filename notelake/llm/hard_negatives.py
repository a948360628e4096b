"""Hard negatives of anchor vectors, from pair scores sorted by packed keys.

Every (anchor, row) pair is scored where the row lies.  A task keeps, per anchor, only the
few pairs that can still matter, packs them into keys that sort by anchor, then by
falling score, then by id, and sends them off; after the shuffle each partition is
one sorted stream, whose positives open windows that the negatives behind them fill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm import common
from notelake.operators.checkpoints import scratch

POSITIVES = 5
NEGATIVES = 5
MARGIN = 80  # a negative scores at least so many per cent of its positive

BLOCK = 1 << 19  # components of the anchors that go out at once, 4 MB
ROWS = 1024  # rows and
COLUMNS = 256  # anchors scored at once
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NONE = -np.inf

PAIRS = "anchor bigint, key binary"
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("negative", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def pack(anchor: np.ndarray, score: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys whose bytes sort by anchor, falling score, positives before negatives, id."""
    keys = np.empty(len(anchor), dtype=_KEY)
    keys["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    keys["negative"] = negative
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    return keys


def unpack(keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = np.frombuffer(keys, dtype=_KEY)
    signed = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return signed(found["anchor"]), signed(~found["score"].astype(np.uint64)), found["negative"] == 1, signed(found["id"])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of integers; as floats while these hold every sum, else saturated to 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    if width * most[0] * most[1] < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def _order(scores: np.ndarray) -> np.ndarray:
    """Floats that sort as the scores do, with the earlier of two equal columns first."""
    n = scores.shape[1]
    if scores.dtype != np.float64 or np.abs(scores).max(initial=0) * n >= 1 << 53:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.float64)
    return scores * n + np.arange(n - 1, -1, -1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


@dataclass
class Best:
    """The first ``keep`` (score, id) of each of some lists, by falling score and then id."""

    scores: np.ndarray
    ids: np.ndarray
    full: np.ndarray

    @staticmethod
    def empty(lists: int, keep: int) -> "Best":
        shape = (lists, keep)
        return Best(np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool))

    def add(self, lists: slice, scores: np.ndarray, order: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        keep = min(self.ids.shape[1], scores.shape[1])
        ranked = np.where(fits, order, _NONE)
        at = np.argpartition(ranked, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep :]
        new = np.take_along_axis(ranked, at, axis=1) > _NONE
        some = np.flatnonzero(new.any(axis=1))
        rows = lists.start + some
        both = [
            np.concatenate([x[rows], y[some]], axis=1)
            for x, y in ((self.scores, np.take_along_axis(scores, at, axis=1).astype(np.int64)), (self.ids, ids[at]), (self.full, new))
        ]
        # ~score falls as the score rises and can't overflow.
        best = np.lexsort((both[1], ~both[0], ~both[2]), axis=1)[:, : self.ids.shape[1]]
        self.scores[rows], self.ids[rows], self.full[rows] = (np.take_along_axis(x, best, axis=1) for x in both)


@dataclass
class Anchors:
    """A block of anchors; ``opened`` has the scores of each one's positives, ``open`` says which exist."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    opened: np.ndarray | None = None
    open: np.ndarray | None = None


def _pairs(anchors: Anchors, positives: int, negatives: int, margin: int):
    """Per anchor the first positives of a task, or the first negatives of each of its windows."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, windows = len(anchors.ids), anchors.opened
        best = [Best.empty(count, positives)] if windows is None else [Best.empty(count, negatives) for _ in range(positives)]
        low = None if windows is None else np.array([[-(-margin * int(p) // 100) for p in row] for row in windows], dtype=np.int64).reshape(windows.shape)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                ids, labels = (np.asarray(rows.column(i)) for i in (0, 1))
                by_id = np.argsort(ids, kind="stable")
                ids, labels, vectors = ids[by_id], labels[by_id], _matrix(rows.column(2))[by_id]
                for first in range(0, count, COLUMNS):
                    part = slice(first, min(first + COLUMNS, count))
                    scores = inner_products(anchors.vectors[part], vectors)
                    order = _order(scores)
                    alike = anchors.labels[part, None] == labels
                    if windows is None:
                        best[0].add(part, scores, order, alike & (anchors.ids[part, None] != ids), ids)
                        continue
                    for k in range(positives):
                        inside = (scores >= low[part, k, None]) & (scores <= windows[part, k, None])
                        best[k].add(part, scores, order, ~alike & inside & anchors.open[part, k, None], ids)
        whose = np.repeat(np.arange(count), best[0].ids.shape[1])
        keys = _distinct(
            [pack(anchors.ids[whose], b.scores.ravel(), np.full(b.ids.size, windows is not None), b.ids.ravel())[b.full.ravel()] for b in best]
        )
        for start in range(0, len(keys), 1 << 16):
            some = keys[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((some["anchor"].astype(np.uint64) ^ _SIGN).view(np.int64)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(some), [None, pa.py_buffer(some.tobytes())]).cast(pa.binary()),
                ],
                names=["anchor", "key"],
            )

    return scored


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """A negative of several windows travels once."""
    keys = np.concatenate(parts).astype(_KEY)  # concatenate gives native byte order
    keys = keys[np.lexsort((keys["id"], keys["negative"], keys["score"], keys["anchor"]))]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return keys[fresh]


def _mine(positives: int, negatives: int, margin: int):
    """Reads pairs in the order of their keys; holds the open windows of one anchor only."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out: list[tuple] = []
            keys = b"".join(batch.column(1).to_pylist())
            for at, score, is_negative, row in zip(*(x.tolist() for x in unpack(keys)), strict=True):
                if at != anchor:
                    anchor, windows, opened = at, [], 0
                if not is_negative:
                    if opened < positives:
                        windows.append([row, score, 0])
                        opened += 1
                    continue
                # Later scores are no higher, so a window that this one lies below is over.
                windows = [w for w in windows if w[2] < negatives and margin * w[1] <= 100 * score]
                for window in windows:
                    window[2] += 1
                    out.append((at, window[0], window[2], row, window[1], score))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return mine


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``id, label, vector`` of the rows that take part, components as ``floor(scale * x)``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("id").cast("bigint").alias("id"),
        F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).cast("array<bigint>").alias("vector"),
    )
    rows = common.stored(rows, "vectors")
    repeated = common.stored(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if repeated.isEmpty():
        return rows
    least = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return common.stored(
        rows.join(repeated, "id", "left_anti").unionByName(least.select("id", "row.label", "row.vector")), "vectors"
    )


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    margin: int = MARGIN,
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """For each anchor and each of its positives, the best scored rows of other labels just below it.

    Notes have no vectors, so this works on any ``vectors(id, embedding, label)``;
    ``is_anchor`` is a condition on ``id``.  Components become ``floor(scale * x)`` and a
    row's score is its inner product with the anchor, exact, saturated to 64 bits.  Higher scores come first,
    then smaller ids.  An anchor's positives are its first ``positives`` other rows of its
    label; each gets the first ``negatives`` rows of other labels that score at
    most as much and at least ``margin`` per cent of it (so none below a negative score).

    Rows without id, label or vector, or with a NULL or non-finite component, take no part; a
    shorter vector counts as filled up with zeros, an empty one scores 0; of rows that repeat an id the
    one with the smallest (label, vector) stays; an empty table or no anchor gives no rows.

    Anchors go out in blocks of ``block`` components, each scored against all rows in
    two passes: the first finds the positives, whose scores open the windows of the second.
    Tasks send at most ``positives * (1 + negatives)`` pairs an anchor.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, scale)
    anchors = rows.where(is_anchor)
    size = anchors.agg(F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(1))), F.lit(0))).first()[0]
    blocks = math.ceil(size / block)
    folder = scratch(spark, "pairs")
    first = Window.partitionBy("anchor").orderBy("key")
    for k in range(blocks):
        found = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        if not found.num_rows:
            continue
        here = Anchors(np.asarray(found["id"]), np.asarray(found["label"]), _matrix(found["vector"]))
        near = common.stored(rows.mapInArrow(_pairs(here, positives, negatives, margin), PAIRS), "near-pairs")
        near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n").write.parquet(
            f"{folder}/block={k}/kind=positive"
        )
        near = spark.read.schema(PAIRS).parquet(f"{folder}/block={k}/kind=positive")
        at, scores, _, _ = unpack(b"".join(near.select("key").toArrow()["key"].to_pylist()))
        here.opened, here.open = (np.zeros((len(here.ids), positives), dtype=t) for t in (np.int64, bool))
        place = {a: i for i, a in enumerate(here.ids.tolist())}
        used = [0] * len(place)
        for anchor, score in zip(at.tolist(), scores.tolist(), strict=True):
            i = place[anchor]
            here.opened[i, used[i]], here.open[i, used[i]] = score, True
            used[i] += 1
        rows.mapInArrow(_pairs(here, positives, negatives, margin), PAIRS).write.parquet(f"{folder}/block={k}/kind=negative")
    if not blocks:
        return spark.createDataFrame([], MINED)
    pairs = spark.read.schema(PAIRS).parquet(f"{folder}/block=*/kind=*")
    # The DataFrame form of repartitionAndSortWithinPartitions.
    return pairs.repartition("anchor").sortWithinPartitions("key").mapInArrow(_mine(positives, negatives, margin), MINED)
