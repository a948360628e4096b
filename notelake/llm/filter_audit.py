"""How filters interact: what each of five removes, in every order, from a sparse document-term matrix.

A word's code is its 64-bit hash, the same in every task, so no word has to be
looked up.  The dictionary of all words (:func:`dictionary`), grouped by code,
shows whether two words share one; such words are told apart by a second code.
Each part of a task's notes becomes one CSR shard: ``indptr``, the sorted codes
of each note's distinct words, and how often each occurs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm import common

# The filters, in the order of their bits in ``fails``.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # per cent of the words
MOST_UPPER = 10  # per cent of the code points
SYMBOLS = b"#$%&*|"

PART = 1 << 18  # bytes of whole texts looked at once, about; more don't fit a core's cache
SHARD = 1 << 20  # bytes of a longer text in a shard, or one run of text without a space
SENT = 1 << 20  # places for the words that a task remembers as sent to the dictionary

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTERS = [common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)
_SIZE = np.uint64(0x165667B19E3779F9)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64; kept for shards of the usual size."""
    have = known.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SHARD + 1), base, dtype=np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        if n <= SHARD + 1:
            known[base] = have
    return have[:n]


@dataclass
class Words:
    """The words of some texts: where each begins and ends and the text it stands in."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, at: np.ndarray) -> "Words":
        inside = ~_SPACE[flat]
        edge = np.empty(len(flat), dtype=bool)
        edge[:1] = inside[:1]
        edge[1:] = inside[1:] & ~inside[:-1]
        begins = at[:-1][at[:-1] < len(flat)]
        edge[begins] |= inside[begins]
        starts = np.flatnonzero(edge)
        # A word ends at the first space after it, or where its text ends.
        spaces = np.append(np.flatnonzero(~inside), len(flat))
        owner = np.searchsorted(at, starts, side="right") - 1
        ends = np.minimum(spaces[np.searchsorted(spaces, starts)], at[owner + 1])
        return Words(flat, starts, ends, owner)

    def codes(self, which: int = 0) -> np.ndarray:
        """A 64-bit code per word, from differences of one running sum over all bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.flat) + 1, dtype=np.uint64)
            np.cumsum(_LETTERS[which][self.flat] * _powers(_STEP, len(self.flat)), out=total[1:])
            value = (total[self.ends] - total[self.starts]) * _powers(_BACK, len(self.flat))[self.starts]
            return common.mix64(value + (self.ends - self.starts).astype(np.uint64) * _SIZE)


@dataclass
class Shard:
    """Rows of the document-term matrix in CSR form."""

    indptr: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(words: Words, texts: int) -> "Shard":
        codes = words.codes()
        row = np.concatenate([[0], np.cumsum(np.bincount(words.owner, minlength=texts))])
        for start, end in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
            codes[start:end].sort()
        first = np.ones(len(codes), dtype=bool)
        first[1:] = codes[1:] != codes[:-1]
        first[row[:-1][row[:-1] < len(codes)]] = True
        at = np.flatnonzero(first)
        indptr = np.searchsorted(at, row)
        return Shard(indptr, codes[at], np.diff(np.append(at, len(codes))))

    def row_sums(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.counts)])
        return total[self.indptr[1:]] - total[self.indptr[:-1]]

    def nonzero(self) -> np.ndarray:
        return np.diff(self.indptr)


def _runs(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts one after the other in shards; a longer text is cut at spaces, its first row is given."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(int(np.searchsorted(at, at[i] + SHARD, side="right")) - 1, i)
        if j > i:
            yield i, flat[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
            continue
        start, end = int(at[i]), int(at[i + 1])
        while start < end:
            stop = min(start + SHARD, end)
            if stop < end:
                spaces = np.flatnonzero(_SPACE[flat[start:stop]])
                if len(spaces):
                    stop = start + int(spaces[-1]) + 1
                else:
                    while stop < end and not _SPACE[flat[stop]]:
                        stop += 1
            yield i, flat[start:stop], np.array([0, stop - start])
            start = stop
        i += 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in common.pieces(batches, most=PART):
        yield batch, *common.utf8(batch.column(batch.schema.get_field_index("content")))


def _dictionary_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``code, other`` of each distinct word; a task sends most words once."""
    sent = np.zeros((2, SENT), dtype=np.uint64)
    for _, flat, at in _texts(batches):
        for _, part, ends in _runs(flat, at):
            words = Words.of(part, ends)
            codes, others = words.codes(), words.codes(1)
            slot = (codes & np.uint64(SENT - 1)).astype(np.int64)
            new = (sent[0][slot] != codes) | (sent[1][slot] != others)
            codes, others, slot = codes[new], others[new], slot[new]
            sent[0][slot], sent[1][slot] = codes, others
            order = np.lexsort((others, codes))
            codes, others = codes[order], others[order]
            first = np.ones(len(codes), dtype=bool)
            first[1:] = (codes[1:] != codes[:-1]) | (others[1:] != others[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[first].view(np.int64)), pa.array(others[first].view(np.int64))], names=["code", "other"]
            )


def dictionary(notes: DataFrame) -> DataFrame:
    """``code, other, words``: a row per code of a word, with its second code and how many words share the code.

    NULL and empty texts have no words; repeated rows add nothing; an empty table gives no rows.
    """
    return (
        common.keyed(notes).select("content").mapInArrow(common.lean(_dictionary_codes), "code bigint, other bigint")
        .groupBy("code")
        .agg(F.min("other").alias("other"), (F.min("other") != F.max("other")).alias("shared"))
        .select("code", "other", F.when(F.col("shared"), 2).otherwise(1).alias("words"))
    )


ROWS = "vault string, path string, part string, n_words bigint, n_distinct bigint, fails int, text_hash binary"


def _judge(shared: np.ndarray | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in _texts(batches):
            n = batch.num_rows
            sums, distinct, upper, points, symbols = np.zeros((5, n), dtype=np.int64)
            long: dict[int, np.ndarray] = {}
            for row, part, ends in _runs(flat, at):
                words, texts = Words.of(part, ends), len(ends) - 1
                rows = slice(row, row + texts)
                shard = Shard.of(words, texts)
                sums[rows] += shard.row_sums()
                for count, marked in ((upper, (part >= 65) & (part <= 90)), (points, (part & 0xC0) != 0x80), (symbols, _SYMBOL[part])):
                    total = np.concatenate([[0], np.cumsum(marked)])
                    count[rows] += total[ends[1:]] - total[ends[:-1]]
                is_cut = ends[-1] < at[row + 1] - at[row]
                distinct[rows] = shard.nonzero()
                found = shard.codes[:, None]
                if shared is not None and (is_cut or common.in_bitmap(shared, shard.codes.view(np.int64)).any()):
                    # Words that may share a code are counted by both codes.
                    both = np.unique(np.stack([words.owner.astype(np.uint64), words.codes(), words.codes(1)], axis=1), axis=0)
                    distinct[rows] = np.bincount(both[:, 0].astype(np.int64), minlength=texts)
                    found = both[:, 1:]
                if is_cut:
                    long[row] = np.unique(np.concatenate([long.get(row, found[:0]), found]), axis=0)
                    distinct[row] = len(long[row])
            fails = (
                (sums < LEAST_WORDS) * 1
                | (100 * distinct < LEAST_DISTINCT * sums) * 2
                | (100 * upper > MOST_UPPER * points) * 4
                | (symbols > 0) * 8
            )
            whole = memoryview(flat)
            hashes = [hashlib.sha256(whole[s:e]).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(sums), pa.array(distinct),
                    pa.array(fails.astype(np.int32)), pa.array(hashes, pa.binary()),
                ],
                names=["vault", "path", "part", "n_words", "n_distinct", "fails", "text_hash"],
            )

    return judge


def judge_notes(notes: DataFrame, part: str = "vault") -> DataFrame:
    """``vault, path, part, n_words, n_distinct, fails`` of each note; ``fails`` has a bit for each filter it fails.

    ``part`` names the column that notes are reported by.  A NULL part, key part or text reads as
    empty; an empty text fails A, and E where an equal text comes before.  Rows that repeat a key and
    text come before none of each other.
    """
    rows = notes.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("vault", "vault"), ("path", "path"), (part, "part"), ("content", "content")))
    )
    clashes = dictionary(notes).where("words > 1").select("code")
    clashes = common.stored(clashes, "shared-codes")
    shared = None if clashes.isEmpty() else common.bitmap(clashes, "code")
    judged = common.stored(rows.mapInArrow(common.lean(_judge(shared)), ROWS), "judged-notes")
    # Equal texts meet as minima only; what follows a first one is found by a join that can be split.
    repeated = (
        judged.groupBy("text_hash")
        .agg(F.min(F.struct("vault", "path")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("text_hash", "first")
    )
    late = F.struct("vault", "path") > F.col("first")
    return judged.join(common.stored(repeated, "repeated-texts"), "text_hash", "left").select(
        "vault", "path", "part", "n_words", "n_distinct",
        F.when(late, F.col("fails").bitwiseOR(F.lit(16))).otherwise(F.col("fails")).alias("fails"),
    )


def _steps() -> str:
    """The steps of all orders as JSON: order, step, bit of its filter, bits of the filters before."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return json.dumps(out)


def audit_filters(notes: DataFrame, marks: DataFrame, part: str = "vault") -> DataFrame:
    """What each filter does to the notes of each part, for every order of the filters.

    The filters take away a note A of under 100 words, B whose distinct words are under 80 % of its
    words, C with over 10 % of ``[A-Z]``, D that holds any of ``#$%&*|``, E whose text a note with a
    smaller (vault, path) has.  Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  ``marks(vault, path, good,
    toxic)`` judges some notes; repeated marks of a note count if any is true.

    Returns ``part, filter_order, step`` and, for the filter of that step: ``kept`` after it, ``removed``
    by it, ``redundant`` (fails it, gone before), ``unique_fails`` (fails nothing else), ``good_lost``
    and ``toxic_lost`` among the removed, and ``shapley``, the sum of its ``removed`` over all orders.
    Each part has all 600 rows; NULL and empty parts are one; an empty table gives none.
    """
    key = ["vault", "path"]
    marks = marks.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key),
        *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("good", "toxic")),
    ).groupBy(*key).agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counts = (
        judge_notes(notes, part).join(marks, key, "left")
        .groupBy("part", "fails")
        .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    )
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    fails, bit, before = F.col("fails"), F.col("bit"), F.col("before")
    gone, failing = fails.bitwiseAND(before) != 0, fails.bitwiseAND(bit) != 0

    def total(condition: Column, name: str, of: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0)).cast("bigint").alias(name)

    audited = (
        counts.select("part", "fails", "n", "good", "toxic", F.inline(steps))
        .groupBy("part", "filter_order", "step", "bit")
        .agg(
            total(~gone & ~failing, "kept"),
            total(~gone & failing, "removed"),
            total(gone & failing, "redundant"),
            total(fails == bit, "unique_fails"),
            total(~gone & failing, "good_lost", "good"),
            total(~gone & failing, "toxic_lost", "toxic"),
        )
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows
    return audited.withColumn("shapley", shapley).drop("bit")
