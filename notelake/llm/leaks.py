"""Passages of reserved notes inside other notes, by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm import common

WINDOW = 96  # code points of a passage
RATE = 0.05  # edits allowed per code point
LEAST = 24  # reserved texts with fewer code points than this are found verbatim only
QGRAMS = (16, 8, 4, 2, 1)
BLOCK = 1 << 20  # code points of reserved text looked for at once; its index takes about 50 MB
POSTS = 1 << 20  # entries of the index looked at together
ALIGNED = 4096  # passages aligned together

LEAKS = (
    "vault string, path string, reserved_vault string, reserved_path string, passages int, found int, "
    "start bigint, end bigint, edits int, coverage double"
)


def folded(text: str) -> str:
    """Lower case, with single blanks for white space; positions count in this form."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each position on; q is a power of two."""
    h = common.mix64(text.astype(np.uint64) + np.uint64(1))
    size = 1
    with np.errstate(over="ignore"):
        while size < q and len(h) > size:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint64(29)))
            size *= 2
    return h if len(text) >= q else h[:0]


def least_shared(length: int, edits: int, q: int) -> int:
    """q-grams that any text within ``edits`` of one of ``length`` shares with it, at least."""
    return length + 1 - q * (edits + 1)


@dataclass
class Passage:
    item: int
    start: int
    text: str
    edits: int
    q: int


def measures(length: int) -> tuple[int, int, int]:
    """Of a text of ``length`` code points: those of its passages, the edits allowed in one, and q."""
    long = min(length, WINDOW)
    edits = int(RATE * long) if long >= LEAST else 0
    return long, edits, next(q for q in QGRAMS if least_shared(long, edits, q) >= 1)


def passages(item: int, text: str, step: int = 1) -> list[Passage]:
    """The passages of a text from every ``step``-th position on, and the one that ends where the text does."""
    text = folded(text)
    if not text:
        return []
    long, edits, q = measures(len(text))
    starts = sorted({*range(0, len(text) - long + 1, step), len(text) - long})
    return [Passage(item, start, text[start : start + long], edits, q) for start in starts]


class Index:
    """Reserved texts by their q-grams, one entry a position."""

    def __init__(self, items: list[tuple[str, str, str]]):
        self.keys = [(vault, path) for vault, path, _ in items]
        self.texts = [folded(text) for _, _, text in items]
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        sizes = np.array([measures(n) if n else (0, 0, 0) for n in self.lengths.tolist()], dtype=np.int64).reshape(-1, 3)
        self.long, self.edits, q_of = sizes[:, 0], sizes[:, 1], sizes[:, 2]
        self.count = np.where(self.lengths > 0, self.lengths - self.long + 1, 0)
        self.by_q = {}
        for q in QGRAMS:
            parts = [(k, grams(codes(self.texts[k]), q)) for k in np.flatnonzero(q_of == q).tolist()]
            if not parts:
                continue
            h = np.concatenate([g for _, g in parts])
            owner = np.repeat([k for k, _ in parts], [len(g) for _, g in parts])
            place = np.concatenate([np.arange(len(g)) for _, g in parts])
            order = np.argsort(h, kind="stable")
            h, owner, place = h[order], owner[order], place[order]
            known, first = np.unique(h, return_index=True)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(known >> np.uint64(44)).astype(np.int64)] = True
            self.by_q[q] = (seen, known, first, np.diff(np.append(first, len(h))), owner, place)

    @property
    def passages(self) -> list[Passage]:
        """Passages that cover the texts, to look at; those at all other positions are searched as well."""
        return [p for i, text in enumerate(self.texts) for p in passages(i, text, WINDOW // 2)]

    def regions(self, text: np.ndarray) -> np.ndarray:
        """Rows ``item, start of a passage, first diagonal`` of the passages with enough shared q-grams in a band."""
        out = [np.zeros((0, 3), dtype=np.int64)]
        for q, (seen, known, first, many, owner, place) in self.by_q.items():
            h = grams(text, q)
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            hit = known[slot] == h[at]
            at, slot = at[hit], slot[hit]
            ends, start = np.cumsum(many[slot]), 0
            # Stretches of the text with a bounded number of entries overlap by more than any match is long.
            while start < len(at):
                end = int(np.searchsorted(ends, ends[start] + POSTS))
                end = max(end, int(np.searchsorted(at, at[start] + 4 * WINDOW)))
                post = common.ranges(first[slot[start:end]], many[slot[start:end]])
                out.append(self._bands(q, owner[post], place[post], np.repeat(at[start:end], many[slot[start:end]])))
                start = int(np.searchsorted(at, at[end] - 2 * WINDOW)) if end < len(at) else end
        return np.unique(np.concatenate(out), axis=0)

    def _bands(self, q: int, item: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        # A match drifts over edits + 1 diagonals; bands of twice that, half overlapping, hold it whole.
        band = (at - place) // (self.edits[item] + 1)
        rows = np.stack([np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)], 1)
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))] if len(rows) else rows
        item, band, place = rows.T
        reach = self.long[item] - q
        need = self.long[item] + 1 - q * (self.edits[item] + 1)
        # Passages that hold this place and the need - 1 next ones of its band.
        last = np.arange(len(rows)) + need - 1
        ok = last < len(rows)
        last = np.minimum(last, len(rows) - 1)
        ok &= (item[last] == item) & (band[last] == band) & (place[last] - place <= reach)
        item, band, low, high = item[ok], band[ok], place[last[ok]] - reach[ok], place[ok]
        low, high = np.maximum(low, 0), np.minimum(high, self.count[item] - 1)
        many = high - low + 1
        start = common.ranges(low, many)
        return np.unique(np.stack([np.repeat(item, many), start, np.repeat(band * (self.edits[item] + 1), many)], 1), axis=0)

    def find(self, text: str) -> list[tuple]:
        """``(item, passages found, start, end, edits, coverage)`` for each item of which ``text`` holds a passage."""
        points = codes(text)
        rows = self.regions(points)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        open_ = []
        for k, (item, start, low) in enumerate(rows.tolist()):
            # Rows are in order of diagonals, so the first verbatim place of a passage comes first.
            if (item, start) in best:
                continue
            edits, long = int(self.edits[item]), int(self.long[item])
            begin = max(0, start + low - edits)
            at = text.find(self.texts[item][start : start + long], begin, max(0, start + low + 3 * edits + 1 + long))
            if at >= 0:
                best[item, start] = (0, at, at + long)
            elif edits:
                open_.append(k)
        rest = rows[[k for k in open_ if tuple(rows[k, :2].tolist()) not in best]]
        for long, edits in np.unique(np.stack([self.long[rest[:, 0]], self.edits[rest[:, 0]]], 1), axis=0).tolist():
            group = rest[(self.long[rest[:, 0]] == long) & (self.edits[rest[:, 0]] == edits)]
            for part in np.array_split(group, -(-len(group) // ALIGNED)):
                wanted = np.stack([codes(self.texts[i][s : s + long]) for i, s, _ in part.tolist()])
                for (item, start, _), cost, a, b in zip(part.tolist(), *align_all(wanted, points, part[:, 1] + part[:, 2] - edits, edits), strict=True):
                    if cost <= edits and (cost, a, b) < best.get((item, start), (edits + 1, 0, 0)):
                        best[item, start] = (cost, a, b)
        by_item: dict[int, list[int]] = {}
        for item, start in sorted(best):
            by_item.setdefault(item, []).append(start)
        out = []
        for item, found in by_item.items():
            covered, end = 0, 0
            for a in found:
                b = a + int(self.long[item])
                covered, end = covered + max(0, b - max(a, end)), max(end, b)
            places = [best[item, a] for a in found]
            out.append((item, len(found), min(p[1] for p in places), max(p[2] for p in places),
                        max(p[0] for p in places), covered / int(self.lengths[item])))
        return out


def align_all(wanted: np.ndarray, text: np.ndarray, begin: np.ndarray, edits: int) -> tuple[list[int], list[int], list[int]]:
    """:func:`align` of many passages of one length at once: row ``k`` inside the diagonals from ``begin[k]`` on.

    Returns the least edits, and start and end in ``text``; edits beyond the budget mean no match.
    """
    rows, long = wanted.shape
    wide = 4 * edits + 2  # the band's 2 * (edits + 1) diagonals, and as far as an end may drift on both sides
    at = begin[:, None] + np.arange(long + wide)
    inside = (at >= 0) & (at < len(text))
    near = np.where(inside, text[np.clip(at, 0, len(text) - 1)], np.uint32(0xFFFFFFFF))
    # A cell is edits * one + first diagonal, so the least edits and then the first start win.
    one, column = 64, np.arange(wide)
    cost = np.tile(column, (rows, 1))
    for i in range(long):
        new = cost + one * (near[:, i : i + wide] != wanted[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + one)
        cost = np.minimum.accumulate(new - one * column, axis=1) + one * column
    end = cost.argmin(1)
    least = cost[np.arange(rows), end]
    start = np.clip(begin + least % one, 0, len(text))
    return (least // one).tolist(), start.tolist(), np.clip(begin + end + long, 0, len(text)).tolist()


def align(passage: str, region: str, edits: int) -> tuple[int, int, int] | None:
    """The least edits, then first place, at which ``passage`` fits inside ``region``; None beyond ``edits``.

    Only cells within the band that the region's length and the budget leave are computed.
    """
    at = region.find(passage)
    if at >= 0:
        return 0, at, at + len(passage)
    far, width = edits + 1, len(region) - len(passage) + edits
    # row: columns from .. to of the passage's prefix; (cost, start in the region)
    row = {j: (0, j) for j in range(len(region) + 1)}
    for i, letter in enumerate(passage, 1):
        new: dict[int, tuple[int, int]] = {}
        for j in range(max(0, i - edits), min(len(region), i + width) + 1):
            cost, start = far, 0
            if j and j - 1 in row:
                c, s = row[j - 1]
                cost, start = c + (region[j - 1] != letter), s
            if j in row and row[j][0] + 1 < cost:
                cost, start = row[j][0] + 1, row[j][1]
            if j - 1 in new and new[j - 1][0] + 1 < cost:
                cost, start = new[j - 1][0] + 1, new[j - 1][1]
            if cost < far:
                new[j] = (cost, start)
        row = new
        if not row:
            return None
    cost, start, end = min((c, s, j) for j, (c, s) in row.items())
    return cost, start, end


def _finder(index: Index):
    counts, keys = index.count, index.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, most=1 << 20):
            texts = [folded(t) for t in batch.column(2).to_pylist()]
            # One pass over all texts of the part tells which of them need a closer look.
            near = _touched(index, texts)
            rows = [(i, *leak) for i in near for leak in index.find(texts[i])]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at),
                    pa.array([keys[r[1]][0] for r in rows], pa.string()), pa.array([keys[r[1]][1] for r in rows], pa.string()),
                    pa.array([int(counts[r[1]]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
                    pa.array([r[5] for r in rows], pa.int32()), pa.array([r[6] for r in rows], pa.float64()),
                ],
                names=["vault", "path", "reserved_vault", "reserved_path", "passages", "found", "start", "end", "edits", "coverage"],
            )

    return run


def _touched(index: Index, texts: list[str]) -> list[int]:
    joined = codes("\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    out: set[int] = set()
    for q, (seen, known, *_) in index.by_q.items():
        h = grams(joined, q)
        at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        out.update(np.searchsorted(ends, at[known[slot] == h[at]], side="right").tolist())
    return sorted(i for i in out if i < len(texts))


def find_leaks(notes: DataFrame, reserved: DataFrame, block: int = BLOCK) -> DataFrame:
    """Notes that hold passages of ``reserved`` notes (also ``vault, path, content``).

    Every 96 code points of a reserved text are a passage, from each position on (a shorter
    text is one passage).  A passage is found where a stretch of the note is within
    5 % edits of it: shared q-grams are counted in overlapping bands of diagonals,
    passages with fewer than the q-gram lemma demands are dropped, and the others
    verified by alignment in the band.  Case and runs of white space don't count.
    The whole text of every note is searched.

    Returns a row per note and reserved note of which it holds a passage: the
    number of its ``passages``, how many were ``found``, where (``start``, ``end`` in
    the folded text), the most ``edits`` and the share of the reserved text covered.

    Reserved notes go to the tasks in blocks of about ``block`` code points, so
    their number is not bounded; each block reads the notes once.  Reserved
    texts under 24 code points are found verbatim only, be it inside a word; empty and NULL
    ones have no passages.  Empty notes hold nothing.  Repeated rows get a row each; an empty table on either side
    gives no rows.
    """
    notes, reserved = common.keyed(notes), common.keyed(reserved).distinct()
    spark = notes.sparkSession
    total = reserved.agg(F.sum(F.length("content"))).first()[0] or 0
    parts, out = -(-total // block), spark.createDataFrame([], LEAKS)
    for part in range(parts):
        rows = reserved.where(F.pmod(F.xxhash64("vault", "path", "content"), F.lit(parts)) == part).collect()
        index = Index(sorted((r["vault"], r["path"], r["content"]) for r in rows))
        shared = spark.sparkContext.broadcast(index)
        out = out.unionByName(notes.mapInArrow(common.lean(lambda b, s=shared: _finder(s.value)(b)), LEAKS))
    return out
