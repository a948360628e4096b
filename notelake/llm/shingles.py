"""Sets of word shingles of notes, as 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from notelake.llm import common

WORDS = 5
_LETTERS = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_UNDO = np.uint64(pow(int(_STEP), -1, 1 << 64))
_KEPT: list[tuple[np.ndarray, np.ndarray]] = []
_PLACES = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.where(_SPACE, np.uint64(0), _LETTERS[_LOWER])  # of a byte in a word; white space adds nothing


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, step)])) for step in (_STEP, _UNDO))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``_STEP`` and of its inverse modulo 2**64; those of usual parts are made once."""
    if not _KEPT:
        _KEPT.append(_made(1 << 18))
    power, back = _KEPT[0] if n <= 1 << 18 else _made(n)
    return power[:n], back[:n]


def words(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case) and the text it stands in."""
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inside = ~_SPACE[flat]
    first = np.zeros(len(flat) + 1, dtype=bool)
    first[at[:-1]] = True
    first[0] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[(at[1:-1] - 1)[at[1:-1] > 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    sizes = ends - starts
    power, back = _powers(len(flat))
    with np.errstate(over="ignore"):
        value = _VALUES[flat]
        value *= power
        # Powers count from the part's first byte; a factor per word lets them count from its own.
        total = np.add.reduceat(value, starts) * back[starts]
        return common.mix64(total + sizes.astype(np.uint64) * _PLACES[0]), np.searchsorted(at, starts, side="right") - 1


@dataclass
class Sets:
    """The distinct shingle hashes of each text, in order, one text after the other."""

    tokens: np.ndarray
    at: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.at[i] : self.at[i + 1]]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value per token, modulo 2**64."""
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
            return total[self.at[1:]] - total[self.at[:-1]]


def shingle_sets(flat: np.ndarray, at: np.ndarray) -> Sets:
    """Of each text: its distinct shingles of five words; of fewer words, all as one; of none, nothing."""
    n = len(at) - 1
    hashes, owner = words(flat, at)
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    parts: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        rows = len(hashes) - WORDS + 1
        joined = np.zeros(max(rows, 0), dtype=np.uint64)
        for k in range(WORDS if rows > 0 else 0):
            joined += hashes[k : k + rows] * _PLACES[k]
        joined = common.mix64(joined)
        for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if count >= WORDS:
                # Sorted where they stand, so that equal ones are neighbours.
                mine = joined[end - count : end - WORDS + 1]
                mine.sort()
                new = np.empty(len(mine), dtype=bool)
                new[0] = True
                np.not_equal(mine[1:], mine[:-1], out=new[1:])
                parts.append(mine[new])
            elif count:
                whole = hashes[end - count : end]
                total = np.sum(whole * np.array(_PLACES[:count], dtype=np.uint64), dtype=np.uint64)
                parts.append(common.mix64(np.array([total + np.uint64(count)], dtype=np.uint64)))
            else:
                parts.append(hashes[:0])
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return Sets(np.concatenate([hashes[:0], *parts]), np.concatenate([[0], np.cumsum(sizes)]))
