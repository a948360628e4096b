"""Suffix arrays in two stages: some suffixes are sorted, the others follow from them."""

from __future__ import annotations

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last counts as smaller."""
    n = len(text)
    # The place where the run of equal values from here on ends decides.
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    last = np.repeat(ends, np.diff(np.append(-1, ends)))
    after = np.minimum(last + 1, n - 1)
    return (text[after] > text[last]) | (last == n - 1)


def _words(text: np.ndarray, more: int) -> np.ndarray:
    """The eight values from each place on as one number, for ``more`` places beyond the end too; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(more + 8, dtype=np.uint8)])
    out = np.zeros(len(text) + more, dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(out)]
    return out


def _sorted(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` values from there on; zeros follow the text.

    Values are compared some at a time, after the first ones only among suffixes that are equal so far.
    """
    if len(starts) < 2:
        return starts
    words = _words(text, depth)
    first = words[starts]
    if depth < 8:
        first >>= np.uint64(8 * (8 - depth))
    order = np.argsort(first)
    starts, first = starts[order], first[order]
    done = min(8, depth)
    same = np.concatenate([[False], first[1:] == first[:-1]])  # as the one before
    at = np.flatnonzero(same | np.append(same[1:], False))  # places in order that are still open
    same = same[at]
    while len(at) and done < depth:
        group = np.cumsum(~same) - 1
        # As many values as fit beside the number of the group.
        width = min((64 - int(group[-1]).bit_length()) // 8, depth - done, 7)
        key = words[starts[at] + done] >> np.uint64(8 * (8 - width)) | group.astype(np.uint64) << np.uint64(8 * width)
        order = np.argsort(key)
        starts[at], key = starts[at][order], key[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        left = np.flatnonzero(same | np.append(same[1:], False))
        at, same, done = at[left], same[left], done + width
    return starts


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of ``text`` (bytes) in the order of their first ``depth`` values at least.

    Only suffixes smaller than their successors are sorted directly.  Each other one follows from its
    successor: buckets of first values are scanned upwards, and what precedes a scanned suffix goes to the
    end of its own bucket's filled part.  A bucket's induced part comes before its sorted part.

    ``wanted`` marks the starts to order, by default all; others take part where a wanted one follows from them.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    smaller = _smaller(text)
    part = np.ones(n, dtype=bool) if wanted is None else wanted.copy()
    wave = np.flatnonzero(part & ~smaller) if wanted is not None else np.zeros(0, dtype=np.int64)
    while len(wave):
        wave = wave[~part[wave + 1]] + 1
        part[wave] = True
        wave = wave[~smaller[wave]]
    chained = part & ~smaller  # follow from the next one
    starts = _sorted(text, np.flatnonzero(part & smaller), depth)
    cut = np.searchsorted(text[starts], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for value in range(256):
        queue, scanned = induced[value], starts[cut[value] : cut[value + 1]]
        wave = np.concatenate(queue) if queue else scanned[:0]
        turns = []
        while len(wave):
            turns.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == value) & chained[before]]
        turns.append(scanned)
        for part in turns:
            out.append(part)
            before = part[part > 0] - 1
            before = before[(text[before] > value) & chained[before]]
            if len(before):
                first = text[before]
                order = np.argsort(first, kind="stable")
                before, first = before[order], first[order]
                edge = np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(first))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    induced[int(first[a])].append(before[a:b])
    order = np.concatenate(out)
    return order if wanted is None else order[wanted[order]]


def equal_neighbours(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares at least ``length`` values with the one before it there.

    All of ``order`` must have that many values left.
    """
    same = np.zeros(len(order), dtype=bool)
    if len(order) < 2:
        return same
    words = _words(text, 0)
    # A length under eight is compared by its own values.
    unused = np.uint64(8 * max(0, 8 - length))
    open_, here, before = np.arange(1, len(order)), order[1:], order[:-1]
    for step in [*range(0, max(1, length - 7), 8), max(0, length - 8)]:
        on = words[here + step] >> unused == words[before + step] >> unused
        open_, here, before = open_[on], here[on], before[on]
    same[open_] = True
    return same
