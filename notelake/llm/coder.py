"""A range coder for ids whose probabilities adapt: predictions of orders 0 to 2 are mixed.

Blocks are independent: each starts from the same state.  Many blocks are coded at
once, position by position, so one step is a few array operations over all of them.
All arithmetic is on integers, so a block decodes alike everywhere.
"""

from __future__ import annotations

import numpy as np

SLOTS = 1 << 12  # contexts of order 1 and of order 2, and counted ids of order 0, per block
NODES = 1 << 10  # contexts of a literal's later digits, per block
TOTAL = 1 << 16  # of the frequencies of a step
TOP, BOTTOM, MASK = np.uint64(48), np.uint64(1 << 40), np.uint64((1 << 56) - 1)
RATE, GAIN = 5, 1984  # of frequencies: loss by shift, gain of the coded symbol
HITS = 4  # what an id can be: as order 2, 1 or 0 predicts, or none of these

_EIGHT, _ONE = np.uint64(8), np.uint64(1)


class _Range:
    """Carry-less range coding of 56 bits in every lane.

    A step narrows the span to a symbol's share; ``settle`` moves finished bytes out.  A span of 2**40 bears two
    steps of 16 bits before it has to be settled.
    """

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.span = np.full(lanes, MASK, dtype=np.uint64)

    def part(self, at: np.ndarray) -> _Range:
        """The state of some lanes, for a few steps; ``back`` returns it."""
        raise NotImplementedError

    def step(self, ends: np.ndarray, symbols: np.ndarray | None) -> np.ndarray:
        """Codes a symbol per lane; ``ends``: cumulated frequencies of a row per lane, the last TOTAL."""
        unit = self.span >> np.uint64(16)
        if symbols is None:
            symbols = self.find(ends, unit)
        row = np.arange(len(ends)) * ends.shape[1] + symbols
        flat = ends.ravel()
        below = np.where(symbols > 0, flat[row - 1], 0)
        self.low += unit * below.astype(np.uint64)
        self.span[:] = unit * (flat[row] - below).astype(np.uint64)
        return symbols

    def settle(self) -> None:
        go = np.flatnonzero(((self.low ^ (self.low + self.span)) >> TOP == 0) | (self.span < BOTTOM))
        while len(go):
            low, span = self.low[go], self.span[go]
            same = (low ^ (low + span)) >> TOP == 0
            span = np.where(same, span, (~low + _ONE) & (BOTTOM - _ONE))
            self.shift(go, low)
            low, span = (low << _EIGHT) & MASK, (span << _EIGHT) & MASK
            self.low[go], self.span[go] = low, span
            go = go[((low ^ (low + span)) >> TOP == 0) | (span < BOTTOM)]

    def shift(self, go: np.ndarray, low: np.ndarray) -> None:
        raise NotImplementedError

    def find(self, ends: np.ndarray, unit: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Encoder(_Range):
    def __init__(self, lanes: int, most: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, most), dtype=np.uint8)
        self.size = np.zeros(lanes, dtype=np.int64)
        self.lanes: np.ndarray | None = None  # of the whole, where this is a part

    def part(self, at: np.ndarray) -> Encoder:
        made = Encoder.__new__(Encoder)
        made.low, made.span, made.size, made.out, made.lanes = self.low[at], self.span[at], self.size[at], self.out, at
        return made

    def back(self, part: Encoder) -> None:
        self.low[part.lanes], self.span[part.lanes], self.size[part.lanes] = part.low, part.span, part.size

    def room(self, size: np.ndarray) -> None:
        """Space for what one position can put out, in lanes that hold ``size`` bytes."""
        if len(size) and int(size.max()) + 64 > self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)

    def shift(self, go: np.ndarray, low: np.ndarray) -> None:
        lanes = go if self.lanes is None else self.lanes[go]
        self.out[lanes, self.size[go]] = (low >> TOP).astype(np.uint8)
        self.size[go] += 1

    def finish(self) -> list[bytes]:
        for _ in range(7):
            self.shift(np.arange(len(self.low)), self.low)
            self.low = (self.low << _EIGHT) & MASK
        return [self.out[i, : self.size[i]].tobytes() for i in range(len(self.low))]


class Decoder(_Range):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        most = max((len(p) for p in payloads), default=0) + 16
        self.data = np.zeros((len(payloads), most), dtype=np.uint8)
        for i, p in enumerate(payloads):
            self.data[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
        self.value = np.zeros(len(payloads), dtype=np.uint64)
        for k in range(7):
            self.value = self.value << _EIGHT | self.data[:, k]
        self.size = np.full(len(payloads), 7, dtype=np.int64)
        self.lanes: np.ndarray | None = None

    def part(self, at: np.ndarray) -> Decoder:
        made = Decoder.__new__(Decoder)
        made.low, made.span, made.size, made.value, made.data, made.lanes = (
            self.low[at], self.span[at], self.size[at], self.value[at], self.data, at,
        )
        return made

    def back(self, part: Decoder) -> None:
        self.low[part.lanes], self.span[part.lanes] = part.low, part.span
        self.size[part.lanes], self.value[part.lanes] = part.size, part.value

    def room(self, size: np.ndarray) -> None:
        pass

    def shift(self, go: np.ndarray, low: np.ndarray) -> None:
        lanes = go if self.lanes is None else self.lanes[go]
        place = np.minimum(self.size[go], self.data.shape[1] - 1)
        self.value[go] = (self.value[go] << _EIGHT) & MASK | self.data[lanes, place]
        self.size[go] += 1

    def find(self, ends: np.ndarray, unit: np.ndarray) -> np.ndarray:
        # A broken payload may lie outside; it is kept in range here and found by the checksum.
        spot = np.minimum((self.value - self.low) // np.maximum(unit, _ONE), np.uint64(TOTAL - 1)).astype(np.int32)
        return (ends <= spot[:, None]).sum(axis=1)


def _fresh(*shape: int) -> np.ndarray:
    """Rows of equal frequencies; with the floor added in ``_ends`` they stay below TOTAL, so 16 bits hold them."""
    return np.full((int(np.prod(shape[:-1])), shape[-1]), (TOTAL - 2048) // shape[-1], dtype=np.uint16)


def _ends(rows: np.ndarray) -> np.ndarray:
    ends = np.cumsum(rows + 64, axis=-1, dtype=np.int32)
    ends[..., -1] = TOTAL
    return ends


def _run(coder: Encoder | Decoder, sizes: np.ndarray, bits: int, ids: np.ndarray | None) -> np.ndarray:
    """Codes ``ids`` (a column per block) or decodes as many as ``sizes`` says; blocks come longest first."""
    lanes, most = len(sizes), int(sizes.max(initial=0))
    levels, base = -(-bits // 4), np.arange(lanes, dtype=np.int64)
    given = ids is not None
    out = ids if given else np.zeros((most, lanes), dtype=np.int32)
    # What followed a context last, and how often in a row it was right (the low 4 bits): order 2, then order 1.
    followed = np.zeros(lanes * 2 * SLOTS, dtype=np.int32)
    table = (base * 2 * SLOTS)[:, None] + np.array([0, SLOTS])
    seen, frequent, best = np.zeros(lanes * SLOTS, dtype=np.uint16), np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    hits = _fresh(lanes, 3, 16, HITS)
    hit_row = (base * 48)[:, None] + np.array([0, 16, 32])
    weight, recent = np.full((lanes, 3), 1 << 12, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    nodes = [min(16**k, NODES) for k in range(levels)]
    tree = [_fresh(lanes, n, 16) for n in nodes]
    last, before = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    live = np.searchsorted(-sizes, -np.arange(most), side="left")  # blocks longer than each position
    whole, now = coder, None
    for t in range(most):
        n = int(live[t])
        if now is None or n != len(now.low):
            if now is not None:
                whole.back(now)
            now = whole.part(base[:n])
        whole.room(now.size)
        now_out = getattr(whole, "out", None)
        if now_out is not None:
            now.out = now_out
        at, ids_now = base[:n], out[t, :n]
        context = np.empty((n, 2), dtype=np.int64)
        context[:, 0] = last[:n] * 0x9E5 + before[:n] * 0x3779 + (last[:n] >> 7)
        context[:, 1] = last[:n]
        context &= SLOTS - 1
        context += table[:n]
        known = followed[context]
        guess = np.empty((n, 3), dtype=np.int64)
        guess[:, :2], guess[:, 2] = known >> 4, frequent[:n]
        place = hit_row[:n].copy()
        place[:, :2] += known & 15
        place[:, 2] += recent[:n]
        rows = np.take(hits, place, axis=0)
        w = weight[:n]
        # Products and sums are whole numbers below 2**53, so the quotient is the same on every machine.
        mixed = (np.einsum("nkh,nk->nh", rows, w).astype(np.float64) / w.sum(axis=1)[:, None]).astype(np.int32)
        if given:
            equal = guess == ids_now[:, None]
            hit = np.where(equal[:, 0], 0, np.where(equal[:, 1], 1, np.where(equal[:, 2], 2, 3)))
            now.step(_ends(mixed), hit)
        else:
            hit = now.step(_ends(mixed), None)
        chosen = rows[at, :, hit]
        weight[:n] += (chosen >> 4) + 16 - (w >> 4)
        rows -= rows >> RATE
        rows[at, :, hit] += GAIN
        hits[place] = rows
        value = guess[at, np.minimum(hit, 2)]
        rare = np.flatnonzero(hit == 3)
        if len(rare):
            some, steps = now.part(rare), 1
            if now.lanes is not None:
                some.lanes, inner = now.lanes[rare], rare
            prefix = np.zeros(len(rare), dtype=np.int64)
            for k in range(levels):
                node = rare * nodes[k] + (prefix & (NODES - 1))
                row = tree[k][node]
                digit = (ids_now[rare] >> 4 * (levels - 1 - k)) & 15 if given else None
                digit = some.step(_ends(row), digit)
                row -= row >> RATE
                row[np.arange(len(rare)), digit] += GAIN
                tree[k][node] = row
                prefix = prefix << 4 | digit
                steps += 1
                if steps % 2 == 0:
                    some.settle()
            some.lanes = inner
            now.back(some)
            value[rare] = prefix
        now.settle()
        out[t, :n] = value
        right = guess[:, :2] == value[:, None]
        followed[context] = value[:, None] << 4 | np.where(right, np.minimum((known & 15) + 1, 15), 0)
        slot = at * SLOTS + (value & (SLOTS - 1))
        count = seen[slot] + np.uint16(1)
        seen[slot] = count
        better = np.flatnonzero(count > best[:n])
        frequent[better], best[better] = value[better], count[better]
        recent[:n] = (recent[:n] << 2 | hit) & 15
        before[:n], last[:n] = last[:n], value
    if now is not None:
        whole.back(now)
    return out.T


def _longest_first(sizes: list[int]) -> np.ndarray:
    return np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """A payload per block of ids below ``2**bits``."""
    order = _longest_first([len(b) for b in blocks])
    sizes = np.array([len(blocks[i]) for i in order], dtype=np.int64)
    most = int(sizes.max(initial=0))
    ids = np.zeros((most, len(blocks)), dtype=np.int32)
    for row, i in enumerate(order.tolist()):
        ids[: len(blocks[i]), row] = blocks[i]
    coder = Encoder(len(blocks), 2 * most + 64)
    _run(coder, sizes, bits, ids)
    made = coder.finish()
    out: list[bytes] = [b""] * len(blocks)
    for row, i in enumerate(order.tolist()):
        out[i] = made[row]
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int], bits: int) -> list[np.ndarray]:
    order = _longest_first(sizes)
    ids = _run(Decoder([payloads[i] for i in order]), np.asarray(sizes, dtype=np.int64)[order], bits, None)
    out: list[np.ndarray] = [ids[:0]] * len(sizes)
    for row, i in enumerate(order.tolist()):
        out[i] = ids[row, : sizes[i]].astype(np.uint32)
    return out
