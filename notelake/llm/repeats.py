"""Byte strings that occur earlier in the notes, by anchors and suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm import common
from notelake.llm.suffixes import equal_neighbours, suffix_array

LENGTH = 100  # bytes of a repeated string
GRAM = 32  # bytes hashed at an anchor, a power of two below LENGTH
PART = 1 << 17  # bytes whose anchors are looked for at once, about; arrays of more come from the system each time
STRETCH = 1 << 19  # bytes of stretches that go on at once, about
SORTED = 1 << 20  # bytes in one suffix array, about
CROWD = 512  # different surroundings of one anchor in a suffix array; beyond, windows are shuffled one by one

KEY = "vault string, path string, tie int"
_KEY = ["vault", "path", "tie"]


def gram_hashes(flat: np.ndarray, gram: int, salt: int = 0) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on, another for another ``salt``."""
    h, size = common.mix64(flat.astype(np.uint64) + np.uint64(1 + (salt << 8))), 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint64(31)))
            size *= 2
    return np.maximum(common.mix64(h), np.uint64(1))


def anchors(h: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the least gram of every window of ``length`` bytes of a text.

    Equal windows have equal least grams at the same places in them.
    """
    n, width = len(h) + gram - 1, length - gram + 1
    least, span = h, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    # Windows across the end of a text don't count: 0 is below any hash.
    inside = np.zeros(n - length + 2, dtype=np.int64)
    starts, ends = at[:-1], at[1:] - length + 1
    whole = ends > starts
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole], -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    most, span = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)]), 1
    while span < width:
        step = min(span, width - span)
        most = np.maximum(most[:-step], most[step:])
        span += step
    return np.flatnonzero(most == h)


ANCHORS = f"h bigint, ch bigint, {KEY}, begin bigint, end bigint"


def _anchor_rows(length: int, gram: int):
    """Anchors ``h`` with where the windows that hold them lie and a hash ``ch`` of all these bytes."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "content", PART):
            flat, at = common.utf8(batch.column(3))
            place, h = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
            if len(flat) >= length:
                h = gram_hashes(flat, gram)
                place = anchors(h, at, length, gram)
            owner = np.searchsorted(at, place, side="right") - 1
            begin, end = np.maximum(at[owner], place - reach), np.minimum(at[owner + 1], place + gram + reach)
            ch = (end - begin).astype(np.uint64) << np.uint64(32) | (place - begin).astype(np.uint64)
            with np.errstate(over="ignore"):
                for step in range(0, gram + 2 * reach, gram):
                    ch = common.mix64(ch * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(begin + step, end - gram)])
            who = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[place].view(np.int64)), pa.array(ch.view(np.int64))]
                + [batch.column(i).take(who) for i in range(3)]
                + [pa.array(begin - at[owner]), pa.array(end - at[owner])],
                names=["h", "ch", "vault", "path", "tie", "begin", "end"],
            )

    return run


#: kind 0: all windows there are earlier elsewhere; 1: they may be, the bytes have to be compared; 2: so, around a crowded anchor.
MARKED = f"kind tinyint, h bigint, {KEY}, begin bigint, end bigint"


def _like_before(batch: pa.RecordBatch, columns) -> np.ndarray:
    """Whether each row but the first equals the one before it in these columns."""
    same = np.ones(max(0, batch.num_rows - 1), dtype=bool)
    for k in columns:
        column = batch.column(k)
        same &= pc.equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return same


def _marked(crowd: int):
    """Of anchors in order of h, ch, note and place: what repeats, and what differs around one anchor."""

    def rows(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        kinds = pa.array(np.full(batch.num_rows, kind, dtype=np.int8))
        return pa.RecordBatch.from_arrays([kinds, batch.column(0), *batch.columns[2:]], names=[f.split()[0] for f in MARKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the first rows of the surroundings of the last anchor so far
        kept, last, spot = 0, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            h, ch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[last is None or last != (h[0], ch[0])], (h[1:] != h[:-1]) | (ch[1:] != ch[:-1])])
            # A repeated row of a note is no later occurrence.
            same = np.concatenate([[spot == tuple(batch.column(k)[0].as_py() for k in range(2, 6))], _like_before(batch, range(2, 6))])
            spot = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(2, 6))
            yield rows(batch.filter(pa.array(~new & ~same)), 0)
            firsts = batch.filter(pa.array(new))
            fh = h[new]
            if held and (not len(fh) or fh[0] != last[0]) and h[0] != last[0]:
                if kept > 1:
                    yield from (rows(b, 2 if kept > crowd else 1) for b in held)
                held, kept = [], 0
            last = (h[-1], ch[-1])
            if not len(fh):
                continue
            edge = np.append(np.flatnonzero(np.concatenate([[True], fh[1:] != fh[:-1]])), len(fh))
            size = np.diff(edge)
            if held and fh[0] != held[-1].column(0)[0].as_py():
                if kept > 1:
                    yield from (rows(b, 2 if kept > crowd else 1) for b in held)
                held, kept = [], 0
            if held:
                # The anchor of the batch before goes on.
                held.append(firsts.slice(0, int(size[0])))
                kept += int(size[0])
                if len(size) == 1:
                    if kept > 2 * crowd:
                        yield from (rows(b, 2) for b in held)
                        held = [held[-1].slice(held[-1].num_rows - 1)]
                    continue
                if kept > 1:
                    yield from (rows(b, 2 if kept > crowd else 1) for b in held)
                held, kept = [], 0
                edge, size = edge[1:], size[1:]
            whole = np.repeat(size, size)[: int(edge[-2] - edge[0])]
            inner = firsts.slice(int(edge[0]), int(edge[-2] - edge[0]))
            yield rows(inner.filter(pa.array((whole > 1) & (whole <= crowd))), 1)
            yield rows(inner.filter(pa.array(whole > crowd)), 2)
            held, kept = [firsts.slice(int(edge[-2]))], int(size[-1])
        if kept > 1:
            yield from (rows(b, 2 if kept > crowd else 1) for b in held)

    return run


FOUND = f"kind tinyint, h bigint, {KEY}, begin bigint, end bigint, around binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches to compare."""
    for batch in common.pieces(batches, "content", STRETCH):
        flat, at = common.utf8(batch.column(3))
        marks, ends = batch.column(4).flatten(), batch.column(4).offsets.to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        kind, h, begin, end = (marks.field(c) for c in ("kind", "h", "begin", "end"))
        first, sizes = at[owner] + begin.to_numpy(), end.to_numpy() - begin.to_numpy()
        edges = np.concatenate([[0], np.cumsum(sizes)])
        # Parts of about STRETCH bytes, as stretches of one anchor overlap those of the next.
        start = 0
        while start < len(owner):
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + STRETCH, side="right")) - 1)
            part, who = slice(start, stop), pa.array(owner[start:stop])
            data = flat[common.ranges(first[part], sizes[part])]
            offsets = (edges[start : stop + 1] - edges[start]).astype(np.int32)
            around = pa.BinaryArray.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [kind[part], h[part]] + [batch.column(i).take(who) for i in range(3)] + [begin[part], end[part], around],
                names=[f.split()[0] for f in FOUND.split(", ")],
            )
            start = stop


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


SPANS = f"{KEY}, begin bigint, end bigint"


def _extent(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The most first values that each row of bytes shares with another one of its group."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort([*words.T[::-1], group])
    rows, group = rows[order], group[order]
    unlike = rows[1:] != rows[:-1]
    shared = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    shared[group[1:] != group[:-1]] = 0
    out = np.zeros(len(rows), dtype=np.int64)
    out[order] = np.maximum(np.append(shared, 0), np.append(0, shared))
    return out


class _Sorter:
    """Finds repeated windows among surroundings, those of an anchor one after the other."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram, self.reach = length, gram, length - gram
        self.given: list[list[tuple]] = []  # surroundings as they came, a list for each anchor
        self.given_size = 0
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, rows: list[tuple]) -> list[tuple]:
        self.given.append(rows)
        self.given_size += sum([len(r[4]) for r in rows])
        if self.given_size >= SORTED:
            self._trim()
        return self.sort() if self.size >= SORTED else []

    def _places(self, rows: list[tuple]) -> list[int] | None:
        """Where the anchor lies in each of its surroundings, if that is certain."""
        gram = next((r[4][self.reach : self.reach + self.gram] for r in rows if r[3] > 0), None)
        places = []
        for r in rows:
            # Only what begins with its text may have less than the whole reach before the anchor.
            place = self.reach
            if r[3] == 0:
                place = -1 if gram is None else r[4].find(gram)
                if place < 0 or r[4].find(gram, place + 1) >= 0:
                    return None
            places.append(place)
        return places

    def _trim(self) -> None:
        """Lets go what can't be repeated: a string that two surroundings share lies alike around their anchor,
        so it ends where they begin to differ on either side."""
        rows, places, group = [], [], []
        for k, given in enumerate(self.given):
            found = self._places(given)
            if found is None:
                self._keep(given)
            else:
                rows += given
                places += found
                group += [k] * len(given)
        self.given, self.given_size = [], 0
        if not rows:
            return
        sizes, before, of = np.array([len(r[4]) for r in rows]), np.array(places), np.array(group)
        flat, at, after = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes - before
        width = -(-self.length // 8) * 8
        left, right = np.zeros((2, len(rows), width), dtype=np.uint8)
        right[np.arange(width) < after[:, None]] = flat[common.ranges(at + before, after)]
        left[np.arange(width) >= width - before[:, None]] = flat[common.ranges(at, before)]
        most = np.minimum(_extent(left[:, ::-1], of), before)
        begin, end = before - most, before + np.minimum(_extent(right, of), after)
        keep = end - begin >= self.length
        keep &= (np.bincount(of, weights=keep) > 1)[of]
        cut = zip(np.flatnonzero(keep).tolist(), begin[keep].tolist(), end[keep].tolist(), strict=True)
        self._keep([(*rows[i][:3], rows[i][3] + a, rows[i][4][a:b]) for i, a, b in cut])

    def _keep(self, rows: list[tuple]) -> None:
        self.waiting += rows
        self.size += sum([len(r[4]) + 1 for r in rows])

    def sort(self) -> list[tuple]:
        """Stretches of the waiting surroundings that occur earlier among them."""
        self._trim()
        waiting, self.waiting, self.size = sorted(self.waiting, key=lambda w: w[:4]), [], 0
        if not waiting:
            return []
        length = self.length
        sizes = np.array([len(w[4]) for w in waiting])
        # UTF-8 has no 0xFF, so values one up fit a byte and 0 ends each stretch.
        text = np.frombuffer(b"\xff".join(w[4] for w in waiting) + b"\xff", dtype=np.uint8) + np.uint8(1)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        owner = np.repeat(np.arange(len(waiting)), sizes + 1)
        left = starts[owner] + sizes[owner] - np.arange(len(text))
        order = suffix_array(text, length, left >= length)
        same = equal_neighbours(text, order, length)
        # Earliest first: notes in order, then the place in the note.
        notes = [w[:3] for w in waiting]
        rank = np.cumsum([0] + [int(notes[i] != notes[i - 1]) for i in range(1, len(notes))])
        place = np.array([w[3] for w in waiting])[owner] + np.arange(len(text)) - starts[owner]
        when = rank[owner[order]].astype(np.int64) << 40 | place[order]
        run = np.flatnonzero(~same)
        first = np.minimum.reduceat(when, run)[np.cumsum(~same) - 1] if len(order) else when
        again = np.sort(order[when != first])
        out = []
        if len(again):
            # Windows that overlap in one stretch are one span.
            cut = np.concatenate([[True], (np.diff(again) > length) | (owner[again[1:]] != owner[again[:-1]])])
            heads = np.flatnonzero(cut)
            tails = np.append(heads[1:], len(again)) - 1
            for a, b in zip(again[heads].tolist(), again[tails].tolist(), strict=True):
                w, shift = waiting[owner[a]], int(place[a]) - a
                out.append((*w[:3], a + shift, b + shift + length))
        return out


def _sorted_spans(length: int, gram: int = GRAM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, group, present = _Sorter(length, gram), {}, None
        for batch in batches:
            out = []
            for h, *row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5, 7)), strict=True):
                if h != present:
                    out += sorter.add(list(group))
                    group, present = {}, h
                group[tuple(row)] = None  # a repeated row is the same note
            yield _batch(out, SPANS)
        yield _batch(sorter.add(list(group)) + sorter.sort(), SPANS)

    return run


WINDOWS = f"w1 bigint, w2 bigint, {KEY}, begin bigint"


def window_hashes(flat: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on, another for another ``salt``."""
    size = 1 << (length.bit_length() - 1)
    h = gram_hashes(flat, size, salt)
    last = len(flat) - length + 1
    with np.errstate(over="ignore"):
        return common.mix64(h[:last] * np.uint64(0xC2B2AE3D27D4EB4F) + common.mix64(h[length - size :][:last] + np.uint64(salt)))


def _windows(length: int):
    """All windows of the stretches, with two 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "around", PART):
            flat, at = common.utf8(batch.column(7))
            counts = np.maximum(np.diff(at) - length + 1, 0)
            place, owner = common.ranges(at[:-1], counts), np.repeat(np.arange(batch.num_rows), counts)
            none = np.zeros(0, dtype=np.uint64)
            hashes = [window_hashes(flat, length, salt)[place] if len(place) else none for salt in (1, 2)]
            who, begin = pa.array(owner), batch.column(5).to_numpy()[owner] + place - at[:-1][owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)) for h in hashes] + [batch.column(i).take(who) for i in (2, 3, 4)] + [pa.array(begin)],
                names=[f.split()[0] for f in WINDOWS.split(", ")],
            )

    return run


def _later(length: int):
    """Of windows in order of digest, note and place, all but the first of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leads = None, False  # the last row so far, and whether it is the first of its digest or repeats that row
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            w1, w2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            spot = tuple(c[0].as_py() for c in batch.columns)
            new = np.concatenate([[last is None or last[:2] != spot[:2]], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
            like = np.concatenate([[last is not None and last == spot], _like_before(batch, range(2, 6))])
            heads = np.flatnonzero(np.concatenate([[True], new[1:] | ~like[1:]]))
            lead = new[heads]
            lead[0] |= leads & like[0]
            first = np.repeat(lead, np.diff(np.append(heads, n)))
            last, leads = tuple(c[n - 1].as_py() for c in batch.columns), bool(first[-1])
            rest = batch.filter(pa.array(~first))
            begin = rest.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*rest.columns[2:5], pa.array(begin), pa.array(begin + length)], names=[f.split()[0] for f in SPANS.split(", ")])

    return run


RESULT = "vault string, path string, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in common.pieces(batches, "content", 4 << 20):
        flat, at = common.utf8(batch.column(2))
        whole, sizes, spans, kept = flat.tobytes(), [], [], []
        for i, found in enumerate(batch.column(3).to_pylist()):
            text = whole[at[i] : at[i + 1]]
            merged: list[list[int]] = []
            for a, b in sorted((s["begin"], s["end"]) for s in found or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for m in merged for x in m), len(text)]
            sizes.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["vault", "path", "n_bytes", "spans", "kept"],
        )


def remove_repeats(notes: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Notes without the bytes of strings of ``length`` bytes that also start earlier.

    Earlier means in a note with a smaller ``(vault, path)``, or before in the same note.
    Strings overlap freely, don't cross notes, and are judged on the input.

    Every such string holds an anchor, its least gram.  Notes with a text that an earlier one has go as a
    whole.  Anchors that occur once are let go; around the others, equal surroundings (all bytes of strings
    that hold the anchor, by a 64-bit hash beside that of the anchor) collapse to the earliest.  What differs
    around one anchor, as far as two of its surroundings agree, is put into suffix arrays of about a megabyte (some
    suffixes sorted, the rest induced), where neighbours that share ``length`` bytes repeat each other.  An anchor with more than
    ``crowd`` different surroundings has its strings shuffled one by one instead.

    Returns ``vault, path, n_bytes, spans`` (removed runs, bytes) and ``kept`` (the remaining bytes; they
    may be cut inside a character).  NULL and empty texts keep nothing and lose nothing.  Rows that
    repeat a key and text are one note and all get its result; of rows of one key with different
    texts, those with a smaller hash are earlier.  An empty table gives no rows.
    """
    notes = common.keyed(notes).withColumn("tie", F.hash("content"))
    copies = _copies(notes, length)
    dropped = common.bitmap(copies.select(F.xxhash64(*_KEY).alias("h")))
    marked = common.stored(
        _without(notes, copies, dropped)
        .select(*_KEY, "content")
        .mapInArrow(common.lean(_anchor_rows(length, gram)), ANCHORS)
        .repartition("h").sortWithinPartitions("h", "ch", *_KEY, "begin")
        .mapInArrow(common.lean(_marked(crowd)), MARKED),
        "repeat-anchors",
    )
    unlike = marked.where("kind > 0")
    wanted = common.stored(
        unlike.groupBy(*_KEY).agg(F.collect_list(F.struct("kind", "h", "begin", "end")).alias("marks")), "repeat-wanted"
    )
    bits = common.bitmap(wanted.select(F.xxhash64(*_KEY).alias("h")))
    found = common.stored(
        _only(notes, bits).join(wanted, _KEY).select(*_KEY, "content", "marks").mapInArrow(common.lean(_surroundings), FOUND),
        "repeat-surroundings",
    )
    spans = (
        found.where("kind = 1").repartition("h").sortWithinPartitions("h", *_KEY, "begin").mapInArrow(common.lean(_sorted_spans(length, gram)), SPANS)
    )
    windows = found.where("kind = 2").mapInArrow(common.lean(_windows(length)), WINDOWS).repartition("w1", "w2")
    windows = windows.sortWithinPartitions("w1", "w2", *_KEY, "begin").mapInArrow(common.lean(_later(length)), SPANS)
    merged = common.stored(
        copies.select(*_KEY, F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end"))
        .unionByName(marked.where("kind = 0").select(*_KEY, "begin", "end"))
        .unionByName(spans)
        .unionByName(windows)
        .groupBy(*_KEY).agg(F.collect_set(F.struct("begin", "end")).alias("found")),
        "repeat-spans",
    )
    bits = common.bitmap(merged.select(F.xxhash64(*_KEY).alias("h")))
    # Notes without any span keep out of the shuffle.
    whole = _only(notes, bits, inside=False).select("vault", "path", "content", F.lit(None).cast(merged.schema["found"].dataType).alias("found"))
    cut = _only(notes, bits).join(merged, _KEY, "left").select("vault", "path", "content", "found")
    return whole.unionByName(cut).mapInArrow(common.lean(_cut), RESULT)


def _copies(notes: DataFrame, length: int) -> DataFrame:
    """Notes whose whole text an earlier note has."""
    texts = common.stored(
        notes.select(*_KEY, F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("bigint").alias("n_bytes"))
        .where(F.col("n_bytes") >= length).distinct(),
        "repeat-texts",
    )
    first = common.stored(
        texts.groupBy("sha").agg(F.min(F.struct(*_KEY)).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeat-firsts"
    )
    return common.stored(texts.join(first, "sha").where(F.struct(*_KEY) != F.col("first")).select(*_KEY, "n_bytes"), "repeat-copies")


def _only(notes: DataFrame, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """Notes whose key may be (or certainly is not) among those a bitmap was made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = common.in_bitmap(bits, batch.column(4).to_numpy())
            yield batch.select([0, 1, 2, 3]).filter(pa.array(hit if inside else ~hit))

    schema = f"{KEY}, content string"
    return notes.select(*_KEY, "content", F.xxhash64(*_KEY).alias("h")).mapInArrow(common.lean(run), schema)


def _without(notes: DataFrame, dropped: DataFrame, bits: np.ndarray) -> DataFrame:
    """``notes`` but for the keys in ``dropped``; only those that its bitmap holds are joined."""
    return _only(notes, bits, inside=False).unionByName(_only(notes, bits).join(dropped.select(*_KEY), _KEY, "left_anti"))
