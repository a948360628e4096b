"""Repeated byte strings and suffix arrays against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import repeats, suffixes


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind = rng.randrange(4)
        size = rng.randrange(1, 120)
        if kind == 0:
            yield bytes(rng.choice(b"ab") for _ in range(size))
        elif kind == 1:
            yield bytes([rng.randrange(1, 250)]) * size
        elif kind == 2:
            yield (bytes(rng.choice(b"abc") for _ in range(7)) * size)[:size]
        else:
            yield bytes(rng.randrange(256) for _ in range(size))


def test_suffix_order():
    for text in texts(1, 300):
        data = np.frombuffer(text, dtype=np.uint8)
        # An end below everything, as the operator has it.
        data = np.append(np.maximum(data, 1), 0).astype(np.uint8)
        whole = data.tobytes()
        got = suffixes.suffix_array(data, len(data))
        assert got.tolist() == sorted(range(len(data)), key=lambda i: whole[i:])
        shallow = suffixes.suffix_array(data, 8)
        assert sorted(shallow.tolist()) == list(range(len(data)))
        keys = [whole[i : i + 8] for i in shallow]
        assert keys == sorted(keys)
        left = len(data) - shallow
        order = shallow[left >= 8]
        same = suffixes.equal_neighbours(data, order, 8)
        assert same.tolist() == [k > 0 and whole[order[k] : order[k] + 8] == whole[order[k - 1] : order[k - 1] + 8] for k in range(len(order))]
    assert len(suffixes.suffix_array(np.zeros(0, dtype=np.uint8), 5)) == 0


def brute(rows, length):
    seen, out = set(), []
    for key, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(part)
        spans = [k for k in range(len(data)) if gone[k] and not (k and gone[k - 1])]
        out.append((key, len(data), len(spans), bytes(c for c, g in zip(data, gone) if not g)))
    return out


def collection(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefg é\n") for _ in range(n))

    shared = [prose(rng.randrange(90, 400)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rng.randrange(0, 150))]
        for _ in range(rng.randrange(4)):
            piece = rng.choice(shared)
            a = rng.randrange(len(piece))
            parts += [piece[a:] if rng.random() < 0.3 else piece, prose(rng.randrange(0, 60))]
        if k % 11 == 0:
            parts.append("ab" * rng.randrange(40, 200))
        rows.append((("v", f"{k:03d}"), "".join(parts)))
    rows += [(("v", "900"), rows[0][1]), (("v", "901"), rows[0][1]), (("v", "902"), ""), (("v", "903"), "a" * 99), (("v", "904"), "a" * 1000)]
    return rows


@pytest.mark.parametrize("crowd", [4096, 3])
def test_same_as_brute_force(spark, make_notes, crowd):
    for seed in (1, 2):
        rows = collection(seed)
        got = repeats.remove_repeats(make_notes([(*k, t) for k, t in rows]).repartition(5), crowd=crowd).collect()
        assert sorted(((r.vault, r.path), r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == brute(rows, 100)


def test_nulls_repeats_and_extra_columns(spark, make_notes):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [("v", "a", text), ("v", "a", text), ("v", "b", text), ("v", "c", None), ("v", "d", ""), ("v", "e", text * 3)]
    notes = make_notes(rows).withColumns({"tie": F.lit("x"), "h": F.lit(1), "spans": F.lit(2)})
    got = sorted((r.path, r.n_bytes, [(s.start, s.end) for s in r.spans], len(r.kept)) for r in repeats.remove_repeats(notes).collect())
    # The last note repeats the first text, and then itself across the seams of its copies.
    last = brute([(("v", "a"), text), (("v", "e"), text * 3)], 100)[1]
    assert got[:5] == [("a", 300, [], 300), ("a", 300, [], 300), ("b", 300, [(0, 300)], 0), ("c", 0, [], 0), ("d", 0, [], 0)]
    assert (got[5][0], len(got[5][2]), got[5][3]) == ("e", last[2], len(last[3]))
    assert repeats.remove_repeats(make_notes(rows).limit(0)).collect() == []


def test_anchors_of_equal_windows_agree():
    rng = random.Random(9)
    piece = bytes(rng.choice(b"abcdef") for _ in range(100))
    places = []
    for _ in range(20):
        before = bytes(rng.choice(b"abcdef") for _ in range(rng.randrange(0, 200)))
        data = np.frombuffer(before + piece + before, dtype=np.uint8)
        h = repeats.gram_hashes(data, 32)
        place = repeats.anchors(h, np.array([0, len(data)]), 100, 32).tolist()
        places.append(min((int(h[p]), p - len(before)) for p in place if len(before) <= p <= len(before) + 68))
    assert len(set(places)) == 1


def test_marks_don_t_depend_on_batches():
    """Groups of anchors over the ends of Arrow batches are marked as in one batch."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(12), rng.randrange(3), "v", f"{rng.randrange(4)}", 0, rng.randrange(9), 200) for _ in range(200))
    rows = sorted(rows + rows[::5])
    names = ["h", "ch", "vault", "path", "tie", "begin", "end"]
    table = repeats.pa.Table.from_pylist([dict(zip(names, r)) for r in rows])

    def run(size, crowd):
        got = []
        for batch in repeats._marked(crowd)(iter(table.to_batches(max_chunksize=size))):
            got += [tuple(r.values()) for r in batch.to_pylist()]
        return sorted(got)

    def want(crowd):
        out = []
        for h in {r[0] for r in rows}:
            kinds = len({r[1] for r in rows if r[0] == h})
            seen = set()
            for r in sorted({r for r in rows if r[0] == h}):
                if r[1] in seen:
                    out.append((0, h, *r[2:]))
                elif kinds > 1:
                    out.append((2 if kinds > crowd else 1, h, *r[2:]))
                seen.add(r[1])
        return sorted(out)

    for size in (200, 17, 5, 2, 1):
        assert run(size, 100) == want(100), size
        assert run(size, 2) == want(2), size


def test_wanted_suffixes_come_in_the_same_order_and_no_others_are_sorted(monkeypatch):
    rng = np.random.default_rng(6)
    for letters, depth in ((2, 40), (3, 20), (200, 9), (1, 30), (2, 5)):
        data = rng.integers(1, 1 + letters, 3000).astype(np.uint8)
        data[2000:2900] = data[500:1400]
        wanted = np.zeros(len(data), dtype=bool)
        wanted[:600] = wanted[2000:2600] = True
        calls, sort = [], suffixes._sorted
        monkeypatch.setattr(suffixes, "_sorted", lambda text, starts, depth: (calls.append(len(starts)), sort(text, starts, depth))[1])
        part = suffixes.suffix_array(data, depth, wanted)
        assert sorted(part.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [bytes(data[i : i + depth]) for i in part.tolist()]
        assert keys == sorted(keys)
        assert letters == 1 or calls[0] < 1200
        monkeypatch.undo()


def test_surroundings_are_the_bytes_of_the_text():
    texts, marks = ["añb" * 40, "", "xyz" * 50], [[(1, 5, 3, 110), (2, 6, 0, 160)], [], [(1, -7, 10, 120)]]
    names = ("kind", "h", "begin", "end")
    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(["v"] * 3), pa.array(["a", "b", "c"]), pa.array([1, 2, 3], pa.int32()), pa.array(texts),
            pa.array([[dict(zip(names, m)) for m in ms] for ms in marks], pa.list_(pa.struct(list(zip(names, kinds))))),
        ],
        names=["vault", "path", "tie", "content", "marks"],
    )
    got = [tuple(r.values()) for b in repeats._surroundings(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    want = [
        (k, h, "v", path, tie, a, b, text.encode()[a:b])
        for path, tie, text, ms in zip("abc", (1, 2, 3), texts, marks) for k, h, a, b in ms
    ]
    assert got == want


def _stretches(texts, length, gram):
    """What goes to the suffix arrays, and the spans from there with those of equal surroundings, without Spark."""
    keys = [("v", f"{i:03}", 0) for i in range(len(texts))]
    notes = pa.table({"vault": ["v"] * len(texts), "path": [k[1] for k in keys], "tie": pa.array([0] * len(texts), pa.int32()), "content": texts})
    found = pa.Table.from_batches(list(repeats._anchor_rows(length, gram)(iter(notes.to_batches()))))
    found = found.sort_by([(c, "ascending") for c in ("h", "ch", "path", "begin")]).combine_chunks()
    marked = pa.Table.from_batches(list(repeats._marked(512)(iter(found.to_batches())))).to_pylist()
    rows = [
        (m["h"], m["vault"], m["path"], m["tie"], m["begin"], texts[int(m["path"])].encode()[m["begin"] : m["end"]])
        for m in marked if m["kind"] == 1
    ]
    rows = [{"kind": 1, "h": h, "vault": v, "path": p, "tie": t, "begin": b, "end": b + len(a), "around": a} for h, v, p, t, b, a in sorted(rows)]
    spans = [s for out in repeats._sorted_spans(length, gram)(iter(pa.Table.from_pylist(rows).to_batches() if rows else [])) for s in out.to_pylist()]
    return rows, [(s["path"], s["begin"], s["end"]) for s in [m for m in marked if m["kind"] == 0] + spans]


@pytest.mark.parametrize("seed", range(12))
def test_surroundings_cut_where_they_differ_lose_nothing(seed):
    draw = np.random.default_rng(seed)
    length, gram = 12, 4
    letters = list("abcd"[: 1 + seed % 4])
    passage = ["".join(draw.choice(letters, 30)) for _ in range(4)]
    texts = []
    for _ in range(12):
        parts = [passage[k] if draw.random() < 0.7 else "".join(draw.choice(letters, 7)) for k in draw.integers(0, 4, 4)]
        texts.append("".join(parts)[int(draw.integers(0, 9)) :])
    seen, expected = set(), set()
    for i, text in enumerate(texts):
        for k in range(len(text) - length + 1):
            if text[k : k + length] in seen:
                expected |= {(f"{i:03}", x) for x in range(k, k + length)}
            seen.add(text[k : k + length])
    _, spans = _stretches(texts, length, gram)
    assert {(path, x) for path, begin, end in spans for x in range(begin, end)} == expected


def test_suffix_arrays_get_what_surroundings_share(monkeypatch):
    draw = np.random.default_rng(5)
    passage = "".join(draw.choice(list("abcdefgh"), 110))
    texts = ["".join(draw.choice(list("abcdefgh"), 300)) + passage + "".join(draw.choice(list("abcdefgh"), 300)) for _ in range(20)]
    sorted_ = []
    suffix_array = repeats.suffix_array
    monkeypatch.setattr(repeats, "suffix_array", lambda text, depth, wanted: sorted_.append(int(wanted.sum())) or suffix_array(text, depth, wanted))
    rows, spans = _stretches(texts, 100, 32)
    assert len({path for path, _, _ in spans}) == 19
    assert 0 < sum(sorted_) < sum(len(r["around"]) - 99 for r in rows) / 2


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_later_windows_in_any_batches(size):
    draw = np.random.default_rng(size)
    rows = sorted((*map(int, draw.integers(0, 4, 2)), "v", f"{draw.integers(0, 3)}", 0, int(draw.integers(0, 3))) for _ in range(300))
    names = [f.split()[0] for f in repeats.WINDOWS.split(", ")]
    table = pa.table([list(c) for c in zip(*rows, strict=True)], names=names)
    first, expected = {}, []
    for row in rows:
        if first.setdefault(row[:2], row[2:]) != row[2:]:
            expected.append((*row[2:], row[5] + 9))
    found = [tuple(r.values()) for out in repeats._later(9)(iter(table.to_batches(size))) for r in out.to_pylist()]
    assert found == expected


def test_windows_in_arrays(monkeypatch):
    """Equal windows have equal hashes, others differ; no row is made by itself."""
    draw = np.random.default_rng(3)
    around = [bytes(draw.integers(97, 100, n).astype(np.uint8)) for n in (5, 9, 10, 40, 200)]
    names = [f.split()[0] for f in repeats.FOUND.split(", ")]
    n = len(around)
    columns = [[2] * n, [1] * n, ["v"] * n, [f"{i}" for i in range(n)], [0] * n, [7 * i for i in range(n)], [0] * n, around]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    seen = set()
    monkeypatch.setattr(repeats, "_batch", None)  # made rows from tuples before
    rows = [r for out in repeats._windows(9)(iter([batch])) for r in out.to_pylist()]
    for r in rows:
        i = int(r["path"])
        seen.add((r["w1"], r["w2"], around[i][r["begin"] - 7 * i :][:9]))
    expected = {a[k : k + 9] for a in around for k in range(len(a) - 8)}
    assert len(rows) == sum(max(0, len(a) - 8) for a in around)
    assert len(seen) == len(expected) == len({s[0] for s in seen}) == len({s[1] for s in seen})
