"""Jaccard groups and components against brute force."""

import random
import re

import numpy as np
import pytest

from notelake.llm import jaccard, shingles
from notelake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """{(vault, path, text): (n, component key)} with every pair compared."""
    sets = [shingle_set(t) for _, _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    key = {}
    for i, (v, p, _) in enumerate(rows):
        key[top(i)] = min(key.get(top(i), (v or "", p or "")), (v or "", p or ""))
    return sorted((v or "", p or "", len(sets[i]), *key[top(i)]) for i, (v, p, _) in enumerate(rows))


def run(notes):
    return sorted(
        (r.vault, r.path, r.n_shingles, r.component_vault, r.component_path) for r in jaccard.jaccard_components(notes).collect()
    )


def varied(seed, groups, sizes):
    """Groups of texts a few words apart, of all sizes, some with a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice((1, 1, 2, 5))):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 2, 3, 6))):
                at = rng.randrange(len(copy) + 1)
                if rng.random() < 0.5:
                    copy[at:at] = [f"x{rng.randrange(50)}"]
                elif copy:
                    copy.pop(min(at, len(copy) - 1))
            if g % 3 == 0:
                copy = copy[:20] + passage + copy[20:]
            rows.append(("v", f"{rng.randrange(10**6):06d}-{len(rows)}.md", rng.choice((" ", "\n", "\t ")).join(copy)))
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, (3, 5, 6, 8, 9, 12, 15)), (2, (20, 40, 70)), (3, (120, 300, 500))])
def test_same_as_all_pairs(spark, make_notes, seed, sizes):
    rows = varied(seed, 60, sizes)
    assert run(make_notes(rows)) == brute(rows)


def test_crowded_buckets_go_by_blocks(spark, make_notes, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = varied(5, 50, (20, 30))
    assert run(make_notes(rows)) == brute(rows)


def test_nulls_repeats_and_extra_columns(spark, make_notes):
    from pyspark.sql import functions as F

    text = "one two three four five six seven"
    rows = [("v", "a", None), ("v", "b", ""), ("v", "c", " \n"), ("v", "d", text), ("v", "d", text), (None, None, text.upper()), ("v", "e", "one two")]
    notes = make_notes(rows).withColumns({"fp": F.lit(1), "root": F.lit("x"), "n": F.lit(2)})
    assert run(notes) == brute(rows)
    assert run(make_notes([("v", "a", "b")]).limit(0)) == []


def test_a_chain_is_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000} or got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_every_pair_within_the_budget_shares_a_signature():
    """The pigeonhole itself: any two sets within the budget meet in a chosen segment, or one is marked hard."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 80, 130, 400]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        drop = rng.permutation(len(b))[: int(len(b) * 0.12)]
        b = np.unique(np.concatenate([np.delete(b, drop), rng.integers(0, 2**63, int(len(b) * 0.1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 4 * both < 3 * (len(a) + len(b) - both):
            continue
        lanes = jaccard.Lanes(shingles.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        sigs = [set(), set()]
        for lane, sig in [*zip(lanes.exact_lane, lanes.exact_sig), *zip(lanes.less_lane, lanes.less_sig)]:
            sigs[lanes.row[lane]].add(int(sig))
        assert sigs[0] & sigs[1] or lanes.hard.any(), n


def test_sets_are_made_of_small_parts():
    import pyarrow as pa

    texts = [" ".join(f"w{k}x{i}" for i in range(4000)) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(["v"] * 30), pa.array([f"{k:02d}" for k in range(30)]), pa.array(texts)], names=["vault", "path", "content"])
    marked = list(jaccard._mark(iter([batch])))
    size = max(map(len, texts))
    assert all(b.num_rows * size < 300_000 for b in marked)
    assert [p for b in marked for p in b.column(1).to_pylist()] == [f"{k:02d}" for k in range(30)]


def test_sets_need_little_at_once(monkeypatch):
    """A part's arrays stay small enough for a core's cache, and no set is made by a hash table of its own."""
    import pyarrow as pa

    draw = np.random.default_rng(4)
    column = pa.array([" ".join(f"w{k}" for k in draw.integers(0, 3_000, 200)) for _ in range(600)])
    batch = pa.RecordBatch.from_arrays([column] * 3, names=["vault", "path", "content"])
    sizes, made, unique = [], jaccard.shingle_sets, np.unique
    monkeypatch.setattr(jaccard, "shingle_sets", lambda flat, at: sizes.append(len(flat)) or made(flat, at))
    calls = []
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    assert sum(r.num_rows for r in jaccard._mark(iter([batch]))) == 600
    assert max(sizes) <= 1 << 17
    assert not calls


def test_buckets_need_the_order_of_signatures_only(monkeypatch):
    """Rows of a bucket may come in any order and in many batches; copies go out once, with one pivot."""
    import pyarrow as pa

    draw = np.random.default_rng(6)
    for size, fps in ((1, 3), (2, 3), (7, 2), (50, 40), (400, 3)):
        sig = np.sort(np.concatenate([draw.integers(-30, 30, 200), np.full(150, 4), draw.integers(100, 10**9, 200)]))
        fp, kind = draw.integers(-fps, fps, len(sig)), draw.integers(0, 4, len(sig)).astype(np.int8)
        table = pa.table({"sig": sig, "fp": fp, "kind": kind})
        want = {}
        for row in zip(sig.tolist(), fp.tolist(), kind.tolist(), strict=True):
            want.setdefault(row[0], set()).add(row)
        want = {s: rows for s, rows in want.items() if len({r[1] for r in rows}) > 1}
        got = [tuple(r.values()) for b in jaccard._shared(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert sorted(r[:3] for r in got) == sorted(r for rows in want.values() for r in rows)
        pivots = {}
        for s, _, _, pivot in got:
            pivots.setdefault(s, set()).add(pivot)
        assert all(len(p) == 1 and p <= {r[1] for r in want[s]} for s, p in pivots.items())


def test_a_word_has_one_hash_wherever_it_stands():
    text = b"alpha beta  gamma\nalpha " * 30 + b"x" * 300_000 + b" alpha"
    hashes, owner = shingles.words(np.frombuffer(text, dtype=np.uint8), np.array([0, 7, len(text)]))
    words = [w for part in (text[:7], text[7:]) for w in re.findall(rb"[^\x20\x09-\x0D]+", part)]
    assert len(hashes) == len(words) and owner.tolist() == [0, 0] + [1] * (len(words) - 2)
    by = {}
    for word, value in zip(words, hashes.tolist(), strict=True):
        by.setdefault(word, set()).add(value)
    assert all(len(v) == 1 for v in by.values()) and len({v for s in by.values() for v in s}) == len(by)
