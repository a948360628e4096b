"""Exact duplicates: fingerprints compose, clashes are split, results equal brute force."""

import hashlib
import random
import re

from notelake.llm import exact

SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_fingerprints_compose():
    rng = random.Random(1)
    for size in (0, 1, 5, 4095, exact.CHUNK + 3, 2 * exact.CHUNK):
        text = rng.randbytes(size)
        for base in exact.BASES:
            plain = 0
            for byte in text[:5000]:
                plain = (plain * base + byte + 1) % exact.PRIME
            assert exact.fingerprint(text[:5000], base) == plain
            cut = rng.randrange(size + 1)
            parts = [exact.fingerprint(p, base, 1000) for p in (text[:cut], text[cut:])]
            assert exact.combine(*parts, size - cut, base) == exact.fingerprint(text, base)


def brute(rows):
    groups = {}
    for i, (v, p, t) in enumerate(rows):
        norm = SPACE.sub("", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), v or "", p or "", i))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((m[1], m[2], keep[1], keep[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


ROWS = [
    ("v", "a", "x y"), ("v", "b", "xy"), ("v", "c", "x  y\n"), ("v", "d", " xy"), ("v", "e", None), ("v", "f", ""), ("v", "g", " \t"),
    ("v", "h", "long " * 40_000), ("w", "h", "long" * 40_000), ("v", "i", "äö"), ("v", "i", "äö"), (None, None, "x y"),
]


def check(df, rows):
    got = df.collect()
    assert sorted((r.vault, r.path, r.keep_vault, r.keep_path, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all((r.vault, r.path) == (r.keep_vault, r.keep_path) for r in got if r.kept)


def test_groups(spark, make_notes):
    from pyspark.sql import functions as F

    check(exact.exact_duplicates(make_notes(ROWS).withColumns({"f1": F.lit(0), "kept": F.lit(1)})), ROWS)
    assert exact.exact_duplicates(make_notes(ROWS).limit(0)).collect() == []


def test_clashing_fingerprints_are_told_apart(spark, make_notes, monkeypatch):
    """With bases of zero only the last byte of a chunk counts, so unlike texts clash."""
    rows = [("v", str(i), t) for i, t in enumerate(("abc", "xbc", "a bc", "bbc", "zzc", "abd"))]
    marks = exact._mark

    def weak(batches):
        for batch in marks(batches):
            at = batch.schema.get_field_index("f1")
            zero = exact.pa.array([0] * batch.num_rows, exact.pa.int64())
            batch = batch.set_column(at, "f1", zero)
            yield batch.set_column(at + 1, "f2", zero)

    def chunks(shared):
        def run(batches):
            for batch in batches:
                texts = [exact.normalized((t or "").encode()) for t in batch.column(2).to_pylist()]
                flat = [(0, 0, len(t), 0, t) for t in texts]
                yield exact.pa.RecordBatch.from_arrays(
                    [exact.pa.array([f[i] for f in flat], exact.pa.int64()) for i in range(4)] + [exact.pa.array([f[4] for f in flat], exact.pa.binary())],
                    names=["f1", "f2", "n_bytes", "k", "chunk"],
                )

        return run

    monkeypatch.setattr(exact, "_mark", weak)
    monkeypatch.setattr(exact, "_chunks", chunks)
    check(exact.exact_duplicates(make_notes(rows)), rows)
