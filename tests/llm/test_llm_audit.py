"""Filter audit against a plain count over all orders."""

import re
from itertools import permutations

import numpy as np
import pytest

from notelake.llm import filter_audit


def failing(notes):
    """(part, set of failed filters, note) of each (vault, path, part, text)."""
    out = []
    for vault, path, part, text in notes:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if any((v or "", p or "") < (vault or "", path or "") and (t or "") == text for v, p, _, t in notes):
            fails.add("E")
        out.append((part or "", fails, (vault or "", path or "")))
    return out


def brute(notes, good=(), toxic=()):
    out = {}
    judged = failing(notes)
    for part in {p for p, _, _ in judged}:
        mine = [(f, k) for p, f, k in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                lost = [k for f, k in mine if name in f and not f & before]
                shapley[name] += len(lost)
                out[part, order, step] = (
                    sum(not f & (before | {name}) for f, _ in mine),
                    len(lost),
                    sum(name in f and bool(f & before) for f, _ in mine),
                    sum(f == {name} for f, _ in mine),
                    sum(k in good for k in lost),
                    sum(k in toxic for k in lost),
                )
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[key[1][key[2] - 1]],)
    return out


def texts():
    draw = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)] + ["Über", "ÄRGER", "LOUD", "p%x", "a&b"]
    made = ["", None, " \n\t", "short", "SHORT", "x" * 30]
    for size in (50, 99, 100, 101, 120, 300):
        for pool in (400, 405, 60, 3):
            made.append(" ".join(draw.choice(words[-pool:] if pool == 405 else words[:pool], size)))
    made.append(" ".join(f"k{i}" for i in range(120)))  # one word: other spaces do not count
    made.append(("tail " * 40 + "UP ") * 50)
    return made


@pytest.fixture(scope="module")
def notes(spark):
    rows = []
    for i, text in enumerate(texts() * 2):
        rows.append(("abc"[i % 3], f"n{i:03d}.md", "abc"[i % 3], text))
    rows += [(None, "x.md", None, "short"), ("a", None, "", None), ("a", "n000.md", "a", "")]
    return rows


def frames(spark, notes, good=(), toxic=()):
    df = spark.createDataFrame(
        [(v, p, t, part, 1, 2) for v, p, part, t in notes],
        "vault string, path string, content string, part string, n long, fails long",
    )
    marks = [(v, p, (v, p) in good, (v, p) in toxic) for v, p in {*good, *toxic}]
    return df, spark.createDataFrame(marks, "vault string, path string, good boolean, toxic boolean")


def audited(df, marks, part="vault"):
    return {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit_filters(df, marks, part).collect()}


def test_every_order_of_the_filters(spark, notes):
    keys = [(v, p) for v, p, _, _ in notes if v and p]
    good, toxic = set(keys[::3]), set(keys[::4])
    got = audited(*frames(spark, notes, good, toxic), part="part")
    assert got == brute(notes, good, toxic)
    assert len(got) == 600 * len({part or "" for _, _, part, _ in notes})


def test_notes_are_judged_one_by_one(spark, notes):
    df, _ = frames(spark, notes)
    rows = {(r.vault, r.path, r.part, r.fails) for r in filter_audit.judge_notes(df, "part").collect()}
    bits = {name: 1 << i for i, name in enumerate("ABCDE")}
    assert rows == {(*key, part, sum(bits[f] for f in fails)) for part, fails, key in failing(notes)}


def test_empty_tables_and_repeated_marks(spark, notes):
    df, marks = frames(spark, notes[:6], {("a", "n000.md")})
    assert audited(df.limit(0), marks) == {}
    twice = marks.unionByName(spark.createDataFrame([("a", "n000.md", False, None), (None, None, True, True)], marks.schema))
    assert audited(df, twice) == audited(df, marks)


def test_a_long_text_is_cut_at_spaces(spark, monkeypatch):
    long = " ".join(f"word{i % 9000}" for i in range(40_000)) + " " + "z" * 5000 + " end"
    flat = np.frombuffer(long.encode(), dtype=np.uint8)
    monkeypatch.setattr(filter_audit, "SHARD", 1000)
    runs = list(filter_audit._runs(flat, np.array([0, len(flat)])))
    assert b"".join(bytes(part) for _, part, _ in runs) == long.encode() and max(len(p) for _, p, _ in runs) < 6001
    rows = _judged_here([("v", "a", "p", long), ("v", "b", "p", "one two"), ("v", "c", "p", long)])
    assert [(r["n_words"], r["n_distinct"]) for r in rows] == [(40_002, 9002), (2, 2), (40_002, 9002)]


def _judged_here(rows, shared=None):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("vault", "path", "part", "content"), r, strict=True)) for r in rows])
    return [r for b in filter_audit._judge(shared)(iter([batch])) for r in b.to_pylist()]


def test_words_that_share_a_code_are_told_apart(spark, monkeypatch):
    """With codes of four bits nearly all words share theirs with others."""
    plain = filter_audit.Words.codes
    monkeypatch.setattr(filter_audit.Words, "codes", lambda self, which=0: plain(self, which) % (16 if which == 0 else 1 << 60))
    full = np.full(filter_audit.common.BITMAP_BITS // 8, 255, dtype=np.uint8)
    rows = [("v", str(i), "p", t or "") for i, t in enumerate(texts())]
    want = [len(set(re.findall(r"[^\x20\x09-\x0D]+", t))) for *_, t in rows]
    assert [r["n_distinct"] for r in _judged_here(rows, full)] == want
    monkeypatch.setattr(filter_audit, "SHARD", 100)
    assert [r["n_distinct"] for r in _judged_here(rows, full)] == want
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"content": t} for *_, t in rows])
    pairs = {(r["code"], r["other"]) for b in filter_audit._dictionary_codes(iter([batch])) for r in b.to_pylist()}
    assert len(pairs) == len({w for *_, t in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t)})


def test_dictionary(spark, notes):
    df, _ = frames(spark, notes)
    found = filter_audit.dictionary(df).collect()
    words = {w for *_, t in notes for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    assert len(found) == len(words) and all(r.words == 1 for r in found)


def test_memory_stays_small():
    """What a task holds grows with a part of a batch, not with the batch."""
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"word{i % 700}" for i in range(1_000))
    column = pa.array([text] * 500)  # 4 MB
    batch = pa.RecordBatch.from_arrays([column, column, column, column], names=["vault", "path", "part", "content"])
    for task in (filter_audit._judge(None), filter_audit._dictionary_codes):
        for rows in task(iter([batch.slice(0, 200)])):
            assert rows.num_rows  # what is kept for later is made
        tracemalloc.start()
        for rows in task(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 28 << 20
