"""Leaks: the lemma loses nothing, alignment equals a plain table, clean notes stay clean."""

import random

from notelake.llm import leaks


def plain(passage, region):
    """Least edits of the passage against any stretch of the region."""
    row = [0] * (len(region) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(region, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, what = rng.randrange(len(out)), rng.randrange(3)
        if what == 0:
            out[at] = rng.choice("abcdefgh")
        elif what == 1:
            out.insert(at, rng.choice("abcdefgh"))
        else:
            out.pop(at)
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_alignment_equals_a_plain_table():
    rng = random.Random(2)
    for _ in range(200):
        passage = prose(rng, 6)
        k = rng.randrange(0, 5)
        region = edited(rng, passage, rng.randrange(0, 7))
        region = prose(rng, 1)[:k] + region + prose(rng, 1)[:k]
        region = region[: len(passage) + 2 * k + 4]
        want, got = plain(passage, region), leaks.align(passage, region, k)
        # The band starts within k of the region's start plus its spare length.
        if got is None:
            assert want > k or len(region) < len(passage) - k
        else:
            assert got[0] == want <= k
            assert plain(passage, region[got[1] : got[2]]) == want


def test_edited_passages_are_found():
    rng = random.Random(3)
    for n in (6, 14, 40):
        item = prose(rng, n)
        index = leaks.Index([("b", "i", item)])
        for passage in index.passages:
            for _ in range(30):
                near = edited(rng, passage.text, passage.edits)
                text = leaks.folded(prose(rng, 50) + " " + near + " " + prose(rng, 50))
                found = index.find(text)
                assert found and found[0][0] == 0, (n, passage, near)
        assert index.find(prose(rng, 500)) == []
        assert leaks._touched(index, [prose(rng, 300), "x " + leaks.folded(item), ""]) == [1]


def test_table(spark, make_notes):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    item, other = prose(rng, 40), prose(rng, 40)
    reserved = make_notes([("b", "1", item), ("b", "2", other), ("b", "3", ""), ("b", "4", None), ("b", "5", "short"), ("b", "1", item)])
    rows = [
        ("v", "whole", "Intro. " + item.upper().replace(" ", "\n") + " end"), ("v", "part", item[30:150]), ("v", "clean", prose(rng, 400)),
        ("v", "both", other + " " + item), ("v", "both", other + " " + item), ("v", "none", None), ("v", "empty", ""),
        (None, None, item), ("v", "long", prose(rng, 60_000) + item),
    ]
    got = leaks.find_leaks(make_notes(rows).withColumn("found", F.lit(9)), reserved).collect()
    assert sorted((r.vault, r.path, r.reserved_path) for r in got) == sorted(
        [("v", "whole", "1"), ("v", "part", "1"), ("", "", "1"), ("v", "long", "1")] + 2 * [("v", "both", "1"), ("v", "both", "2")]
    )
    assert {r.coverage for r in got if r.path != "part"} == {1.0}
    # Blocks of reserved text change nothing.
    again = leaks.find_leaks(make_notes(rows), reserved, block=100).collect()
    assert sorted(again) == sorted(got)
    assert leaks.find_leaks(make_notes(rows), reserved.limit(0)).collect() == []
    assert leaks.find_leaks(make_notes(rows).limit(0), reserved).collect() == []


def test_passages_at_every_offset_are_found(spark, make_notes):
    rng = random.Random(5)
    item = leaks.folded(prose(rng, 40))
    index, n = leaks.Index([("b", "i", item)]), len(item)
    before, after = leaks.folded(prose(rng, 30)).upper(), leaks.folded(prose(rng, 30)).upper()
    for long in (96, 110, 130):
        for at in range(n - long + 1):
            text = before + item[at : at + long] + after
            got = index.find(text)
            assert len(got) == 1 and got[0][0] == 0 and got[0][5] >= long / n, (long, at)
    for at in range(n - 96 + 1):
        assert index.find(before + edited(rng, item[at : at + 96], 4) + after), at
    # Too little of the item, or too much changed.
    assert all(index.find(before + item[at : at + 88] + after) == [] for at in range(n - 88 + 1))
    reserved = make_notes([("b", "1", item), ("b", "2", "Who was Ada\nLovelace?"), ("b", "3", "")])
    rows = [("v", f"{at:03}", before + item[at : at + 96] + after) for at in range(n - 96 + 1)]
    rows += [("v", "short", "Q: who was ada  lovelace? A: a"), ("v", "other", "who was ada"), ("v", "empty", "")]
    got = sorted((r.path, r.reserved_path) for r in leaks.find_leaks(make_notes(rows), reserved).collect())
    assert got == [(p, "1") for _, p, _ in rows[:-3]] + [("short", "2")]


def test_found_passages_equal_a_plain_table():
    rng = random.Random(6)
    for n in (3, 5, 18, 24):
        item = leaks.folded(prose(rng, n))
        index = leaks.Index([("b", "i", item)])
        for edits in (0, 3, 6, 9):
            text = leaks.folded(prose(rng, 4) + " " + edited(rng, item, edits) + " " + prose(rng, 4))
            all_ = leaks.passages(0, item)
            assert len(all_) == max(1, len(item) - 95) == index.count[0]
            want = [d for d in (plain(p.text, text) for p in all_) if d <= all_[0].edits]
            got = index.find(text)
            assert ([(g[1], g[4]) for g in got] == [(len(want), max(want))]) if want else got == [], (n, edits)


def test_a_run_of_one_letter_is_looked_at_in_parts(monkeypatch):
    monkeypatch.setattr(leaks, "POSTS", 1000)
    index = leaks.Index([("b", "i", "a" * 150), ("b", "j", "b" * 120 + "c" * 40)])
    assert index.find("x" * 50 + "a" * 3000)[0][:4] == (0, 55, 50, 50 + 96 + 0)
    assert [g[:2] for g in index.find("b" * 700 + "c" * 40 + "d" * 700)] == [(1, 65)]
