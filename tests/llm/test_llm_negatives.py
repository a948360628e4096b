"""Hard-negative mining against a plain loop over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import hard_negatives as hn

SCHEMA = "id long, embedding array<double>, label int, vector string, key int"


def brute(rows, is_anchor, positives=5, negatives=5):
    kept = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        quantized = [max(min(math.floor(256 * x), (1 << 63) - 1), -(1 << 63)) for x in vector]
        kept[i] = min(kept.get(i, (label, quantized)), (label, quantized))

    def score(a, b):
        return max(min(sum(x * y for x, y in zip(a, b, strict=False)), (1 << 63) - 1), -(1 << 63))

    out = []
    for a, (label, vector) in kept.items():
        if not is_anchor(a):
            continue
        ranked = sorted((-score(vector, v), i, own) for i, (own, v) in kept.items() if i != a)
        for best, p, _ in [r for r in ranked if r[2] == label][:positives]:
            near = [(s, i) for s, i, own in ranked if own != label and -80 * best <= -100 * s <= -100 * best]
            out += [(a, p, k, i, -best, -s) for k, (s, i) in enumerate(near[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    df = spark.createDataFrame([(i, v, label, "x", 3) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, hn.mine_hard_negatives(df, anchor, **more).collect()))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    # A third of the rows have one label; coarse components make many ties.
    return [(i, (np.round((centres[i % 6] + draw.normal(size=8)) * 8) / 8).tolist(), 0 if i % 3 == 0 else i % 7) for i in range(-300, 700)]


def test_against_all_pairs(spark, rows):
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 1000
    assert mined(spark, rows, F.col("id") % 10 == 0) == want


def test_blocks_and_small_shards_change_nothing(spark, rows, monkeypatch):
    want = brute(rows, lambda i: i % 10 == 0)
    monkeypatch.setattr(hn, "ROWS", 7)
    monkeypatch.setattr(hn, "COLUMNS", 3)
    assert mined(spark, rows, F.col("id") % 10 == 0, block=200) == want


def test_ties_are_broken_by_id(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(40)]
    assert mined(spark, rows, F.col("id") == 20) == brute(rows, lambda i: i == 20)


def test_odd_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0] * 8, 1), (1000, None, 1), (1010, [1.0] * 8, None), (1020, [1.0, None], 1), (1030, [nan] * 8, 1),
        (1040, [inf] * 8, 1), (1050, [], 1), (1060, [2.0], 1), (1070, [-1e300] * 8, 0), (1080, [1e18] * 8, 1), (1090, [9e5] * 8, 1),
        (1100, [3.0] * 20, 2), *rows[::9], *rows[::27], (0, [9.0] * 8, 5), (0, [9.0] * 8, 1),
    ]
    assert mined(spark, odd, F.col("id") % 10 == 0) == brute(odd, lambda i: i % 10 == 0)


def test_nothing_to_do(spark, rows):
    assert mined(spark, [], F.col("id") % 10 == 0) == []
    assert mined(spark, rows, F.lit(False)) == []
    assert mined(spark, [(i, [1.0], i) for i in range(9)], F.lit(True)) == []


def test_key_order():
    ids = np.array([5, -5, 5, 5, 5, 5])
    keys = hn.pack(np.array([1, 1, 1, 1, -1, 1]), np.array([3, 3, -9, 3, 0, 2**62]), np.array([1, 0, 0, 0, 1, 1]), ids)
    order = sorted(range(6), key=lambda i: keys[i].tobytes())
    assert order == [4, 5, 1, 3, 0, 2]
    back = hn.unpack(keys.tobytes())
    assert back[0].tolist() == [1, 1, 1, 1, -1, 1] and back[1].tolist() == [3, 3, -9, 3, 0, 2**62] and back[3].tolist() == ids.tolist()
