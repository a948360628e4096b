"""Piece ids: the streaming search finds the best cut, and texts come back."""

import random

import numpy as np
import pytest

from notelake.llm import pieces, queries


@pytest.fixture(scope="module")
def model():
    return pieces.load(queries.tokenizer_file("piece_bpe_32k.model"))


def brute(model, text):
    """The best sum of scores over all cuts, by a full table over the whole text."""
    text = " " + text
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + model.byte_cost * len(text[end - 1].encode())
        for start in range(max(0, end - model.longest), end):
            part = text[start:end]
            piece = None if pieces.SPACE in part else model.pieces.get(part.replace(" ", pieces.SPACE))
            if piece:
                best[end] = max(best[end], best[start] + piece[1])
    return best[-1]


def score(model, ids):
    of = {i: s for i, s in model.pieces.values()}
    return sum(of.get(int(i), model.byte_cost) for i in ids)


TEXTS = [
    "", "a", " ", "  two  blanks ", "line\nend\n\n", "Ünïcödé straße", "▁literal▁ mark", "日本語テキスト", "😀 emoji 😀", "x" * 300,
    "nospacesatallinthisverylongstringofletters" * 30, "tab\tand\x00null", "the quick brown fox " * 50, "\n", "▁", "<s> </s> <0x41>",
]


def test_best_cut_and_round_trip(model):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aeiou strnlé ▁\n日") for _ in range(rng.randrange(200))) for _ in range(100)]
    ids, counts = model.encode_batch(texts)
    assert model.decode(ids, counts) == texts
    at = np.cumsum([0, *counts])
    for k, text in enumerate(texts):
        if text:
            assert score(model, ids[at[k] : at[k + 1]]) == pytest.approx(brute(model, text), rel=1e-12), text


def test_parts_and_commits_don_t_matter(model):
    rng = random.Random(2)
    for text in TEXTS:
        whole = list(model.stream(iter([" " + text]))) if text else []
        cut, rest = [], " " + text
        while rest:
            n = rng.randrange(1, 9)
            cut.append(rest[:n])
            rest = rest[n:]
        if text:
            assert list(model.stream(iter(cut))) == whole
            assert score(model, whole) == pytest.approx(brute(model, text), rel=1e-12)


def test_lanes_equal_the_stream_around_their_longest(model):
    rng = random.Random(3)
    segments = [" " + "".join(rng.choice("aeiourstnlé▁日😀") for _ in range(n - 1)) for n in range(30, 51) for _ in range(8)]
    assert min(map(len, segments)) < pieces.LANE < max(map(len, segments))
    for text, ids in zip(segments, model._lanes(segments), strict=True):
        assert ids.tolist() == list(model.stream(iter([text]))), text


def test_segments_share_the_steps_of_the_search(model, monkeypatch):
    rng = random.Random(5)
    segments = [" " + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 39))) for _ in range(3000)]
    calls, step = [], model._steps
    monkeypatch.setattr(model, "_steps", lambda nodes, letters: (calls.append(len(nodes)), step(nodes, letters))[1])
    model._lanes(segments)
    # One call per length of a piece, whatever the segments; a place is given up where no piece goes on.
    assert len(calls) <= model.longest and sum(calls) < 6 * sum(map(len, segments))


def test_what_is_remembered_is_bounded_and_changes_nothing(model, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(30))) for _ in range(40)]
    want = [a.tolist() for a in model.encode_batch(texts)]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "LANES", 20)
    model.remembered = {}
    for _ in range(3):
        got = [model.encode_batch([t]) for t in texts]
        assert [[i for ids, _ in got for i in ids.tolist()], [int(n) for _, ns in got for n in ns]] == want
        assert len(model.remembered) <= 50


def test_ids_are_given_out_before_the_end(model):
    seen = 0

    def letters():
        nonlocal seen
        for letter in " some words that go on" * 2000:
            seen += 1
            yield letter

    stream = model.stream(letters())
    next(stream)
    assert seen < 10 * model.longest


def test_table(spark, make_notes):
    from pyspark.sql import functions as F

    file = queries.tokenizer_file("piece_bpe_32k.model")
    rows = [("v", str(k), t) for k, t in enumerate(TEXTS)] + [("v", "n", None), (None, None, "x"), ("v", "0", "")]
    encoded = pieces.encode_notes(make_notes(rows).withColumn("ids", F.lit("clash")), file)
    got = sorted((r.vault, r.path, r.content, len(r.ids) == 0) for r in pieces.decode_notes(encoded, file).collect())
    assert got == sorted((v or "", p or "", t or "", not t) for v, p, t in rows)
    none = spark.createDataFrame([("v", "a", None)], "vault string, path string, ids array<int>")
    assert pieces.decode_notes(none, file).first().content == ""
    assert pieces.encode_notes(make_notes(rows).limit(0), file).collect() == []
