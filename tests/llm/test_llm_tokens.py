"""Token files: exact round trips, damaged blocks, digests equal to plain encoding."""

import random
import zlib

import numpy as np
import pytest

from notelake.llm import coder, coder_jvm, queries, tokens


@pytest.fixture(scope="module")
def file():
    return queries.tokenizer_file("byte_bpe_50k.json")


def blocks(seed):
    rng = np.random.default_rng(seed)
    yield np.zeros(0, dtype=np.uint32)
    yield np.zeros(500, dtype=np.uint32)
    yield np.full(3, 50_256, dtype=np.uint32)
    yield rng.integers(0, 50_257, 700).astype(np.uint32)
    yield np.tile(rng.integers(0, 50_257, 9), 80).astype(np.uint32)
    yield (rng.zipf(1.3, 900) % 50_257).astype(np.uint32)
    for n in rng.integers(1, 40, 30):
        yield rng.integers(0, 300, n).astype(np.uint32)


@pytest.mark.parametrize("bits", [16, 20])
def test_blocks_round_trip(bits):
    made = list(blocks(3))
    payloads = coder.encode_blocks(made, bits)
    for got, want in zip(coder.decode_blocks(payloads, [len(b) for b in made], bits), made, strict=True):
        assert got.tolist() == want.tolist()
    # Blocks are independent: each decodes by itself, in any company.
    for k in (2, 3, 5):
        assert coder.encode_blocks([made[k]], bits)[0] == payloads[k]
        assert coder.decode_blocks([payloads[k]], [len(made[k])], bits)[0].tolist() == made[k].tolist()


def test_predictions_shrink_what_repeats():
    rng = np.random.default_rng(1)
    repeated, plain = np.tile(rng.integers(0, 50_257, 50), 80), rng.integers(0, 50_257, 4000)
    sizes = [len(p) for p in coder.encode_blocks([repeated.astype(np.uint32), plain.astype(np.uint32)], 16)]
    assert sizes[0] < 900 and sizes[1] < 2 * 4000 * 1.1


def test_crc_combine():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(5000))
        assert tokens.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


TEXTS = [
    "", "plain words here", "  two  blanks \n\nlines\n ", "tab\there\t\n x", "it's we'll I'd don't", "naïve ünïcode ß 日本語 😀", "end <|endoftext|> inside",
    "a b c\x85d\x1ce", "1234 56,78 --- !!", "\r\nwindows\r\n", "x" * 3000, "\x00", "   ", "word " * 9000,
]


def test_pieces_have_the_ids_of_the_whole(file):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab 'sll\n\t .1é  ") for _ in range(rng.randrange(80))) for _ in range(500)]
    plain = Tokenizer.from_file(file)
    got = tokens.load(file).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_files(spark, make_notes, file, tmp_path):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rows = [("v", f"{k:03d}", t) for k, t in enumerate(TEXTS * 3)] + [("v", "n", None), ("v", "n", None), (None, None, "x")]
    folder = str(tmp_path / "files")
    notes = make_notes(rows).withColumns({"shard": F.lit("s"), "n": F.lit(1)}).repartition(3)
    tokens.write_tokens(notes, folder, file, block=256)
    plain, start, want = Tokenizer.from_file(file), 0, []
    for v, p, t in sorted((v or "", p or "", t or "") for v, p, t in rows):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        want.append((v, p, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((r.vault, r.path, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digests(spark, folder, block=256).collect())
    assert got == sorted(want)
    stored = spark.read.parquet(folder)
    assert stored.where("n_tokens > 256").count() == 0
    broken = stored.withColumn("payload", F.when(F.col("n_tokens") > 100, F.concat(F.lit(b"\x07\x07\x07"), "payload")).otherwise(F.col("payload")))
    broken.write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="is damaged"):
        tokens.read_tokens(spark, str(tmp_path / "broken")).collect()
    tokens.write_tokens(make_notes(rows).limit(0), str(tmp_path / "none"), file)
    assert tokens.token_digests(spark, str(tmp_path / "none")).collect() == []


def test_coding_holds_little_per_block():
    import tracemalloc

    rng = np.random.default_rng(7)
    made = [rng.integers(0, 50_257, tokens.BLOCK).astype(np.uint32) for _ in range(64)]
    tracemalloc.start()
    payloads = coder.encode_blocks(made, 16)
    written = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    coder.decode_blocks(payloads, [len(b) for b in made], 16)
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(written, read) < 64 * 125_000


def test_ids_that_don_t_shrink_find_room():
    made = [np.random.default_rng(8).integers(0, 50_257, 12_000).astype(np.uint32)]
    payloads = coder.encode_blocks(made, 16)
    assert coder.decode_blocks(payloads, [12_000], 16)[0].tolist() == made[0].tolist()


def test_known_pieces_are_bounded(file, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    encoder = tokens.Encoder(file)
    for k in range(4):
        texts = [" ".join(f"w{k}x{i}" for i in range(40)), f"w{k}x1"]
        got = encoder.encode(texts)
        assert [ids.tolist() for ids in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 50


def jvm(spark, made, bits, payloads=None):
    """Payloads of blocks, or the given ones, and what they give back, both by the JVM."""
    from pyspark.sql import functions as F

    given = payloads or [b""] * len(made)
    rows = [(k, bytearray(b.astype("<u4").tobytes()), bytearray(p), len(b)) for k, (b, p) in enumerate(zip(made, given, strict=True))]
    df = spark.createDataFrame(rows, "k int, ids binary, payload binary, n bigint")
    if not payloads:
        df = df.withColumn("payload", coder_jvm.encoded(spark, F.col("ids"), F.lit(bits)))
    out = df.withColumn("back", coder_jvm.decoded(spark, F.col("payload"), F.col("n"), F.lit(bits))).orderBy("k").collect()
    return [bytes(r.payload) for r in out], [np.frombuffer(bytes(r.back), dtype="<u4") for r in out]


@pytest.mark.parametrize("bits", [16, 20])
def test_the_jvm_codes_alike(spark, bits):
    made = [*blocks(5), *blocks(6), np.random.default_rng(9).integers(0, 50_257, 70_000).astype(np.uint32)]
    want = coder.encode_blocks(made, bits)
    payloads, back = jvm(spark, made, bits)
    assert payloads == want
    for got, block in zip(back, made, strict=True):
        assert got.tolist() == block.tolist()
    # Broken payloads give the same wrong ids, which their checksum finds.
    broken = [p[: len(p) // 2] + bytes(b ^ 0xA5 for b in p[len(p) // 2 : -3]) for p in want[:40]]
    sizes = [len(b) for b in made[:40]]
    for got, ids in zip(jvm(spark, made[:40], bits, broken)[1], coder.decode_blocks(broken, sizes, bits), strict=True):
        assert got.tolist() == ids.tolist()


def test_an_id_costs_little(spark):
    import time

    rng = np.random.default_rng(3)
    made = [(rng.zipf(1.2, tokens.BLOCK) % 50_257).astype(np.uint32) for _ in range(600)]
    jvm(spark, made[:64], 16)
    start = time.perf_counter()
    _, back = jvm(spark, made, 16)
    # In arrays coding and decoding took some 8 microseconds an id.
    assert time.perf_counter() - start < 4e-6 * 600 * tokens.BLOCK
    assert all(np.array_equal(a, b) for a, b in zip(back, made, strict=True))


def test_quick_ids_are_the_same(file):
    encoder = tokens.Encoder(file)
    assert encoder.quick
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 !{c}! {c}" for c in signs[k : k + 2000]) for k in range(0, len(signs), 2000)]
    texts += ["".join(f"a {c}  {c}{c} \n{c}" for c in signs[k : k + 2000]) for k in range(0, len(signs), 2000)]
    rng = random.Random(5)
    texts += ["".join(rng.choice(["a", "B", "é", "1", "'s", "'LL", ".", " ", " ", "\n", "\t", "\x1f", "\xa0", "\u3000", "中"]) for _ in range(40)) for _ in range(3000)]
    for got, e in zip(encoder.encode(texts), encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids
    assert not encoder.known


def test_what_is_not_quick_is_right(file, monkeypatch, tmp_path):
    import json

    encoder = tokens.Encoder(file)
    long = ["a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "x <|endoftext|>  y", "\u3000" * 150_000 + "1"]
    for text, ids in zip(long, encoder.encode(long), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(encoder, "quick", None)
    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    with open(file, encoding="utf-8") as given:
        made = json.load(given)
    made["model"]["merges"][5], made["model"]["merges"][9] = made["model"]["merges"][9], made["model"]["merges"][5]
    (tmp_path / "other.json").write_text(json.dumps(made))
    other = tokens.Encoder(str(tmp_path / "other.json"))
    assert other.quick is None
    for text, ids in zip(TEXTS, other.encode(TEXTS), strict=True):
        assert ids.tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


def test_sums_of_many_parts():
    rng = random.Random(2)
    parts = [rng.randbytes(rng.randrange(1, 9000)) for _ in range(60)]
    after = [sum(map(len, parts[k + 1 :])) for k in range(60)]
    shifted = tokens.crc_shift(np.array([zlib.crc32(p) for p in parts]), np.array(after))
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(b"".join(parts))
