"""Token ids of notes in files of coded blocks, and back."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm import coder_jvm, common

if TYPE_CHECKING:
    from tiktoken import Encoding
    from tokenizers import Tokenizer

END = 2  # id after each note
BLOCK = 2048  # ids of a block
WAITING = 256  # blocks that a writer keeps before it gives them on
RUN = 100_000  # characters of white space in a row that the quick tokenizer need not bear
ENCODED = 10_000  # pieces of text encoded at once
CACHED = 200_000  # pieces of text whose ids a process remembers

_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")  # white space that might belong to the next piece
_BLANKS = re.compile(r"\s{2,}")
_TO_BLANKS = bytes.maketrans(b"\t\n\v\f\r\x1c\x1d\x1e\x1f", b" " * 9)
# How a byte-level tokenizer cuts texts; without white space in a row it need not look ahead, which takes twice as long.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
_CUTS = (_WORDS + r"|\s", _WORDS + r"|\s+(?!\S)|\s+")
_LOADED: dict[str, Encoder] = {}


def quick(file: str, tokenizer: Tokenizer) -> tuple[Encoding, Encoding] | None:
    """The same ids some five times as fast, where the tokenizer is a plain byte-level one, else None.

    The first of the two is for texts without white space in a row, the second for all.
    It merges any two neighbours whose bytes are a token, the least id first.  These are the merges of the file
    if they make tokens in the order of the ids, each token by one merge, and every token's own bytes give that token: up to
    the moment two neighbours cover a token's bytes, these have gone through the same merges as they do alone.
    """
    with open(file, encoding="utf-8") as given:
        made = json.load(given)
    model, cuts = made["model"], made.get("pre_tokenizer") or {}
    if any(made.get(k) for k in ("normalizer", "truncation", "padding")) or model.get("type") != "BPE":
        return None
    if cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space") or not cuts.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    added = {t["content"]: t["id"] for t in made.get("added_tokens") or []}
    vocab = {t: k for t, k in model["vocab"].items() if t not in added}
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    if not vocab.keys() >= signs.keys() >= set("".join(vocab)):
        return None
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip([-1, *merged], merged)) or len(merged) + 256 != len(vocab):
        return None
    if any(len(tokenizer.model.tokenize(t)) != 1 for t in vocab):
        return None
    from tiktoken import Encoding

    ranks = {bytes(map(signs.__getitem__, t)): k for t, k in vocab.items()}
    # Its arrays take a search for special tokens, which is slow without any; they are never allowed.
    special = added or {"<|none|>": len(vocab)}
    single, any_ = (Encoding("notes", pat_str=c, mergeable_ranks=ranks, special_tokens=special) for c in _CUTS)
    return single, any_


def _in_a_row(text: str) -> bool:
    """Whether two characters of white space follow each other; bytes show it faster where they are characters."""
    if text.isascii():
        return b"  " in text.encode().translate(_TO_BLANKS)
    return _BLANKS.search(text) is not None


class Encoder:
    """Ids of whole texts, by ``quick`` where that can be.

    In other texts equal pieces between blanks are encoded once.  A byte-level tokenizer cuts texts before a blank
    or line end that follows something else, so pieces cut there have the ids that they have in the text.  Texts with
    other white space, and those that hold a special token's string, are encoded as a whole.
    """

    def __init__(self, file: str):
        # A task has one core; threads of its own would each keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.cuts = kind == "ByteLevel" and self.tokenizer.normalizer is None
        self.quick = quick(file, self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros(0, dtype=np.uint32)
        self.begin, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after the other, and how many each has."""
        ids, counts = [np.zeros(0, dtype=np.uint32)], []
        for first in range(0, len(texts), ENCODED):
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts[first : first + ENCODED], add_special_tokens=False)]
            counts += map(len, made)
            ids.append(np.fromiter(chain.from_iterable(made), dtype=np.uint32))
        return np.concatenate(ids), np.array(counts, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        if self.quick:
            for i, t in enumerate(texts):
                runs = _in_a_row(t)
                # Longer runs of white space overflow its stack.
                if runs and len(t) >= RUN and any(m.end() - m.start() >= RUN for m in _BLANKS.finditer(t)):
                    continue
                if not any(s in t for s in self.special):
                    out[i] = self.quick[runs].encode_to_numpy(t, disallowed_special=())
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self._by_pieces([texts[i] for i in left]), strict=True):
            out[i] = ids
        return out

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cuts and not any(s in t for s in self.special) for t in texts]
        pieces = [_PIECE.findall(t) if c else [] for t, c in zip(texts, cut, strict=True)]
        flat = list(chain.from_iterable(pieces))
        distinct = dict.fromkeys(flat)
        odd = {p for p in distinct if _ODD.search(p)}
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > CACHED:
            self._forget()
            new = list(distinct)
        made, counts = self._whole(new)
        self.known.update(zip(new, range(len(self.begin), len(self.begin) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.table) + np.cumsum(counts) - counts])
        self.table, self.count = np.concatenate([self.table, made]), np.concatenate([self.count, counts])
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, c in enumerate(cut):
            if not c or (odd and any(p in odd for p in pieces[i])):
                out[i] = self._whole([texts[i]])[0]
        if flat:
            at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
            sizes = self.count[at]
            joined = self.table[common.ranges(self.begin[at], sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0] + [len(p) for p in pieces])]
        for i in range(len(texts)):
            if out[i] is None:
                out[i] = joined[ends[i] : ends[i + 1]] if pieces[i] else np.zeros(0, dtype=np.uint32)
        if len(self.known) > CACHED:
            self._forget()
        return out


def load(file: str) -> Encoder:
    """The tokenizer of a file, read once per process."""
    if file not in _LOADED:
        _LOADED[file] = Encoder(file)
    return _LOADED[file]


FILES = (
    "shard int, block bigint, bits int, n_tokens bigint, ids_crc32 bigint, payload binary, "
    "parts array<struct<vault:string,path:string,row:bigint,n:bigint>>"
)
_BLOCKS = FILES.replace("payload", "ids")
_PARTS = pa.list_(pa.struct([("vault", pa.string()), ("path", pa.string()), ("row", pa.int64()), ("n", pa.int64())]))


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


class _Writer:
    """Cuts the ids of notes in order into blocks of one shard."""

    def __init__(self, shard: int, bits: int, block: int):
        self.shard, self.bits, self.block = shard, bits, block
        self.rows = self.blocks = 0
        self.open: list[tuple[tuple, np.ndarray]] = []
        self.size = 0

    def add(self, vault: str, path: str, ids: np.ndarray) -> None:
        self.open.append(((vault, path, self.rows), ids))
        self.size += len(ids)
        self.rows += 1

    def flush(self, all_: bool) -> pa.RecordBatch:
        ids = np.concatenate([v for _, v in self.open]) if self.open else np.zeros(0, dtype=np.uint32)
        whole = len(ids) if all_ else len(ids) // self.block * self.block
        edges = list(range(0, whole, self.block))
        blocks = [ids[a : min(a + self.block, whole)] for a in edges]
        parts: list[list[dict]] = [[] for _ in blocks]
        place, rest = 0, []
        for (vault, path, row), value in self.open:
            end = place + len(value)
            for k in range(place // self.block, -(-min(end, whole) // self.block)):
                n = min(end, whole, (k + 1) * self.block) - max(place, k * self.block)
                if n > 0:
                    parts[k].append({"vault": vault, "path": path, "row": row, "n": n})
            if end > whole:
                rest.append(((vault, path, row), value[max(0, whole - place) :]))
            place = end
        first, self.blocks = self.blocks, self.blocks + len(blocks)
        self.open, self.size = rest, len(ids) - whole
        n = len(blocks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.shard] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([self.bits] * n, pa.int32()),
                pa.array([len(b) for b in blocks], pa.int64()), pa.array([crc(b) for b in blocks], pa.int64()),
                pa.array([b.astype("<u4").tobytes() for b in blocks], pa.binary()), pa.array(parts, _PARTS),
            ],
            names=["shard", "block", "bits", "n_tokens", "ids_crc32", "ids", "parts"],
        )


def write_tokens(notes: DataFrame, folder: str, tokenizer_file: str, end: int = END, block: int = BLOCK) -> None:
    """Writes the ids of every whole note, each with ``end`` after it, in order of ``(vault, path)``.

    A file is a Parquet file of blocks: ``shard`` and ``block`` (their order), ``n_tokens``, the unsigned
    CRC-32 of the block's ids, which ``parts`` of which notes it holds, and the coded ids as ``payload``.  All blocks of a
    shard but its last hold ``block`` ids.  Spark's commit makes a lost task's file invisible.

    The ids are those of the tokenizer for the whole text, special tokens not added.  NULL and empty
    texts give the end id alone; repeated rows are written once each; of an empty table only an empty file remains.
    ``tokenizer_file`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer_file)
        bits = max(encoder.bits, int(end).bit_length())
        writer = _Writer(TaskContext.get().partitionId(), bits, block)
        for batch in common.pieces(batches, most=1 << 20):
            texts = batch.column(2).to_pylist()
            for vault, path, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.encode(texts), strict=True):
                writer.add(vault, path, np.append(ids, np.uint32(end)))
            if writer.size >= WAITING * block:
                yield writer.flush(False)
        yield writer.flush(True)

    rows = common.keyed(notes).repartitionByRange("vault", "path").sortWithinPartitions("vault", "path", "content")
    blocks = rows.mapInArrow(common.lean(run), _BLOCKS)
    payload = coder_jvm.encoded(notes.sparkSession, F.col("ids"), F.col("bits"))
    blocks.select("shard", "block", "bits", "n_tokens", "ids_crc32", payload.alias("payload"), "parts").write.parquet(folder)


@cache
def _zeros(k: int) -> np.ndarray:
    """What ``2**k`` zero bytes make of a CRC-32, by its four bytes: ``[4, 256]``, to be joined by exclusive or."""
    if k:
        return _after(_zeros(k - 1), _zeros(k - 1))
    values = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    for _ in range(8):
        values = values >> np.uint32(1) ^ np.uint32(0xEDB88320) * (values & np.uint32(1))
    return values


def _after(step: np.ndarray, values: np.ndarray) -> np.ndarray:
    return step[0, values & 255] ^ step[1, values >> 8 & 255] ^ step[2, values >> 16 & 255] ^ step[3, values >> 24]


def crc_shift(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the CRC-32 of a byte string adds to that of a string which goes on for so many bytes."""
    out = values.astype(np.uint32)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        at = np.flatnonzero(sizes >> k & 1)
        out[at] = _after(_zeros(k), out[at])
    return out


def crc_combine(left: int, right: int, size: int) -> int:
    """The CRC-32 of two adjoining byte strings, the right one of ``size`` bytes."""
    return int(crc_shift(np.array([left], dtype=np.uint32), np.array([size], dtype=np.int64))[0]) ^ right


TOKENS = "vault string, path string, shard int, row bigint, block bigint, place bigint, ids array<int>"


def read_tokens(spark: SparkSession, folder: str, then: common.Task | None = None, columns: str = TOKENS) -> DataFrame:
    """The parts of notes in the files: ``vault, path, shard, row, block, place`` (in the block) and ``ids``.

    A note that goes over an end of a block has several parts.  A block whose ids don't have their
    checksum raises an error.  ``then`` makes ``columns`` of the parts in the worker that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            shard, block, sums = (batch.column(k).to_numpy() for k in range(3))
            data, at = common.utf8(batch.column(4))
            for k in range(batch.num_rows):
                if zlib.crc32(data[at[k] : at[k + 1]]) != sums[k]:
                    raise ValueError(f"block {block[k]} of shard {shard[k]} is damaged")
            parts = batch.column(3)
            vault, path, row, n = parts.flatten().flatten()
            of = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
            ends = np.cumsum(np.append(0, n.to_numpy()))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data.view("<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [vault, path, pa.array(shard[of]), row, pa.array(block[of]), pa.array(ends[:-1] - at[of] // 4), ids],
                names=["vault", "path", "shard", "row", "block", "place", "ids"],
            )

    common.small_batches(spark)
    ids = coder_jvm.decoded(spark, F.col("payload"), F.col("n_tokens"), F.col("bits"))
    blocks = spark.read.schema(FILES).parquet(folder).select("shard", "block", "ids_crc32", "parts", ids.alias("ids"))
    return blocks.mapInArrow(common.lean(lambda batches: then(run(batches)) if then else run(batches)), columns)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(6)
        ids, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        at = at - at[0]
        sums = [crc(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(6)), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["vault", "path", "shard", "row", "block", "place", "n", "crc"],
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        parts = batch.column(4)
        note = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
        block, place, sizes, sums = (c.to_numpy() for c in parts.flatten().flatten())
        order = np.lexsort((place, block, note))
        sizes, first = sizes[order], np.searchsorted(note, np.arange(batch.num_rows))
        n, ends = np.add.reduceat(sizes, first), np.cumsum(sizes)
        # A part's sum goes past the bytes of the note's parts after it.
        after = (ends[first] - sizes[first] + n)[note] - ends
        sums = np.bitwise_xor.reduceat(crc_shift(sums[order], 4 * after), first)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(sums.astype(np.int64))],
            names=["vault", "path", "shard", "offset", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """A row per note in the files of ``write_tokens``, from what is read back.

    ``vault, path, start`` (ids of all notes before it), ``n_tokens`` and ``ids_crc32`` (of its ids as little-endian
    unsigned 32-bit integers).  Sums of a note's parts are put together by CRC arithmetic.
    """
    parts = read_tokens(
        spark, folder, _digests, "vault string, path string, shard int, row bigint, block bigint, place bigint, n bigint, crc bigint"
    )
    # Only parts that touch an end of their block can be one of several, but each note has few anyway.
    rows = parts.groupBy("vault", "path", "shard", "row").agg(
        F.min(F.col("block") * block + F.col("place")).alias("offset"), F.collect_list(F.struct("block", "place", "n", "crc")).alias("parts")
    )
    rows = rows.select("vault", "path", "shard", "offset", "parts").mapInArrow(
        _joined, "vault string, path string, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = spark.read.schema(FILES).parquet(folder).groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    # One row per shard.
    bases = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("vault", "path", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
