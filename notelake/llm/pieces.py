"""SentencePiece ids of notes and back, by a streaming Viterbi search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm import common

SPACE = "▁"
STAND_IN = "\ud800"  # not a character, so no text holds it
APART = "\ud801"  # neither, so no piece goes over it
DECODED = 1 << 18  # ids decoded at once, about
LANES = 32_000  # segments searched at once
LANE = 40  # segments up to this length are searched many at a time
REMEMBERED = 1 << 18  # searched segments of up to LANE code points that a process keeps
UNKNOWN = 10.0  # a byte costs as much as the worst piece and this

_LOADED: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces and scores of a model file; texts are not normalised, so decoding gives them back.

    A text is read with one blank before it and ``U+2581`` for each blank.  A code point that
    no piece covers, and a literal ``U+2581``, become the ids of their UTF-8 bytes.
    """

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.size = model.vocab_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (i, float(model.get_score(i)))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max((len(p) for p in self.pieces), default=1)
        usable = [s for _, s in self.pieces.values() if s > -1e8]
        self.byte_cost = min(usable, default=0.0) - UNKNOWN
        # Where no piece goes on over a boundary, all paths meet: before a blank after something else, around a line end.
        inner = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n")
        self.segments = re.compile(r"\n| *[^ \n]+| +" if not any(inner.search(p) for p in self.pieces) else r"(?s).+")
        self._forget()
        self._table()
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    # All prefixes of pieces are nodes of a tree; a hash table has the step from a node by a letter.
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def _table(self) -> None:
        nodes: dict[str, int] = {"": 0}
        steps: list[tuple[int, int, int]] = []
        for piece in self.pieces:
            node = 0
            for end in range(1, len(piece) + 1):
                parent, node = node, nodes.setdefault(piece[:end], len(nodes))
                if node == len(nodes) - 1 and node > len(steps):
                    steps.append((parent, ord(piece[end - 1]), node))
        self.piece_at, self.score_at = np.full(len(nodes), -1, dtype=np.int32), np.full(len(nodes), -np.inf)
        for piece, (i, score) in self.pieces.items():
            self.piece_at[nodes[piece]], self.score_at[nodes[piece]] = i, score
        bits = max(4, (8 * len(steps)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        key = np.array([node << 21 | letter for node, letter, _ in steps], dtype=np.int64)
        after = np.array([node for _, _, node in steps], dtype=np.int32)
        slot, left = self._slots(key), np.arange(len(key))
        while len(left):
            # Of the keys at a free slot the first takes it, the others go on to the next slot.
            free = left[self.keys[slot[left]] < 0]
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.next[taken] = key[free[first]], after[free[first]]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.SPREAD >> self.shift).view(np.int64)

    def _steps(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to, 0 where no piece goes on so."""
        keys = nodes.astype(np.int64) << 21 | letters
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.next[slot], 0)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def _bytes(self, letter: str) -> list[int]:
        return self.byte_ids[np.frombuffer(letter.encode("utf-8", "surrogatepass"), dtype=np.uint8)].tolist()

    def stream(self, parts: Iterator[str]) -> Iterator[int]:
        """Ids of a text that comes in parts (blanks as they are).

        Holds the states of the last ``longest`` positions only, and the backpointers since the
        last boundary that all their paths share; ids up to it are given out.
        """
        text, base = "", 0  # text from position base on; base is committed
        cost: list[float] = [0.0]  # of base, base + 1, ...
        back: list[tuple[int, int]] = [(0, -1)]  # start of the last piece, its id (-1: bytes)
        for part in parts:
            for letter in part:
                # No piece has this stand-in, so a literal U+2581 becomes bytes.
                text += SPACE if letter == " " else STAND_IN if letter == SPACE else letter
                end = len(text)
                best, where = cost[end - 1] + self.byte_cost * len(letter.encode("utf-8", "surrogatepass")), (end - 1, -1)
                for start in range(max(0, end - self.longest), end):
                    found = self.pieces.get(text[start:end])
                    if found and cost[start] + found[1] > best:
                        best, where = cost[start] + found[1], (start, found[0])
                cost.append(best)
                back.append(where)
                if end >= 2 * self.longest and end % self.longest == 0:
                    common_to = self._meeting(back, end)
                    if common_to:
                        yield from self._path(text, back, common_to)
                        text = text[common_to:]
                        shared = cost[common_to]
                        cost = [c - shared for c in cost[common_to:]]
                        back = [(max(0, s - common_to), i) for s, i in back[common_to:]]
        yield from self._path(text, back, len(text))

    def _meeting(self, back: list[tuple[int, int]], end: int) -> int:
        """The last position that the best paths to all live positions go through."""
        live = set(range(max(0, end - self.longest + 1), end + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(back[last][0])
        return live.pop()

    def _path(self, text: str, back: list[tuple[int, int]], end: int) -> list[int]:
        out: list[list[int]] = []
        while end > 0:
            start, i = back[end]
            letter = text[start:end]
            out.append([i] if i >= 0 else self._bytes(" " if letter == SPACE else SPACE if letter == STAND_IN else letter))
            end = start
        return [i for ids in reversed(out) for i in ids]

    def _lanes(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each of these segments."""
        ids, counts = self._search(segments)
        return np.split(ids, np.cumsum(counts)[:-1])

    def _search(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments of at most LANE code points, one segment after the other, and how many each has.

        The pieces from each position on are found for all positions at once; then the search goes from
        position to position in all segments.
        """
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        # A place between two segments ends the pieces that come up to it.
        flat = np.frombuffer((APART.join(segments) + APART).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where(flat < 0x10000, 3, 4)))
        # A literal U+2581 stands as the stand-in here, which no piece has, so it becomes bytes.
        letters = np.where(flat == 0x2581, ord(STAND_IN), np.where(flat == 0x20, 0x2581, flat)).astype(np.int64)
        depth = np.arange(len(flat)) - np.repeat(begins, sizes + 1)  # of a place in its segment
        live, node = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int32)
        ends: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        found: list[np.ndarray] = []
        for length in range(1, self.longest + 1):
            node = self._steps(node, letters[live + length - 1])
            on = np.flatnonzero(node)
            live, node = live[on], node[on]
            if not len(live):
                break
            whole = np.flatnonzero(self.piece_at[node] >= 0)
            ends.append(live[whole] + length)
            lengths.append(np.full(len(whole), length, dtype=np.int32))
            found.append(node[whole])
        inside = np.flatnonzero(letters != ord(APART))
        # A byte way to each place comes before all pieces, then longer pieces before shorter ones.
        end = np.concatenate([inside + 1, *ends])
        length = np.concatenate([np.zeros(len(inside), dtype=np.int32), *lengths])
        node = np.concatenate([np.full(len(inside), -1, dtype=np.int32), *found])
        score = np.where(node < 0, self.byte_cost * np.concatenate([own[inside], np.zeros(len(end) - len(inside), dtype=np.int64)]), self.score_at[node])
        turn = depth[end - 1] * (self.longest + 1) + np.where(length > 0, self.longest + 1 - length, 0)
        turn = turn.astype(np.min_scalar_type(int(turn.max(initial=0))))
        order = np.argsort(turn, kind="stable")
        end, length, node, score, turn = end[order], length[order], node[order], score[order], turn[order]
        cost, best = np.zeros(len(flat)), np.zeros(len(flat), dtype=np.int64)
        edges = np.append(np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]])), len(turn)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # The ways of one turn have one length and go to different places.
            to, long = end[a:b], int(length[a])
            sums = score[a:b] + cost[to - max(1, long)]
            if long == 0:
                cost[to], best[to] = sums, np.arange(a, b)
            else:
                better = np.flatnonzero(sums > cost[to])
                cost[to[better]], best[to[better]] = sums[better], better + a
        # Back from the ends, all segments at once; letters without a piece count for their bytes.
        place, lane = begins + sizes, np.arange(len(segments))
        turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            go = place > begins[lane]
            place, lane = place[go], lane[go]
            if not len(lane):
                break
            way = best[place]
            turns.append((lane, np.where(node[way] < 0, -1, self.piece_at[node[way]]), place - 1))
            place = place - np.maximum(1, length[way])
        lane = np.concatenate([t[0] for t in reversed(turns)])
        ids, spot = (np.concatenate([t[k] for t in reversed(turns)]) for k in (1, 2))
        order = np.argsort(lane, kind="stable")
        lane, ids, spot = lane[order], ids[order], spot[order]
        width = np.where(ids < 0, own[spot], 1)
        counts = np.bincount(lane, weights=width, minlength=len(segments)).astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            begin = np.cumsum(width) - width
            ids = np.repeat(ids, width)
            text = [self._bytes(chr(c)) for c in flat[spot[odd]].tolist()]
            ids[common.ranges(begin[odd], width[odd])] = [i for made in text for i in made]
        return ids.astype(np.int32), counts

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        ends = len(self.table) + np.cumsum(counts)
        self.remembered.update(zip(words, range(len(self.begin), len(self.begin) + len(words)), strict=True))
        self.table = np.concatenate([self.table, ids])
        self.begin, self.count = np.concatenate([self.begin, ends - counts]), np.concatenate([self.count, counts])

    def _forget(self) -> None:
        self.remembered: dict[str, int] = {}
        self.table = np.zeros(0, dtype=np.int32)
        self.begin, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has.

        The pattern cuts where no piece goes on, so all paths meet at each cut: a segment's ids are
        final at its end, whatever follows.  Short segments hold no more than LANE backpointers
        until then; longer ones go through :meth:`stream`, which commits within them.
        Equal segments are searched once, and short ones are remembered from batch to batch: up to
        REMEMBERED of them, then the memory starts anew.
        """
        words = [self.segments.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        if not flat:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        distinct = dict.fromkeys(flat)
        new = [w for w in distinct if w not in self.remembered]
        if len(self.remembered) + len(new) > REMEMBERED:
            self._forget()
            new = list(distinct)
        known = self.remembered
        short = [w for w in new if len(w) <= LANE]
        for first in range(0, len(short), LANES):
            group = short[first : first + LANES]
            self._remember(group, *self._search(group))
        long = [w for w in new if len(w) > LANE]
        made = [np.array(list(self.stream(iter(w))), dtype=np.int32) for w in long]
        if made:
            self._remember(long, np.concatenate(made), np.array([len(m) for m in made], dtype=np.int64))
        at = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
        of_text = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        counts = np.bincount(of_text, weights=self.count[at], minlength=len(texts)).astype(np.int64)
        ids = self.table[common.ranges(self.begin[at], self.count[at])]
        if made:
            # Long segments are not kept: the rows of the batch's last ones go again.
            for w in long:
                del known[w]
            self.begin, self.count = self.begin[: -len(long)], self.count[: -len(long)]
            self.table = self.table[: len(self.table) - sum(len(m) for m in made)].copy()
        if len(known) > REMEMBERED:
            self._forget()
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        data = self.flat[common.ranges(self.starts[ids], self.lengths[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if t[:1] == " " else t for t in texts]


def load(file: str) -> PieceModel:
    """The model of a file, read once per process."""
    if file not in _LOADED:
        _LOADED[file] = PieceModel(file)
    return _LOADED[file]


def encode_notes(notes: DataFrame, model_file: str) -> DataFrame:
    """``vault, path, ids`` (array of int): the piece ids of each whole note.

    ``model_file`` must be readable on every executor.  Of all ways to cut a text into pieces the
    one with the greatest sum of scores is taken; of equal ones, that whose last piece
    is longer, byte ids last.  NULL and empty texts have no ids.  Repeated rows get
    a row each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in common.pieces(batches, most=1 << 20):
            ids, counts = model.encode_batch(batch.column(2).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                names=["vault", "path", "ids"],
            )

    return common.keyed(notes).mapInArrow(common.lean(run), "vault string, path string, ids array<int>")


def decode_notes(encoded: DataFrame, model_file: str) -> DataFrame:
    """``vault, path, ids, content``: the texts of piece ids, exactly as they were encoded.

    NULL or empty ids give the empty text; ids outside the model raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for whole in batches:
            ends, start = whole.column(2).offsets.to_numpy(), 0
            while start < whole.num_rows:
                # Parts of about DECODED ids, or one longer note.
                end = int(np.searchsorted(ends, ends[start] + DECODED, side="right")) - 1
                batch = whole.slice(start, min(max(end, start + 1), whole.num_rows) - start)
                start += batch.num_rows
                column = batch.column(2)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= model.size):
                    raise ValueError("an id is not in the model")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), column, pa.array(model.decode(ids, np.diff(column.offsets.to_numpy())), pa.string())],
                    names=["vault", "path", "ids", "content"],
                )

    rows = encoded.select("vault", "path", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
    return rows.mapInArrow(common.lean(run), "vault string, path string, ids array<int>, content string")
