"""Near-duplicate notes: a Jaccard join of word shingles by pigeonhole over a partitioned universe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm import common
from notelake.llm.components import components
from notelake.llm.shingles import Sets, shingle_sets

# Similarity 3/4 means: sets of sizes a and b differ in at most (a + b) / 7 elements.
SMALL = 64  # up to this size, index sets also have their one-deletion neighbourhoods
SHARE = 0.4  # segments per element of a band's largest set; 1 in the small bands
PART = 1 << 17  # bytes of text turned into sets at once, about; more don't fit a core's cache
PARITY = 2048  # bits of the parity vector of a set
CROWD = 20_000  # sets that choose a bucket with more members than this are compared with all others in blocks
BLOCK = 4096  # sets compared with all others at once
REPEATS = 1 << 18  # rows of a bucket remembered so that copies of them go out once

_SALT = np.uint64(0x2545F4914F6CDD1D)
_HALF = np.uint64(32)


def _edges() -> np.ndarray:
    """First sizes of the bands; a set's partners are in its own band or the one beside it."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 4 // 3)))
    return np.array(out, dtype=np.int64)


EDGES = _edges()


def segments_of(band: np.ndarray) -> np.ndarray:
    most = EDGES[band + 1] - 1
    return np.where(most <= SMALL, most, np.ceil(SHARE * most)).astype(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most elements in which linked sets of these sizes differ."""
    return (a + b) // 7


class Lanes:
    """Segment subsets of sets, each set in the scheme of its own band and, as a larger partner, of the band below.

    Without ``signed`` only the segments are counted, which tells how many of them a set has to look into.
    """

    def __init__(self, sets: Sets, signed: bool = True):
        size = sets.sizes
        has = np.flatnonzero(size)
        band = np.searchsorted(EDGES, size, side="right") - 1
        below = has[(band[has] > 0) & (3 * size[has] <= 4 * (EDGES[band[has]] - 1))]
        self.row = np.concatenate([has, below])
        self.own = np.concatenate([np.ones(len(has), dtype=bool), np.zeros(len(below), dtype=bool)])
        self.scheme = np.concatenate([band[has], band[below] - 1])
        self.size = size[self.row]
        most = EDGES[self.scheme + 1] - 1
        self.small = most <= SMALL
        self.need = differing(np.minimum(self.size, most), self.size) + 1
        self.width = segments_of(self.scheme)
        start = np.cumsum(self.width) - self.width
        at = common.ranges(sets.at[self.row], self.size)
        tokens = sets.tokens[at]
        total = int(self.width.sum())
        with np.errstate(over="ignore"):
            salt = (self.scheme.astype(np.uint64) + np.uint64(1)) * _SALT
            salted = common.mix64(tokens ^ np.repeat(salt, self.size))
            salted >>= _HALF
            salted *= np.repeat(self.width.astype(np.uint64), self.size)
            slot = (salted >> _HALF).view(np.int64) + np.repeat(start, self.size)
            self.count = np.bincount(slot, minlength=total)
            filled = np.add.reduceat(self.count > 0, start, dtype=np.int64) if total else np.zeros(0, dtype=np.int64)
            twice = np.add.reduceat(self.count > 1, start, dtype=np.int64) if total else np.zeros(0, dtype=np.int64)
            self.filled = filled
            # Allocation: 1 (the subset itself) for each filled segment; where that is too little in a
            # small band, 2 (also one deletion) for segments of two and more.
            self.short = filled < self.need
            self.hard = self.short & (~self.small | (filled + twice < self.need))
            if not signed:
                return
            value = common.mix64(tokens + _SALT)
            subset = np.zeros(total, dtype=np.uint64)
            np.add.at(subset, slot, value)
            exact = np.flatnonzero(self.count)
            self.exact_lane = np.repeat(np.arange(len(self.row)), filled)
            first = (self.scheme * (1 << 36) - start + 1).astype(np.uint64)  # with a segment's place added: its number in the scheme
            self.exact_sig = common.mix64(subset[exact] ^ common.mix64(np.repeat(first, filled) + exact.astype(np.uint64)))
            spare = np.repeat(self.small & (self.own | self.short), self.size)
            spare[spare] = self.count[slot[spare]] > 1
            at = slot[spare]
            self.less_lane = np.repeat(np.arange(len(self.row)), self.size)[spare]
            place = common.mix64(first[self.less_lane] + at.astype(np.uint64))
            self.less_sig = common.mix64((subset[at] - value[spare]) ^ place)


def fingerprints(sets: Sets) -> np.ndarray:
    """One 64-bit value per set."""
    with np.errstate(over="ignore"):
        return common.mix64(sets.sums(common.mix64(sets.tokens ^ _SALT)) + sets.sizes.astype(np.uint64) * _SALT)


def parities(sets: Sets) -> np.ndarray:
    """A bit per class of elements: whether the set has an odd number of them."""
    n = len(sets.at) - 1
    at = sets.owners() * PARITY + (common.mix64(sets.tokens + np.uint64(77)) >> np.uint64(53)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * PARITY) & 1).astype(np.uint8).reshape(n, PARITY), axis=1)


def _sets(batch: pa.RecordBatch, column: int = 2) -> Sets:
    return shingle_sets(*common.utf8(batch.column(column)))


MARKS = "vault string, path string, n bigint, fp bigint, own int, own_need int, below int, below_need int, hard boolean, parity binary"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.pieces(batches, most=PART):
        sets = _sets(batch)
        lanes, n = Lanes(sets, signed=False), batch.num_rows
        out = np.zeros((4, n), dtype=np.int32)
        hard = np.zeros(n, dtype=bool)
        for k, chosen in ((0, lanes.own), (2, ~lanes.own)):
            out[k, lanes.row[chosen]], out[k + 1, lanes.row[chosen]] = lanes.filled[chosen], lanes.need[chosen]
        hard[lanes.row[lanes.hard]] = True
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sets.sizes), pa.array(fingerprints(sets).view(np.int64))]
            + [pa.array(v) for v in out] + [pa.array(hard), pa.array([p.tobytes() for p in parities(sets)], pa.binary())],
            names=["vault", "path", "n", "fp", "own", "own_need", "below", "below_need", "hard", "parity"],
        )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sig, fp, kind``; kind 0 and 1: subset in the own scheme and the one below, 2 and 3: with one deletion."""
    for batch in common.pieces(batches, most=PART):
        sets = _sets(batch)
        fp = fingerprints(sets)
        # Copies within a part send their rows once.
        first = np.zeros(len(fp), dtype=bool)
        first[np.unique(fp, return_index=True)[1]] = True
        keep = np.flatnonzero(first & (sets.sizes > 0))
        sizes = sets.sizes[keep]
        lanes = Lanes(Sets(sets.tokens[common.ranges(sets.at[keep], sizes)], np.concatenate([[0], np.cumsum(sizes)])))
        lane = np.concatenate([lanes.exact_lane, lanes.less_lane])
        kind = np.where(lanes.own[lane], 0, 1) + 2 * (np.arange(len(lane)) >= len(lanes.exact_lane))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([lanes.exact_sig, lanes.less_sig]).view(np.int64)),
                pa.array(fp[keep][lanes.row[lane]].view(np.int64)),
                pa.array(kind.astype(np.int8)),
            ],
            names=["sig", "fp", "kind"],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of sig, those whose sig has several fps, once each, with one of these as pivot."""
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int8))
    wait = none  # rows of the last sig, while it has one fp
    present, pivot, sent = None, 0, set()  # the last sig, once it has several; rows sent of it
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sig, fp, kind = (np.concatenate([w, c.to_numpy()]) for w, c in zip(wait, batch.columns, strict=True))
        new = np.concatenate([[present != sig[0]], sig[1:] != sig[:-1]])
        # Most sigs have one row; the last may go on in the next batch.
        at = np.flatnonzero(~(new & np.append(new[1:], False)))
        at = at[np.lexsort((kind[at], fp[at], sig[at]))]
        sig, fp, kind = sig[at], fp[at], kind[at]
        starts = np.concatenate([[True], sig[1:] != sig[:-1]])
        other = starts.copy()
        other[1:] |= (fp[1:] != fp[:-1]) | (kind[1:] != kind[:-1])
        sig, fp, kind, starts = sig[other], fp[other], kind[other], np.flatnonzero(starts[other])
        sizes = np.diff(np.append(starts, len(sig)))
        pivots, several = fp[starts], fp[starts] != fp[starts + sizes - 1]
        goes_on = sig[0] == present
        if goes_on:
            pivots[0], several[0] = pivot, True
        keep = np.repeat(several, sizes)
        if goes_on:
            keep[: sizes[0]] = [row not in sent for row in zip(fp[: sizes[0]].tolist(), kind[: sizes[0]].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (sig[keep], fp[keep], kind[keep], np.repeat(pivots, sizes)[keep])], names=["sig", "fp", "kind", "pivot"]
        )
        last = int(starts[-1])
        if several[-1]:
            if not goes_on or len(starts) > 1:
                sent = set()
            if len(sent) < REPEATS:  # more may be sent again, which only costs
                sent.update(zip(fp[last:].tolist(), kind[last:].tolist(), strict=True))
            present, pivot, wait = sig[-1], pivots[-1], none
        else:
            present, wait = None, (sig[last:], fp[last:], kind[last:])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and parity vectors leave it open that they are linked."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        na, nb = (batch.column(i).to_numpy() for i in (2, 4))
        pa_, pb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, PARITY // 64) for i in (3, 5))
        apart = np.bitwise_count(pa_ ^ pb).sum(axis=1, dtype=np.int64)
        keep = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (apart <= differing(na, nb))
        yield batch.select([0, 1]).filter(pa.array(keep))


def _meet(nearest: bool):
    """Of buckets in order of size: each probe with the members not larger, where sizes, components and parity
    vectors leave a link open; with ``nearest`` the one of these that differs least.  No other pair leaves the task."""

    def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        none = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, held = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sig, fp, root, probe, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            parity = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint64).reshape(-1, PARITY // 64)
            edge = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
            a, b, size = [], [], 0
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                at = start + np.flatnonzero(~probe[start:end])
                member = (n[at], fp[at], root[at], parity[at])
                if held is not None and sig[start] == present:
                    member = tuple(np.concatenate(v) for v in zip(held, member, strict=True))
                present, held = sig[start], member
                for i in (start + np.flatnonzero(probe[start:end])).tolist():
                    low, high = np.searchsorted(member[0], -(-3 * n[i] // 4)), np.searchsorted(member[0], n[i], side="right")
                    apart = np.bitwise_count(member[3][low:high] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    near = np.flatnonzero((apart <= differing(member[0][low:high], n[i])) & (member[2][low:high] != root[i]))
                    if nearest and len(near):
                        near = near[[int(apart[near].argmin())]]
                    a.append(np.full(len(near), fp[i]))
                    b.append(member[1][low + near])
                    size += len(near)
                    if size >= 100_000:
                        yield pairs(a, b)
                        a, b, size = [], [], 0
            yield pairs(a, b)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        for part in common.pieces(iter([batch]), "left", PART):
            left, right = _sets(part, 2), _sets(part, 3)
            keep = []
            for i in range(part.num_rows):
                a, b = left.of(i), right.of(i)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= 75 * (len(a) + len(b) - both))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class _Join:
    """Classes of equal shingle sets, and the links found between them so far."""

    def __init__(self, notes: DataFrame):
        self.notes = notes
        self.marks = common.stored(notes.mapInArrow(common.lean(_mark), MARKS), "shingle-marks")
        columns = ["n", "own", "own_need", "below", "below_need", "hard", "parity"]
        self.classes = common.stored(
            self.marks.where("n > 0").groupBy("fp").agg(
                F.min(F.struct("vault", "path")).alias("rep"), *(F.first(c).alias(c) for c in columns)
            ),
            "shingle-classes",
        )
        self.links = notes.sparkSession.createDataFrame([], "a bigint, b bigint")
        self.roots = notes.sparkSession.createDataFrame([], "node bigint, root bigint")

    def link(self, pairs: DataFrame) -> None:
        """Adds the links among candidate ``pairs(a, b)``: parity vectors first, then the sets themselves."""
        sides = pairs.join(self.classes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a")
        sides = sides.join(self.classes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")
        open_ = common.stored(
            sides.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(common.lean(_close), "a bigint, b bigint"), "jaccard-pairs"
        )
        nodes = open_.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = common.stored(nodes.join(self.classes, "fp").select("fp", "rep.vault", "rep.path"), "jaccard-wanted")
        bits = common.bitmap(wanted.select(common.key_hash().alias("h")))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([0, 1, 2]).filter(pa.array(common.in_bitmap(bits, batch.column(3).to_numpy())))

        texts = (
            self.notes.withColumn("h", common.key_hash())
            .mapInArrow(common.lean(fetch), "vault string, path string, content string")
            .join(wanted, ["vault", "path"])
        )
        # A repeated key has several texts; the class they are fetched for tells which is meant.
        texts = common.stored(
            texts.select("fp", "content").mapInArrow(common.lean(_matching), "fp bigint, content string").dropDuplicates(["fp"]), "jaccard-texts"
        )
        found = (
            open_.join(texts.select(F.col("fp").alias("a"), F.col("content").alias("left")), "a")
            .join(texts.select(F.col("fp").alias("b"), F.col("content").alias("right")), "b")
            .select("a", "b", "left", "right")
            .mapInArrow(common.lean(_verify), "a bigint, b bigint")
        )
        self.links = common.stored(self.links.unionByName(found), "jaccard-links")
        self.roots = components(self.links)

    def rooted(self, df: DataFrame, column: str = "fp", name: str = "root") -> DataFrame:
        roots = self.roots.select(F.col("node").alias(column), F.col("root").alias(name))
        return df.join(roots, column, "left").withColumn(name, F.coalesce(name, column))

    def run(self) -> None:
        rows = self.notes.mapInArrow(common.lean(_signatures), "sig bigint, fp bigint, kind tinyint")
        buckets = common.stored(
            rows.repartition("sig")
            .sortWithinPartitions("sig")  # one number: Spark sorts by its digits, without comparisons
            .mapInArrow(common.lean(_shared), "sig bigint, fp bigint, kind tinyint, pivot bigint"),
            "jaccard-buckets",
        )
        # First each set against the pivot it shares most with: that joins most groups without pairs among copies.
        self.link(
            buckets.where("fp <> pivot")
            .groupBy("fp", "pivot").count()
            .groupBy("fp").agg(F.max(F.struct("count", "pivot")).alias("best"))
            .select(F.col("fp").alias("a"), F.col("best.pivot").alias("b"))
        )
        # Then what is left open: first each set against the nearest it meets, which joins most of a large group
        # of near copies, and last all that is still in different components.
        for nearest in (True, False):
            self._open(buckets, nearest)

    def _open(self, buckets: DataFrame, nearest: bool) -> None:
        """Links between sets of different components that share a bucket."""
        rooted = common.stored(self.rooted(buckets.select("sig", "fp", "kind")), "jaccard-rooted")
        crowds = common.stored(
            rooted.groupBy("sig").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"))
            .where("r0 <> r1").select("sig", "size"),
            "jaccard-crowds",
        )
        open_ = common.stored(rooted.join(crowds, "sig"), "jaccard-open")
        lane = (F.col("kind") % 2).alias("below")
        exact = open_.where("kind < 2").withColumn("lane", lane)
        sizes = self.classes.select(
            "fp", "n", F.array("own", "below").alias("filled"), F.array("own_need", "below_need").alias("needs")
        )
        # A set has to look into as many segments as its budget asks, the cheapest first; segments
        # that nobody shares, or only its own component, cost nothing.
        per = Window.partitionBy("fp", "lane")
        ranked = (
            exact.join(sizes, "fp")
            .withColumn("filled", F.col("filled")[F.col("lane")])
            .withColumn("need", F.col("needs")[F.col("lane")])
            .withColumn("free", F.col("filled") - F.count("*").over(per))
            .withColumn("turn", F.row_number().over(per.orderBy("size", "sig")))
        )
        chosen = ranked.where("filled < need or turn <= need - free").select("sig", "fp", "n", "root", "size")
        spare = open_.where("kind >= 2").join(sizes, "fp").withColumn("lane", lane)
        spare = spare.where(F.col("filled")[F.col("lane")] < F.col("needs")[F.col("lane")])
        chosen = common.stored(chosen.unionByName(spare.select("sig", "fp", "n", "root", "size")), "jaccard-chosen")
        small = chosen.where(F.col("size") <= CROWD).select("sig", "fp", "root", F.lit(True).alias("probe"))
        members = open_.where("kind in (0, 2)").join(small.select("sig").distinct(), "sig")
        rows = members.select("sig", "fp", "root", F.lit(False).alias("probe")).unionByName(small)
        pairs = (
            rows.join(self.classes.select("fp", "n", "parity"), "fp")
            .select("sig", "fp", "root", "probe", "n", "parity")
            .repartition("sig").sortWithinPartitions("sig", "n", "probe")
            .mapInArrow(common.lean(_meet(nearest)), "a bigint, b bigint")
        )
        hard = self.classes.where("hard").select("fp").unionByName(chosen.where(F.col("size") > CROWD).select("fp")).distinct()
        if not nearest:
            for block in self._blocks(common.stored(self.rooted(hard).join(self.classes, "fp"), "jaccard-hard")):
                pairs = pairs.unionByName(block)
        self.link(common.stored(pairs.distinct(), "jaccard-candidates"))

    def _blocks(self, hard: DataFrame) -> Iterator[DataFrame]:
        """Pairs of the sets that segments can't decide with all others, a block of them at a time."""
        parts = -(-hard.count() // BLOCK)
        rest = self.rooted(self.classes.select("fp", "n", "parity"))
        for part in range(parts):
            rows = hard.where(F.pmod("fp", F.lit(parts)) == part).select("fp", "n", "root", "parity").collect()
            shared = hard.sparkSession.sparkContext.broadcast(sorted((r["n"], r["fp"], r["root"], bytes(r["parity"])) for r in rows))
            yield rest.mapInArrow(common.lean(lambda batches, s=shared: _against(s.value, batches)), "a bigint, b bigint")

    def result(self) -> DataFrame:
        marks = self.rooted(self.marks.select("vault", "path", "n", "fp"))
        # Written once, so that the join shuffles both sides and a large group can be split.
        heads = common.stored(
            marks.where("n > 0").groupBy("root").agg(F.min(F.struct("vault", "path")).alias("head"), F.count("*").alias("size"))
            .where("size > 1"),
            "jaccard-heads",
        )
        return marks.join(heads, (marks["root"] == heads["root"]) & (marks["n"] > 0), "left").select(
            "vault", "path", F.col("n").alias("n_shingles"),
            F.coalesce("head.vault", "vault").alias("component_vault"),
            F.coalesce("head.path", "path").alias("component_path"),
            F.coalesce("size", F.lit(1).cast("bigint")).alias("component_size"),
        )


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.pieces(batches, most=PART):
        fp = fingerprints(_sets(batch, 1)).view(np.int64)
        yield batch.filter(pa.array(fp == batch.column(0).to_numpy()))


def _against(block: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.array([b[0] for b in block])
    fp, root = (np.array([b[i] for b in block], dtype=np.int64) for i in (1, 2))
    parity = np.frombuffer(b"".join(b[3] for b in block), dtype=np.uint64).reshape(-1, PARITY // 64)
    for batch in batches:
        a, b = [], []
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("fp", "n", "root", "parity")), strict=True)
        for other, m, its, bits in rows:
            low, high = np.searchsorted(n, -(-3 * m // 4)), np.searchsorted(n, 4 * m // 3, side="right")
            near = np.bitwise_count(parity[low:high] ^ np.frombuffer(bits, dtype=np.uint64)).sum(axis=1, dtype=np.int64)
            at = low + np.flatnonzero((near <= differing(n[low:high], m)) & (root[low:high] != its))
            a.extend(fp[at].tolist())
            b.extend([other] * len(at))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def jaccard_components(notes: DataFrame) -> DataFrame:
    """Groups of notes linked by a word-shingle similarity of 0.75 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a note's set holds its distinct
    shingles of five words, or with fewer words all of them as one.  Notes with
    equal sets are one class.  The universe of shingles is cut into segments, more
    of them for larger sets; sets within the difference budget agree on one of
    enough segments, so only classes with an equal segment subset (in small sets also
    one with an element less) are compared.  Each class chooses the segments that
    cost least: those that nobody shares come first.  Candidates pass an exact
    bound on parity vectors, which are compared bucket by bucket inside the tasks, and are verified
    on their sets.  Classes that can't do without a crowded bucket are compared with all others in blocks.

    Returns ``vault, path, n_shingles, component_vault, component_path, component_size``,
    the component being named by its smallest ``(vault, path)``.  A note without
    words (empty or NULL) has 0 shingles and is linked with nothing.  Repeated rows
    get a row each; an empty table gives no rows.  Shingles and classes are
    64-bit hashes: among a billion different notes the chance of any clash of classes is 3 %.
    """
    join = _Join(common.keyed(notes))
    join.run()
    return join.result()
