"""Change commands: create, update, append, append_daily, delete and move.

Commands of one note take effect in ``seq`` order; commands of different notes
are independent unless a move joins them.  The work is therefore grouped by note
and, for a note with very many commands, by *segment*: a stretch that starts at a
command which sets the text whatever it was before.  Each group is folded from
its own starting text:

* ordinary notes: their commands are collected (a bounded number and size) and
  folded by the built-in ``aggregate``;
* notes that moves tie together: the commands of such a group stream, in order, through a fold that
  holds the texts of the group;
* hot notes: existence and segment starts come from running maxima that are cut
  into blocks, then the segments are spread over the cluster and streamed, one
  batch at a time, through a small fold that hashes incrementally.

All outcomes travel in one frame (``OUTCOME``); results, changed notes and trash
are filters of it.  It is checkpointed, so the note table is searched for the
touched notes once, however many of these are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import paths, text
from .checkpoints import checkpoint
from .common import (
    BROADCAST_BYTES, BROADCAST_ROWS, RANK_BLOCKS, KeyFilter, block_carries, broadcast_if_small, inside_block, is_small, rank_blocks,
)
from .linked import FEW_EDGES, groups
from .workers import lean, small_batches

# A note with more commands, or more command text, than this is a hot note.
FOLD_COMMANDS = 1000
FOLD_CHARS = 32 << 20
# Above so many commands on one note the length of the note itself is looked at.
SOME_COMMANDS = 200

OUTCOME = (
    "kind string, seq bigint, vault string, path string, status string, "
    "content string, content_hash string, deleted_from string"
)
_STEP = "struct<kind:string,seq:bigint,status:string,content:string,content_hash:string>"
# ``aggregate`` copies its state at every step, so the outcome of each command is
# kept as a line of text, "<status> <hash>", rather than as a row.
_BIN = "array<struct<seq:bigint,content:string>>"
_STATE = f"struct<content:string,ok:boolean,log:string,bin:{_BIN}>"
_KEY = ["vault", "key"]
TRASH_FOLDER = ".trash"


@dataclass(frozen=True)
class Applied:
    """What a batch of commands did to ``notes``."""

    before: DataFrame
    trash_before: DataFrame | None
    outcome: DataFrame
    few_keys: bool

    @cached_property
    def results(self) -> DataFrame:
        """One row per command."""
        rows = self.outcome.filter(F.col("kind") == "result")
        return rows.select("seq", "vault", "path", "content_hash", "status")

    @cached_property
    def changes(self) -> DataFrame:
        """Final text, or tombstone, of every note that changed."""
        rows = self.outcome.filter(F.col("kind") == "change")
        return rows.select(
            "vault", "path", "content", "content_hash", F.col("content").isNull().alias("deleted")
        )

    @cached_property
    def trashed(self) -> DataFrame:
        rows = self.outcome.filter(F.col("kind") == "trash")
        return rows.select("vault", "path", "content", "content_hash", "deleted_from")

    @cached_property
    def notes(self) -> DataFrame:
        return merge_changes(self.before, self.changes, few_keys=self.few_keys)

    @cached_property
    def trash(self) -> DataFrame:
        if self.trash_before is None:
            return self.trashed
        return self.trash_before.select(self.trashed.columns).unionByName(self.trashed)


def merge_changes(notes: DataFrame, changes: DataFrame, few_keys: bool | None = None) -> DataFrame:
    """``notes`` with changed keys replaced and tombstoned keys removed.

    Few changed keys are broadcast; of many, a bitmap is, and only notes that it lets pass are shuffled.  So
    unchanged notes stay where they are.
    """
    keys = changes.select("vault", "path")
    notes = notes.select("vault", "path", "content", "content_hash")
    if is_small(keys) if few_keys is None else few_keys:
        kept = notes.join(F.broadcast(keys), ["vault", "path"], "left_anti")
    else:
        touched = KeyFilter.of(keys, "vault", "path")
        kept = touched.others(notes).unionByName(touched.possible(notes).join(keys, ["vault", "path"], "left_anti"))
    return kept.unionByName(changes.filter(~F.col("deleted")).drop("deleted"))


def writable_commands(commands: DataFrame, vaults: DataFrame) -> DataFrame:
    """Commands with the status of the checks made before any note is read.

    An unknown vault comes before a read-only one, and both before the path.
    """
    known = vaults.select(F.col("name").alias("vault"), F.col("read_only").alias("__read_only"))
    rule = paths.path_status(F.col("path"))
    status = (
        F.when(F.col("__read_only").isNull(), S.NOT_REGISTERED)
        .when(F.col("__read_only"), S.READ_ONLY)
        .when(~F.col("op").isin(*S.OPS) | F.col("op").isNull(), S.UNKNOWN_OP)
        .otherwise(rule)
    )
    return (
        commands.join(broadcast_if_small(known), "vault", "left")
        .withColumn("status", status)
        .drop("__read_only")
    )


def judged_commands(commands: DataFrame, vaults: DataFrame) -> DataFrame:
    return writable_commands(commands, vaults).select(
        "seq",
        "vault",
        "op",
        F.when(F.col("status") == S.OK, paths.normalize_path(F.col("path")))
        .otherwise(F.col("path"))
        .alias("key"),
        F.coalesce("dest", F.lit("")).alias("dest"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("expected_hash", F.lit("")).alias("expected_hash"),
        F.coalesce("overwrite", F.lit(False)).alias("overwrite"),
        "status",
    )


def base_notes(notes: DataFrame, keys: DataFrame, few_keys: bool) -> DataFrame:
    """Current ``(vault, key, content)`` of the touched keys."""
    notes = notes.select("vault", F.col("path").alias("key"), "content")
    if few_keys:
        return notes.join(F.broadcast(keys), _KEY)
    keys = checkpoint(keys)
    return KeyFilter.of(keys, *_KEY).possible(notes).join(keys, _KEY)


# -- ordinary notes -----------------------------------------------------------


def _step_status(op: Column, current: Column, expected: Column, overwrite: Column) -> Column:
    return (
        F.when(op == "create", F.when(current.isNotNull() & ~overwrite, S.EXISTS).otherwise(S.OK))
        .when(op == "append_daily", S.OK)
        .when(current.isNull(), S.NOT_FOUND)
        .when(
            (op == "update") & (expected != "") & (text.content_hash(current) != expected),
            S.HASH_MISMATCH,
        )
        .otherwise(S.OK)
    )


def _step_content(op: Column, current: Column, body: Column) -> Column:
    return (
        F.when(op.isin("create", "update"), body)
        .when(op.isin("append", "append_daily"), F.concat(F.coalesce(current, F.lit("")), body))
        .otherwise(F.lit(None).cast("string"))
    )


def _step(state: Column, c: Column) -> Column:
    op, current = c["op"], state["content"]

    def after(status: Column) -> Column:
        ok = status == S.OK
        following = F.when(ok, _step_content(op, current, c["body"])).otherwise(current)
        binned = F.array(F.struct(c["seq"].alias("seq"), current.alias("content")))

        def with_content(content: Column) -> Column:
            digest = F.when(ok & content.isNotNull(), text.content_hash(content)).otherwise(F.lit(""))
            return F.struct(
                content.alias("content"),
                (state["ok"] | ok).alias("ok"),
                F.concat(state["log"], status, F.lit(" "), digest, F.lit("\n")).alias("log"),
                F.when((op == "delete") & ok, F.concat(state["bin"], binned))
                .otherwise(state["bin"])
                .alias("bin"),
            )

        return text.let(following, with_content)

    return text.let(_step_status(op, current, c["expected_hash"], c["overwrite"]), after)


def _outcome_row(kind: str, seq: Column, status: Column, content: Column, digest: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        seq.alias("seq"),
        status.alias("status"),
        content.alias("content"),
        digest.alias("content_hash"),
    ).cast(_STEP)


def _fold_collected(commands: DataFrame, base: DataFrame) -> DataFrame:
    ordered = commands.groupBy(*_KEY).agg(
        F.array_sort(
            F.collect_list(F.struct("seq", "op", "body", "expected_hash", "overwrite"))
        ).alias("commands")
    )
    start = F.struct(
        F.col("content").alias("content"),
        F.lit(False).alias("ok"),
        F.lit("").alias("log"),
        F.array().alias("bin"),
    ).cast(_STATE)
    folded = ordered.join(base, _KEY, "left").select(
        *_KEY, "commands", F.aggregate("commands", start, _step).alias("state")
    )
    nothing = F.lit(None).cast("string")

    def result(c: Column, line: Column) -> Column:
        digest = F.nullif(F.substring_index(line, " ", -1), F.lit(""))
        return _outcome_row("result", c["seq"], F.substring_index(line, " ", 1), nothing, digest)

    content = F.col("state.content")
    results = text.let(
        F.split("state.log", "\n"),
        lambda lines: F.transform("commands", lambda c, i: result(c, F.get(lines, i))),
    )
    binned = F.transform(
        "state.bin",
        lambda b: _outcome_row(
            "trash", b["seq"], F.lit(S.OK), b["content"], text.content_hash(b["content"])
        ),
    )
    last = _outcome_row(
        "change", F.lit(None).cast("bigint"), F.lit(S.OK), content, text.content_hash(content)
    )
    changed = F.when(F.col("state.ok"), F.array(last)).otherwise(F.array().cast(f"array<{_STEP}>"))
    return folded.select(*_KEY, F.inline(F.concat(results, binned, changed)))


# -- hot notes ----------------------------------------------------------------

_SEGMENT_ROWS = (
    "vault string, key string, segment bigint, kind string, seq bigint, status string, "
    "content string, content_hash string"
)
# Rows of a batch that are Python objects at a time, and rows or characters of a batch that is given on.
_SLICE = 256
_OUT_ROWS = 4096
_OUT_CHARS = 4 << 20


class Row:
    """One command, or the text that a note has before its commands."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def put(self, values: tuple) -> "Row":
        self.__dict__.update(zip(self.names, values))
        return self


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """Rows of Arrow batches, each good until the next; few of them are Python objects at a time."""
    for batch in batches:
        row = Row(batch.schema.names)
        for start in range(0, batch.num_rows, _SLICE):
            part = batch.slice(start, _SLICE)
            for values in zip(*(column.to_pylist() for column in part.columns)):
                yield row.put(values)


class _Out:
    """Rows on their way out, given on before they grow large."""

    def __init__(self, ddl: str) -> None:
        kinds = {"string": pa.string(), "bigint": pa.int64()}
        self.schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
        self.at = self.schema.names.index("content")
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += len(row[self.at] or "")

    def full(self) -> bool:
        return len(self.rows) >= _OUT_ROWS or self.chars >= _OUT_CHARS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        arrays = [pa.array(column, field.type) for column, field in zip(columns, self.schema)]
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


class NoteText:
    """A note's text while its segment streams by, with a running digest."""

    def __init__(self, value: str | None):
        self.set(value)

    def set(self, value: str | None) -> None:
        self.parts = None if value is None else [value]
        self.sha = hashlib.sha256((value or "").encode())

    def add(self, value: str) -> None:
        if self.parts is None:
            self.set(value)
        else:
            self.parts.append(value)
            self.sha.update(value.encode())

    def digest(self) -> str | None:
        return None if self.parts is None else self.sha.copy().hexdigest()

    def value(self) -> str | None:
        return None if self.parts is None else "".join(self.parts)


def _stream_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold segments that arrive sorted; only one note text is held at a time."""
    out = _Out(_SEGMENT_ROWS)
    group, note, any_ok = None, None, False

    def close() -> None:
        if group is not None and any_ok:
            out.add(*group, "change", None, S.OK, note.value(), note.digest())

    for c in _rows(batches):
        if (c.vault, c.key, c.segment) != group:
            close()
            group, any_ok = (c.vault, c.key, c.segment), False
            note = NoteText("" if c.existed and c.op != "base" else None)
        if out.full():
            yield out.take()
        if c.op == "base":
            note.set(c.body)
            continue
        missing = note.parts is None
        if c.op == "create":
            status = S.EXISTS if not missing and not c.overwrite else S.OK
        elif c.op == "append_daily":
            status = S.OK
        elif missing:
            status = S.NOT_FOUND
        elif c.op == "update" and c.expected_hash and note.digest() != c.expected_hash:
            status = S.HASH_MISMATCH
        else:
            status = S.OK
        if status == S.OK:
            any_ok = True
            if c.op == "delete":
                out.add(*group, "trash", c.seq, status, note.value(), note.digest())
                note.set(None)
            elif c.op in ("create", "update"):
                note.set(c.body)
            else:
                note.add(c.body)
        out.add(*group, "result", c.seq, status, None, note.digest() if status == S.OK else None)
    close()
    yield out.take()


def _fold_hot(commands: DataFrame, base: DataFrame, blocks: int) -> DataFrame:
    """Fold notes with any number of commands.

    ``create`` and ``append_daily`` always leave a note, ``delete`` never does and
    the rest change nothing about existence, so whether a note exists before a
    command is the latest such command before it.  With that known, commands that
    set the text whatever it was are known too, and they start the segments.
    """
    op, seq, block = F.col("op"), F.col("seq"), "block"
    mark = F.when(op.isin("create", "append_daily"), seq * 2 + 1).when(op == "delete", seq * 2)
    # One cut into blocks serves both running maxima, and one shuffle their windows.
    placed = rank_blocks(commands, _KEY, "seq", block, blocks).withColumn("own", mark)
    earlier = block_carries(placed, _KEY, block, "own", "earlier")
    marked = placed.join(earlier, [*_KEY, block], "left").withColumn(
        "mark", F.greatest(F.max("own").over(inside_block(_KEY, block, "seq", inclusive=False)), "earlier")
    )
    present = base.select(*_KEY, F.lit(True).alias("present"))
    existed = (
        marked.join(broadcast_if_small(present), _KEY, "left")
        .withColumn(
            "existed",
            F.when(F.col("mark").isNull(), F.coalesce("present", F.lit(False))).otherwise(
                F.col("mark") % 2 == 1
            ),
        )
        .drop("mark", "own", "earlier", "present")
    )
    was = F.col("existed")
    start = F.when(
        ((op == "create") & (F.col("overwrite") | ~was))
        | ((op == "append_daily") & ~was)
        | ((op == "update") & (F.col("expected_hash") == "") & was),
        seq,
    )
    begun = checkpoint(
        existed.withColumn("start", start).withColumn("start", F.max("start").over(inside_block(_KEY, block, "seq", inclusive=True)))
    )
    former = block_carries(begun, _KEY, block, "start", "former")
    rows = begun.join(former, [*_KEY, block], "left").withColumn(
        "segment", F.coalesce(F.greatest("start", "former"), F.lit(-1).cast("bigint"))
    )
    columns = [*_KEY, "segment", "seq", "op", "body", "expected_hash", "overwrite", "existed"]
    opening = base.select(
        *_KEY,
        F.lit(-1).cast("bigint").alias("segment"),
        F.lit(-1).cast("bigint").alias("seq"),
        F.lit("base").alias("op"),
        F.col("content").alias("body"),
        F.lit("").alias("expected_hash"),
        F.lit(False).alias("overwrite"),
        F.lit(True).alias("existed"),
    )
    spread = (
        rows.select(*columns)
        .unionByName(opening)
        .repartition(*_KEY, "segment")
        .sortWithinPartitions(*_KEY, "segment", "seq")
    )
    # Used twice below; folded once.
    small_batches(spread.sparkSession)
    streamed = checkpoint(spread.mapInArrow(lean(_stream_segments), _SEGMENT_ROWS))
    steps = streamed.filter(F.col("kind") != "change").drop("segment")
    finals = (
        streamed.filter(F.col("kind") == "change")
        .groupBy(*_KEY)
        .agg(F.max_by(F.struct("content", "content_hash"), "segment").alias("last"))
        .select(
            *_KEY,
            F.lit("change").alias("kind"),
            F.lit(None).cast("bigint").alias("seq"),
            F.lit(S.OK).alias("status"),
            "last.content",
            "last.content_hash",
        )
    )
    return steps.unionByName(finals)


# -- batches ------------------------------------------------------------------


@dataclass(frozen=True)
class _Load:
    """Sizes of a batch, from one aggregation without command text."""

    keys: int
    moves: int
    deletes: int
    max_commands: int
    max_chars: int
    key_bytes: int

    @property
    def few_keys(self) -> bool:
        return self.keys + self.moves <= BROADCAST_ROWS and self.key_bytes <= BROADCAST_BYTES

    @staticmethod
    def of(accepted: DataFrame) -> tuple[DataFrame, "_Load"]:
        loads = accepted.groupBy(*_KEY).agg(
            F.count("*").alias("n"),
            F.sum(F.length("body")).alias("chars"),
            F.count_if(F.col("op") == "move").alias("moves"),
            F.count_if(F.col("op") == "delete").alias("deletes"),
            F.max(F.octet_length("vault") + F.octet_length("key") + (F.octet_length("dest") if "dest" in accepted.columns else F.lit(0))).alias("bytes"),
        )
        loads = checkpoint(loads)  # one row per note; read for the sums, the keys and the hot notes
        row = loads.agg(
            F.count("*"),
            F.coalesce(F.sum("moves"), F.lit(0)),
            F.coalesce(F.sum("deletes"), F.lit(0)),
            F.coalesce(F.max("n"), F.lit(0)),
            F.coalesce(F.max("chars"), F.lit(0)),
            F.coalesce(F.sum("bytes"), F.lit(0)),
        ).first()
        return loads, _Load(*row)


def _fold(
    accepted: DataFrame,
    base: DataFrame,
    loads: DataFrame,
    load: _Load,
    fold_commands: int,
    fold_chars: int,
    blocks: int,
) -> DataFrame:
    if load.max_commands > SOME_COMMANDS:
        # Touched notes are read once, however often their text is used below; a long note counts
        # for every command, as each step of the built-in fold copies it.
        base = checkpoint(base)
        sizes = base.select(*_KEY, F.length("content").alias("size"))
        loads = checkpoint(loads.join(sizes, _KEY, "left").withColumn("chars", F.col("chars") + F.col("n") * F.coalesce("size", F.lit(0))))
        most = loads.agg(F.coalesce(F.max("chars"), F.lit(0))).first()[0]
    else:
        most = load.max_chars
    if load.max_commands <= fold_commands and most <= fold_chars:
        return _fold_collected(accepted, base)
    is_hot = (F.col("n") > fold_commands) | (F.col("chars") > fold_chars)
    hot = broadcast_if_small(loads.filter(is_hot).select(*_KEY))
    cold = _fold_collected(
        accepted.join(hot, _KEY, "left_anti"), base.join(hot, _KEY, "left_anti")
    )
    return cold.unionByName(
        _fold_hot(accepted.join(hot, _KEY, "left_semi"), base.join(hot, _KEY, "left_semi"), blocks)
    )


def trash_name(vault: str, path: str, seq: int) -> str:
    """The trash path with a suffix derived from note and command, as :func:`_place_in_trash` makes it."""
    base = path.rsplit("/", 1)[-1]
    dot = base.rfind(".")
    stem, extension = (base[:dot], base[dot:]) if dot > 0 else (base, "")
    mark = hashlib.sha256("\n".join((vault, path, str(seq))).encode()).hexdigest()[:32]
    return f"{TRASH_FOLDER}/{stem}-{mark}{extension}"


def _place_in_trash(outcome: DataFrame, trash: DataFrame | None, few_keys: bool) -> DataFrame:
    """Give deleted notes their trash path and report it in the results.

    The first delete of a file name in a vault keeps the name unless the trash
    holds it already; the others get a suffix derived from note and command.
    There are no more first deletes than touched notes, so a batch of few notes
    broadcasts them.  A result without a digest and without an error is a delete.
    """
    # Change rows have no command number; numbers of their own keep them spread.
    outcome = outcome.withColumn(
        "deleted",
        (F.col("kind") == "result")
        & (F.col("status") == S.OK)
        & F.col("content_hash").isNull(),
    ).withColumn(
        "number", F.coalesce("seq", -1 - F.pmod(F.xxhash64("key"), F.lit(1 << 40)))
    )
    binned = outcome.filter(F.col("kind") == "trash")
    first = (
        binned.groupBy("vault", paths.base_name(F.col("key")).alias("base"))
        .agg(F.min("seq").alias("seq"))
        .withColumn("target", F.concat(F.lit(TRASH_FOLDER + "/"), "base"))
    )
    if trash is not None:
        taken = trash.select("vault", F.col("path").alias("target"))
        first = first.join(taken, ["vault", "target"], "left_anti")
    plain = first.select("vault", F.col("seq").alias("number"), F.lit(True).alias("plain"))
    plain = F.broadcast(plain) if few_keys else plain
    base = paths.base_name(F.col("key"))
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*\z", "")
    extension = F.regexp_extract(base, r"(?<=.)(\.[^.]*)\z", 1)
    mark = F.sha2(F.concat_ws("\n", "vault", "key", F.col("seq").cast("string")), 256)
    target = F.concat(
        F.lit(TRASH_FOLDER + "/"),
        F.when(F.col("plain"), base).otherwise(
            F.concat(stem, F.lit("-"), F.substring(mark, 1, 32), extension)
        ),
    )
    deletes = F.col("deleted")
    return (
        outcome.join(plain, ["vault", "number"], "left")
        .withColumn(
            "path",
            F.when((F.col("kind") == "trash") | deletes, target).otherwise(F.col("key")),
        )
        .withColumn("deleted_from", F.when(F.col("kind") == "trash", F.col("key")))
    )


def _shape(outcome: DataFrame) -> DataFrame:
    return outcome.select(
        "kind", "seq", "vault", "path", "status", "content", "content_hash", "deleted_from"
    )


def _finish(
    steps: DataFrame, judged: DataFrame, trash: DataFrame | None, load: _Load, few_keys: bool
) -> DataFrame:
    rejected = judged.filter(F.col("status") != S.OK).select(
        F.lit("result").alias("kind"),
        "seq",
        "vault",
        F.col("key").alias("path"),
        "status",
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("string").alias("deleted_from"),
    )
    if load.deletes:
        named = _place_in_trash(steps, trash, few_keys)
    else:
        named = steps.withColumn("path", F.col("key")).withColumn(
            "deleted_from", F.lit(None).cast("string")
        )
    return _shape(named).unionByName(rejected)


def apply_commands(
    notes: DataFrame,
    trash: DataFrame | None,
    vaults: DataFrame,
    commands: DataFrame,
    *,
    fold_commands: int = FOLD_COMMANDS,
    fold_chars: int = FOLD_CHARS,
    blocks: int = RANK_BLOCKS,
    few_links: int = FEW_EDGES,
) -> Applied:
    """Apply a batch of mixed commands in ``seq`` order.

    Every command gets one result; failed ones change nothing.  Notes that moves tie together
    are one group, whose commands are carried out one after the other in one task as long as the
    group has at most ``fold_chars`` characters of text; larger groups go by layers.
    """
    # The rules for paths are looked at once per command, however often the commands are read below.
    judged = checkpoint(judged_commands(commands, vaults))
    accepted = judged.filter(F.col("status") == S.OK).drop("status")
    loads, load = _Load.of(accepted)
    few_keys = load.few_keys
    limits = (fold_commands, fold_chars, blocks)
    if load.moves:
        steps = _apply_with_moves(notes, accepted, load, few_keys, limits, few_links)
    else:
        base = base_notes(notes, loads.select(*_KEY), few_keys)
        steps = checkpoint(_fold(accepted.drop("dest"), base, loads, load, *limits))
    outcome = _finish(steps, judged, trash, load, few_keys)
    return Applied(notes, trash, outcome, few_keys)


# -- moves --------------------------------------------------------------------

_LINKED_ROWS = "vault string, key string, kind string, seq bigint, status string, content string, content_hash string"


def verdict(c, note: NoteText | None, taken: bool = False) -> str:
    """The status of one command on the note that its path names; ``taken`` is about the target of a move."""
    if c.op == "create":
        return S.EXISTS if note and not c.overwrite else S.OK
    if c.op == "append_daily":
        return S.OK
    if note is None:
        return S.NOT_FOUND
    if c.op == "update" and c.expected_hash and note.digest() != c.expected_hash:
        return S.HASH_MISMATCH
    if c.op == "move":
        if c.dest_rule != S.OK:
            return c.dest_rule
        return S.EXISTS if taken and not c.overwrite else S.OK
    return S.OK


def _stream_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carry out the commands of groups that arrive sorted; the texts of one group are held at a time."""
    out = _Out(_LINKED_ROWS)
    group, texts, touched = None, {}, set()

    def close() -> Iterator[pa.RecordBatch]:
        for key in sorted(touched):
            note = texts.get(key)
            out.add(group[0], key, "change", None, S.OK, note and note.value(), note and note.digest())
            if out.full():
                yield out.take()

    for c in _rows(batches):
        if (c.vault, c.root) != group:
            yield from close()
            group, texts, touched = (c.vault, c.root), {}, set()
        if out.full():
            yield out.take()
        if c.op == "base":
            texts[c.key] = NoteText(c.body)
            continue
        note, at, digest = texts.get(c.key), c.key, None
        status = verdict(c, note, c.op == "move" and c.dest_key in texts)
        if status == S.OK:
            if c.op == "delete":
                out.add(c.vault, c.key, "trash", c.seq, status, note.value(), note.digest())
                del texts[c.key]
            elif c.op == "move":
                at = c.dest_key
                texts[at] = texts.pop(c.key)
            elif c.op in ("create", "update"):
                texts[c.key] = NoteText(c.body)
            else:
                texts.setdefault(c.key, NoteText("")).add(c.body)
            if c.key != at or c.op != "move":
                touched |= {c.key, at}
            digest = texts[at].digest() if at in texts else None
        out.add(c.vault, at, "result", c.seq, status, None, digest)
    if group is not None:
        yield from close()
    yield out.take()


def _apply_with_moves(
    notes: DataFrame, accepted: DataFrame, load: "_Load", few_keys: bool, limits: tuple[int, int, int], few_links: int
) -> DataFrame:
    """Batches with moves: groups of tied notes are found first, then each group's commands run in order.

    However long a chain of moves is, it is one group.  Commands of notes that no move touches are folded
    as ever; groups with more text than one task may hold go by layers.
    """
    dest_rule = paths.path_status(F.col("dest"))
    pending = checkpoint(
        accepted.withColumn("dest_rule", F.when(F.col("op") == "move", dest_rule)).withColumn(
            "dest_key", F.when(F.col("dest_rule") == S.OK, paths.normalize_path(F.col("dest")))
        )
    )
    moves = pending.filter(F.col("op") == "move")
    edges = moves.select("vault", F.col("key").alias("a"), F.coalesce("dest_key", "key").alias("b"))
    tied = groups(edges, load.moves, few_links)
    placed = checkpoint(pending.join(broadcast_if_small(tied), _KEY, "left"))
    # All notes that the batch can need, read once.
    keys = placed.select(*_KEY).unionByName(tied.select(*_KEY)).distinct()
    base = checkpoint(base_notes(notes, keys, few_keys).join(broadcast_if_small(tied), _KEY, "left"))
    sizes = (
        placed.select("vault", "root", F.length("body").alias("chars"))
        .unionByName(base.select("vault", "root", F.length("content").alias("chars")))
        .filter(F.col("root").isNotNull())
        .groupBy("vault", "root")
        .agg(F.sum("chars").alias("chars"))
    )
    large = checkpoint(sizes.filter(F.col("chars") > limits[1]).select("vault", "root"))
    steps = []
    if large.isEmpty():
        small, small_base = placed, base
    else:
        small, small_base = (df.join(large, ["vault", "root"], "left_anti") for df in (placed, base))
        here = placed.join(large, ["vault", "root"], "left_semi")
        texts = base.join(large, ["vault", "root"], "left_semi").select("vault", F.col("key").alias("path"), "content")
        steps.append(_apply_in_layers(texts, here.drop("root"), limits).select(_STEP_COLUMNS))
    is_tied = F.col("root").isNotNull()
    columns = ["vault", "root", "seq", "op", "key", "dest_key", "dest_rule", "body", "expected_hash", "overwrite"]
    nothing = F.lit(None).cast("string")
    opening = small_base.filter(is_tied).select(
        "vault", "root", F.lit(-1).cast("bigint").alias("seq"), F.lit("base").alias("op"), "key", nothing.alias("dest_key"),
        nothing.alias("dest_rule"), F.col("content").alias("body"), nothing.alias("expected_hash"), F.lit(False).alias("overwrite"),
    )
    ordered = (
        small.filter(is_tied).select(columns).unionByName(opening)
        .repartition("vault", "root")
        .sortWithinPartitions("vault", "root", "seq")
    )
    small_batches(ordered.sparkSession)
    steps.append(checkpoint(ordered.mapInArrow(lean(_stream_groups), _LINKED_ROWS)).select(_STEP_COLUMNS))
    free = small.filter(~is_tied).select("seq", "vault", "op", "key", "body", "expected_hash", "overwrite")
    loads, rest = _Load.of(free)
    if rest.keys:
        folded = _fold(free, small_base.filter(~is_tied).select(*_KEY, "content"), loads, rest, *limits)
        steps.append(checkpoint(folded.select(_STEP_COLUMNS)))
    done = steps[0]
    for more in steps[1:]:
        done = done.unionByName(more)
    return done


def _overlay(notes: DataFrame, changes: DataFrame | None, keys: DataFrame, few_keys: bool) -> DataFrame:
    """Current text of ``keys`` after the layers applied so far."""
    stored = base_notes(notes, keys, few_keys)
    if changes is None:
        return stored
    stored = stored.join(changes.select(*_KEY), _KEY, "left_anti")
    fresh = changes.filter(F.col("content").isNotNull()).join(keys, _KEY, "left_semi")
    return stored.unionByName(fresh.select(*_KEY, "content"))


def _move_layer(moves: DataFrame, current: DataFrame) -> DataFrame:
    """Moves that share no note, judged and carried out at once."""
    source = current.select("vault", "key", F.col("content").alias("text"))
    target = current.select("vault", F.col("key").alias("dest_key"), F.lit(True).alias("taken"))
    status = (
        F.when(F.col("text").isNull(), S.NOT_FOUND)
        .when(F.col("dest_rule") != S.OK, F.col("dest_rule"))
        .when(F.col("taken") & ~F.col("overwrite"), S.EXISTS)
        .otherwise(S.OK)
    )
    judged = (
        moves.join(source, _KEY, "left")
        .join(target, ["vault", "dest_key"], "left")
        .withColumn("status", status)
    )
    ok = F.col("status") == S.OK
    nothing = F.lit(None).cast("string")

    def row(kind: str, key: Column, content: Column, digest: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            key.alias("key"),
            F.when(F.lit(kind) == "result", F.col("seq")).alias("seq"),
            F.col("status").alias("status"),
            content.alias("content"),
            digest.alias("content_hash"),
        )

    digest = F.when(ok, text.content_hash(F.col("text")))
    result = row("result", F.when(ok, F.col("dest_key")).otherwise(F.col("key")), nothing, digest)
    arrival = row("change", F.col("dest_key"), F.col("text"), digest)
    departure = row("change", F.col("key"), nothing, nothing)
    rows = (
        F.when(~ok, F.array(result))
        .when(F.col("key") == F.col("dest_key"), F.array(result))
        .otherwise(F.array(result, arrival, departure))
    )
    return judged.select("vault", F.inline(rows))


_STEP_COLUMNS = ["vault", "key", "kind", "seq", "status", "content", "content_hash"]


def _apply_in_layers(notes: DataFrame, pending: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """Groups of tied notes too large for one task.

    A layer folds, for every note, all commands before the first pending move
    that touches it, and then carries out every move that is the first one at
    both its ends.  The number of layers is the longest chain of moves through
    shared notes, not the number of moves.  ``notes`` are those of the groups.
    """
    few_keys = False
    done: DataFrame | None = None
    changes: DataFrame | None = None
    while not pending.isEmpty():
        moves = pending.filter(F.col("op") == "move")
        ends = F.array_compact(F.array("key", "dest_key"))
        first = (
            moves.select("vault", F.explode(ends).alias("key"), "seq")
            .groupBy(*_KEY)
            .agg(F.min("seq").alias("first"))
        )
        first = broadcast_if_small(first)
        at_dest = first.select(
            "vault", F.col("key").alias("dest_key"), F.col("first").alias("first_at_dest")
        )
        placed = pending.join(first, _KEY, "left").join(
            broadcast_if_small(at_dest), ["vault", "dest_key"], "left"
        )
        is_move = F.col("op") == "move"
        ready = F.when(
            is_move,
            (F.col("seq") == F.col("first"))
            & (F.col("dest_key").isNull() | (F.col("seq") == F.col("first_at_dest"))),
        ).otherwise(F.col("first").isNull() | (F.col("seq") < F.col("first")))
        placed = placed.withColumn("ready", ready).drop("first", "first_at_dest")
        now = placed.filter("ready")

        plain = now.filter(~is_move).select(
            "seq", "vault", "op", "key", "body", "expected_hash", "overwrite"
        )
        loads, load = _Load.of(plain)
        layer = []
        if load.keys:
            base = _overlay(notes, changes, loads.select(*_KEY), few_keys)
            folded = checkpoint(_fold(plain, base, loads, load, *limits).select(_STEP_COLUMNS))
            layer.append(folded)
            changes = _newest(changes, folded)
        ready_moves = now.filter(is_move)
        touched = ready_moves.select("vault", F.explode(ends).alias("key")).distinct()
        current = _overlay(notes, changes, touched, few_keys)
        moved = checkpoint(_move_layer(ready_moves, current).select(_STEP_COLUMNS))
        layer.append(moved)
        changes = checkpoint(_newest(changes, moved))
        for part in layer:
            steps = part.filter(F.col("kind") != "change")
            done = steps if done is None else done.unionByName(steps)
        pending = checkpoint(placed.filter("NOT ready").drop("ready"))
    return done.unionByName(changes.select(_STEP_COLUMNS))


def _newest(changes: DataFrame | None, layer: DataFrame) -> DataFrame:
    fresh = layer.filter(F.col("kind") == "change")
    if changes is None:
        return fresh
    return changes.join(fresh.select(*_KEY), _KEY, "left_anti").unionByName(fresh)


# -- one operation at a time --------------------------------------------------


def _only(op: str, commands: DataFrame) -> DataFrame:
    given = set(commands.columns)
    return commands.select(
        *[
            F.lit(op).alias("op")
            if f.name == "op"
            else (F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name))
            for f in S.COMMANDS.fields
        ]
    )


def create_notes(notes: DataFrame, vaults: DataFrame, commands: DataFrame) -> Applied:
    """Insert; an existing note is an error unless ``overwrite``."""
    return apply_commands(notes, None, vaults, _only("create", commands))


def update_notes(notes: DataFrame, vaults: DataFrame, commands: DataFrame) -> Applied:
    """Replace the text; a given ``expected_hash`` must be the current one."""
    return apply_commands(notes, None, vaults, _only("update", commands))


def append_notes(notes: DataFrame, vaults: DataFrame, commands: DataFrame) -> Applied:
    """Concatenate to existing notes, with nothing in between."""
    return apply_commands(notes, None, vaults, _only("append", commands))


def move_notes(notes: DataFrame, vaults: DataFrame, commands: DataFrame) -> Applied:
    """Rename ``path`` to ``dest``; a taken target is an error unless ``overwrite``."""
    return apply_commands(notes, None, vaults, _only("move", commands))


def delete_notes(
    notes: DataFrame, trash: DataFrame | None, vaults: DataFrame, commands: DataFrame
) -> Applied:
    """Move notes to the vault's flat trash."""
    return apply_commands(notes, trash, vaults, _only("delete", commands))


def daily_commands(vaults: DataFrame, entries: DataFrame) -> DataFrame:
    """Dated entries ``(seq, vault, day, body)`` as ``append_daily`` commands."""
    settings = vaults.select(
        F.col("name").alias("vault"),
        F.col("daily_notes.directory").alias("directory"),
        F.col("daily_notes.date_format").alias("date_format"),
    )
    placed = entries.join(broadcast_if_small(settings), "vault", "left").withColumn(
        "path", paths.daily_path(F.col("directory"), F.col("date_format"), F.col("day"))
    )
    return _only("append_daily", placed)


def append_daily_notes(notes: DataFrame, vaults: DataFrame, entries: DataFrame) -> Applied:
    """Create or extend each vault's note of the entry's day."""
    return apply_commands(notes, None, vaults, daily_commands(vaults, entries))


def daily_notes_from_events(events: DataFrame, vaults: DataFrame) -> DataFrame:
    """Daily notes built from dated entries ``(seq, vault, day, body)`` alone."""
    placed = daily_commands(vaults, events).filter(F.col("path").isNotNull())
    return (
        placed.groupBy("vault", "path")
        .agg(F.expr("listagg(body, '') WITHIN GROUP (ORDER BY seq)").alias("content"))
        .withColumn("content_hash", text.content_hash(F.col("content")))
    )


def first_writer_wins(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """Status of racing updates ``(seq, vault, path, expected_hash)``.

    An update without expected hash (NULL or empty) always succeeds.  Of those that expect the
    current hash the lowest ``seq`` wins, unless an unconditional one came before.  A
    missing note is ``NOT_FOUND``.  The first success comes from a pre-aggregated
    minimum, so a note with very many writers is not gathered anywhere.
    """
    keys = broadcast_if_small(updates.select("vault", "path").distinct())
    current = notes.select("vault", "path", F.col("content_hash").alias("now")).join(keys, ["vault", "path"])
    asked = updates.select("seq", "vault", "path", F.coalesce("expected_hash", F.lit("")).alias("expected"))
    free = F.col("expected") == ""
    first = (
        asked.groupBy("vault", "path", F.when(~free, F.col("expected")).alias("expected"))
        .agg(F.min("seq").alias("seq"))
        .join(current, ["vault", "path"])
        .groupBy("vault", "path")
        .agg(F.min(F.when(F.col("expected").isNull() | (F.col("expected") == F.col("now")), F.col("seq"))).alias("first"))
        .withColumn("found", F.lit(True))
    )
    return asked.join(broadcast_if_small(first), ["vault", "path"], "left").select(
        "seq", "vault", "path",
        F.when(F.col("found").isNull(), S.NOT_FOUND)
        .when(free | (F.col("seq") == F.col("first")), S.OK)
        .otherwise(S.HASH_MISMATCH)
        .alias("status"),
    )
