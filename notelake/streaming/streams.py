"""Structured Streaming forms: command streams, dated entries, running tag counts.

What a stream has to remember of a note, a day or a note's tags is Spark's own keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from .. import schema as S
from ..functions import frontmatter as fm, paths, text
from ..operators.commands import (
    NoteText, apply_commands, daily_commands, judged_commands, merge_changes, trash_name, verdict, writable_commands,
)
from ..operators.corpus import markdown_only, visible_notes
from ..operators.tags import note_tags
from ..sources.tables import NoteStore

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = (
    "kind string, seq bigint, vault string, path string, status string, "
    "content string, content_hash string, deleted_from string, version bigint"
)
_OutcomeRow = Row(*[c.split()[0] for c in OUTCOME.split(", ")])
_TagRow = Row("vault", "tag", "n")


def _with_state(spark: SparkSession) -> None:
    """Keyed state needs the store on disk, whatever the session was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _in_order(row: Row) -> tuple[bool, int]:
    """Sort key of ``seq``; rows without one come last."""
    return row.seq is None, row.seq or 0


class _Commands(StatefulProcessor):
    """The text of one note, and how often it changed."""

    def init(self, handle) -> None:
        self.note = handle.getValueState("note", "content string, version bigint")
        self.begun = None

    def handleInitialState(self, key, initial: Row, timers) -> None:
        # Of rows of one note, which come one after the other, the first counts.
        if key != self.begun:
            self.begun = key
            self.note.update((initial.content, 0))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        vault, path = key
        content, version = self.note.get() or (None, 0)
        note, changed = None if content is None else NoteText(content), False
        for c in sorted(rows, key=_in_order):
            if c.status != S.OK or c.op == "move":
                yield _OutcomeRow("result", c.seq, vault, path, c.status if c.status != S.OK else S.UNKNOWN_OP, None, None, None, None)
                continue
            status, at = verdict(c, note), path
            if status == S.OK:
                changed = True
                if c.op == "delete":
                    at = trash_name(vault, path, c.seq)
                    yield _OutcomeRow("trash", c.seq, vault, at, status, note.value(), note.digest(), path, None)
                    note = None
                elif c.op in ("create", "update"):
                    note = NoteText(c.body)
                else:
                    note = note or NoteText("")
                    note.add(c.body)
            digest = note.digest() if note is not None and status == S.OK else None
            yield _OutcomeRow("result", c.seq, vault, at, status, None, digest, None, None)
        if changed:
            version += 1
            value = None if note is None else note.value()
            self.note.update((value, version))
            yield _OutcomeRow("change", None, vault, path, S.OK, value, None if note is None else note.digest(), None, version)

    def close(self) -> None:
        pass


def stream_commands(commands: DataFrame, notes: DataFrame, vaults: DataFrame) -> DataFrame:
    """The outcome of a stream of commands on ``notes``, one result a command.

    Each note's text is keyed state that starts as in ``notes``.  The commands of a note in one micro-batch are
    carried out in ``seq`` order, those of later batches after them.  Rows are those of a batch's
    outcome (``kind`` result, change or trash) with a ``version`` that counts a note's changes; append
    them to plain files, whose sink writes every batch once, and see :func:`current_notes`.
    Deleted notes always get a name with a suffix, as no note knows of the others' trash.
    Moves tie notes together and are ``UNKNOWN_OP`` here; :func:`stream_batches` takes them.
    """
    _with_state(commands.sparkSession)
    judged = judged_commands(commands, vaults).drop("dest")
    # Rows without a path are refused; they need a key all the same.
    keyed = judged.withColumn("key", F.coalesce("key", F.lit(""))).withColumn("vault", F.coalesce("vault", F.lit("")))
    start = notes.select("vault", F.col("path").alias("key"), "content")
    # Rows, not frames: most notes have a row or two, and a frame each costs far more than their work.
    return keyed.groupBy("vault", "key").transformWithState(
        _Commands(), outputStructType=OUTCOME, outputMode="Append", timeMode="None", initialState=start.groupBy("vault", "key")
    )


def current_notes(notes: DataFrame, outcome: DataFrame) -> DataFrame:
    """``notes`` as the stored ``outcome`` of a command stream leaves them."""
    newest = (
        outcome.filter(F.col("kind") == "change")
        .groupBy("vault", "path")
        .agg(F.max_by(F.struct("content", "content_hash"), "version").alias("last"))
        .select("vault", "path", "last.content", "last.content_hash", F.col("last.content").isNull().alias("deleted"))
    )
    return merge_changes(notes, newest)


def stream_batches(commands: DataFrame, store: NoteStore, vaults: DataFrame, **limits) -> DataStreamWriter:
    """Apply a stream of commands, moves too, to a stored note table, batch by batch.

    Each micro-batch is applied in ``seq`` order to the notes before it and stored under
    the next free number of the store, which is kept with the query's id and the batch's
    number: only a replay of the same batch of the same query gets that number again and
    replaces its outcome.  The caller adds trigger and checkpoint location and starts the writer.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        here = NoteStore(batch.sparkSession, store.path)
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        number = here.claim(f"{query}-{batch_id}")
        if here.folded(number):
            return  # a replay of what a snapshot holds already
        batch.persist()
        try:
            applied = apply_commands(
                here.notes(before=number), here.trash(before=number), vaults, batch, **limits
            )
            here.append(applied, number)
        finally:
            batch.unpersist()

    return commands.writeStream.foreachBatch(apply)


class _Day(StatefulProcessor):
    """The entries of one daily note in order, behind a text that is settled."""

    def __init__(self, settle: int) -> None:
        self.settle = settle

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "seq bigint, body string")
        self.text = handle.getValueState("text", "content string, version bigint")

    def _held(self) -> tuple[str, int]:
        return self.text.get() if self.text.exists() else ("", 0)

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.text.update((initial["content"].iloc[0], 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        vault, path = key
        batch = pd.concat(list(rows))
        self.entries.appendList([(int(seq), body) for seq, body in zip(batch["seq"], batch["body"])])
        settled, version = self._held()
        self.text.update((settled, version + 1))
        whole = settled + "".join(body for _, body in sorted(self.entries.get()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["arrived"].max().timestamp() * 1000) + self.settle)
        yield pd.DataFrame({"vault": [vault], "path": [path], "content": [whole], "version": [version + 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled, version = self._held()
        self.text.update((settled + "".join(body for _, body in sorted(self.entries.get())), version))
        self.entries.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_daily_notes(
    entries: DataFrame, vaults: DataFrame, notes: DataFrame | None = None, settle_seconds: int = 30 * 86_400, slack: str = "1 day"
) -> DataFrame:
    """Daily notes ``(vault, path, content, content_hash, version)`` of dated entries ``(seq, vault, day, body)``.

    Every micro-batch gives the notes it touched anew, so an entry of a day long past corrects that day's row; the
    highest ``version`` counts.  Entries are ordered by ``seq``, behind what ``notes`` has of the day.  Entries
    of unknown or read-only vaults and of no day are left out.  A day without entries for ``settle_seconds``
    is settled: its entries become one text, to which later ones are appended.  Write in update or append mode.

    The time of a timer is that of arrival, as the batches' clock has it, less ``slack``, by which that clock may
    be set back; no entry is ever too late for its day.
    """
    _with_state(entries.sparkSession)
    placed = writable_commands(daily_commands(vaults, entries), vaults).filter(F.col("status") == S.OK)
    rows = placed.select("vault", "path", "seq", F.coalesce("body", F.lit("")).alias("body"), F.current_timestamp().alias("arrived"))
    rows = rows.withWatermark("arrived", slack)
    start = None if notes is None else notes.select("vault", "path", "content").groupBy("vault", "path")
    days = rows.groupBy("vault", "path").transformWithStateInPandas(
        _Day(settle_seconds * 1000), outputStructType="vault string, path string, content string, version bigint",
        outputMode="Update", timeMode="EventTime", initialState=start,
    )
    return days.withColumn("content_hash", text.content_hash(F.col("content")))


def windowed_daily_notes(
    entries: DataFrame, vaults: DataFrame, watermark: str = "1 day"
) -> DataFrame:
    """Daily notes of ``(seq, vault, ts, body)`` with bounded state.

    A day is emitted once, in append mode, when the watermark has passed it;
    entries later than that are dropped, unlike in :func:`stream_daily_notes`.
    """
    settings = vaults.select(
        F.col("name").alias("vault"),
        F.col("daily_notes.directory").alias("directory"),
        F.col("daily_notes.date_format").alias("date_format"),
    )
    day = F.to_date(F.col("w.start"))
    return (
        entries.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "vault")
        .agg(F.expr("listagg(body, '') WITHIN GROUP (ORDER BY seq)").alias("content"))
        .join(settings, "vault")
        .select(
            "vault",
            paths.daily_path(F.col("directory"), F.col("date_format"), day).alias("path"),
            "content",
            text.content_hash(F.col("content")).alias("content_hash"),
        )
    )


class _Tags(StatefulProcessor):
    """The last tags of one note."""

    def init(self, handle) -> None:
        self.tags = handle.getValueState("tags", "tags array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        newest = None
        for row in rows:
            if newest is None or _in_order(row) >= _in_order(newest):
                newest = row
        held = self.tags.get()
        former, now = list(held[0]) if held else [], newest.tags or []
        if held is None or now != former:
            self.tags.update((now,))
        counts: dict[str, int] = {}
        for tag, n in [(t, 1) for t in now] + [(t, -1) for t in former]:
            counts[tag] = counts.get(tag, 0) + n
        for tag, n in counts.items():
            if n:
                yield _TagRow(key[0], tag, n)

    def close(self) -> None:
        pass


def stream_tag_counts(notes: DataFrame) -> DataFrame:
    """Tag counts kept current; write in update or complete mode.

    A row replaces what came before of its note; one with null ``content`` deletes it.  The last tags of each
    note are keyed state, so what an edit or a delete takes away is known.  Of rows of one note in one
    micro-batch the one with the highest ``seq`` counts, if there is such a column.  Rows that
    carry the note's former text in ``prior_content`` need no state.
    """
    if "prior_content" in notes.columns:
        weighted = note_tags(notes.filter(F.col("content").isNotNull())).withColumn("n", F.lit(1))
        former = notes.filter(F.col("prior_content").isNotNull()).withColumn("content", F.col("prior_content"))
        weighted = weighted.unionByName(note_tags(former).withColumn("n", F.lit(-1)))
        return weighted.groupBy("vault", "tag").agg(F.sum("n").alias("count"))
    _with_state(notes.sparkSession)
    found = F.concat(fm.frontmatter_tags("content"), text.hashtags(F.col("content")))
    rows = markdown_only(visible_notes(notes)).select(
        "vault", "path", (F.col("seq") if "seq" in notes.columns else F.lit(0)).cast("bigint").alias("seq"),
        F.when(F.col("content").isNotNull(), found).alias("tags"),
    )
    changes = rows.groupBy("vault", "path").transformWithState(
        _Tags(), outputStructType="vault string, tag string, n bigint", outputMode="Append", timeMode="None"
    )
    return changes.groupBy("vault", "tag").agg(F.sum("n").alias("count"))
