"""Property updates: merge new values into the block in front of a note."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions import frontmatter as fm, paths, text
from .checkpoints import checkpoint
from .commands import FOLD_COMMANDS, Applied, base_notes, writable_commands
from .common import BROADCAST_BYTES, BROADCAST_ROWS, RANK_BLOCKS, broadcast_if_small, rank_blocks

UNREADABLE = "UNREADABLE_FRONTMATTER"
_KEY = ["vault", "key"]
_ENTRIES = "array<struct<k:string,y:string>>"
_STATE = f"struct<entries:{_ENTRIES},log:string>"  # one line of log per command
_PACKED = "vault string, key string, block bigint, entries string"


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turn each block's entries into what the blocks before it leave behind."""
    group, held = None, {}
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if (r.vault, r.key) != group:
                group, held = (r.vault, r.key), {}
            rows.append(json.dumps([{"k": k, "y": y} for k, y in held.items()]))
            held.update((e["k"], e["y"]) for e in json.loads(r.entries))
        yield batch.assign(entries=rows)


def _carried(accepted: DataFrame) -> DataFrame:
    """Entries set before each block of a note, without gathering its commands.

    Within a block only the last value and first mention of every property are
    kept; the pass over blocks sees one such row per block.
    """
    mentions = accepted.select(
        *_KEY, "block", "seq", F.posexplode("entries").alias("pos", "e")
    ).select(*_KEY, "block", F.struct("seq", "pos").alias("at"), "e.k", "e.y")
    packed = (
        mentions.groupBy(*_KEY, "block", "k")
        .agg(F.min("at").alias("first"), F.max_by("y", "at").alias("y"))
        .groupBy(*_KEY, "block")
        .agg(F.array_sort(F.collect_list(F.struct("first", "k", "y"))).alias("all"))
        .select(
            *_KEY,
            "block",
            F.to_json(
                F.transform("all", lambda e: F.struct(e["k"].alias("k"), e["y"].alias("y")))
            ).alias("entries"),
        )
    )
    return (
        packed.repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "block")
        .mapInPandas(_carry, _PACKED)
        .select(*_KEY, "block", F.from_json("entries", _ENTRIES).alias("carried"))
    )


def update_frontmatter(
    notes: DataFrame,
    vaults: DataFrame,
    commands: DataFrame,
    *,
    fold_commands: int = FOLD_COMMANDS,
    blocks: int = RANK_BLOCKS,
) -> Applied:
    """Merge ``properties`` of ``commands(seq, vault, path, properties)`` into notes.

    ``properties`` is an array of ``struct<k, v>`` with ``v`` as JSON text.  The
    body is kept; values are written back as JSON, which is flow YAML.  Entries that
    can't be read are carried over as they stand, unless an update names their key; a note whose block
    never ends is left alone.  A note with very many updates is cut into blocks by rank
    that start from what earlier blocks left.
    """
    judged = writable_commands(commands.withColumn("op", F.lit("update")), vaults).select(
        "seq",
        "vault",
        F.when(F.col("status") == S.OK, paths.normalize_path(F.col("path")))
        .otherwise(F.col("path"))
        .alias("key"),
        F.transform(
            F.coalesce("properties", F.array().cast(S.COMMANDS["properties"].dataType)),
            lambda p: F.struct(p["k"].alias("k"), F.coalesce(p["v"], F.lit("null")).alias("y")),
        ).cast(_ENTRIES).alias("entries"),
        "status",
    )
    accepted = judged.filter(F.col("status") == S.OK).drop("status")
    loads = accepted.groupBy(*_KEY).agg(F.count("*").alias("n"))
    size = F.octet_length("vault") + F.octet_length("key")
    total, most, held = loads.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    few_keys = total <= BROADCAST_ROWS and held <= BROADCAST_BYTES
    is_last = F.lit(True)
    if most > fold_commands:
        hot = broadcast_if_small(loads.filter(F.col("n") > fold_commands).select(*_KEY))
        cut = rank_blocks(accepted.join(hot, _KEY, "left_semi"), _KEY, "seq", "block", blocks)
        rest = accepted.join(hot, _KEY, "left_anti").withColumn("block", F.lit(0).cast("bigint"))
        accepted = checkpoint(rest.unionByName(cut))
        last_blocks = accepted.groupBy(*_KEY).agg(F.max("block").alias("last_block"))
        is_last = F.col("block") == F.col("last_block")
    else:
        accepted = accepted.withColumn("block", F.lit(0).cast("bigint"))

    keys = loads.select(*_KEY)
    content = F.col("content")
    base = (
        base_notes(notes, keys, few_keys)
        .select(
            *_KEY,
            fm.kept_entries("content").cast(_ENTRIES).alias("base"),
            fm.frontmatter_body("content").alias("body"),
            fm.unclosed("content").alias("unreadable"),
        )
    )
    grouped = (
        accepted.groupBy(*_KEY, "block")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "entries"))).alias("commands"))
        .join(base, _KEY, "left")
    )
    start = F.col("base")
    if most > fold_commands:
        grouped = grouped.join(_carried(accepted), [*_KEY, "block"], "left")
        grouped = grouped.join(broadcast_if_small(last_blocks), _KEY)
        start = F.when(
            F.col("carried").isNull(), F.col("base")
        ).otherwise(fm.merge_entries(F.col("base"), F.col("carried")).cast(_ENTRIES))

    status = (
        F.when(F.col("body").isNull(), S.NOT_FOUND)
        .when(F.col("unreadable"), UNREADABLE)
        .otherwise(S.OK)
    )

    def step(state, c):
        return text.let(
            fm.merge_entries(state["entries"], c["entries"]),
            lambda merged: F.struct(
                merged.alias("entries"),
                F.concat(
                    state["log"],
                    text.content_hash(fm.render(merged, F.col("body"))),
                    F.lit("\n"),
                ).alias("log"),
            ),
        )

    nothing = F.lit(None).cast("string")
    merged = F.aggregate(
        "commands",
        F.struct(start.alias("entries"), F.lit("").alias("log")).cast(_STATE),
        step,
    )
    folded = grouped.withColumn("status", status).withColumn(
        "state", F.when(F.col("status") == S.OK, merged)
    )

    def row(kind, seq, content, digest):
        return F.struct(
            F.lit(kind).alias("kind"),
            seq.alias("seq"),
            content.alias("content"),
            digest.alias("content_hash"),
        )

    done = text.let(
        F.split("state.log", "\n"),
        lambda hashes: F.transform(
            "commands", lambda c, i: row("result", c["seq"], nothing, F.get(hashes, i))
        ),
    )
    failed = F.transform("commands", lambda c: row("result", c["seq"], nothing, nothing))
    last = text.let(
        fm.render(F.col("state.entries"), F.col("body")),
        lambda t: row("change", F.lit(None).cast("bigint"), t, text.content_hash(t)),
    )
    ok = F.col("status") == S.OK
    rows = checkpoint(
        folded.select(
            *_KEY,
            "block",
            "status",
            # Only the last block's text is the note's; the others give digests alone.
            F.inline(F.when(ok & is_last, F.concat(done, F.array(last))).when(ok, done).otherwise(failed)),
        )
    )
    results = rows.filter(F.col("kind") == "result")
    changes = rows.filter(F.col("kind") == "change")
    rejected = judged.filter(F.col("status") != S.OK).select(
        *_KEY,
        "status",
        F.lit("result").alias("kind"),
        "seq",
        nothing.alias("content"),
        nothing.alias("content_hash"),
    )
    outcome = (
        results.drop("block")
        .unionByName(changes.drop("block"))
        .unionByName(rejected)
        .select(
            "kind",
            "seq",
            "vault",
            F.col("key").alias("path"),
            "status",
            "content",
            "content_hash",
            nothing.alias("deleted_from"),
        )
    )
    return Applied(notes, None, outcome, few_keys)
