"""Filters, listings, look-ups and full-text search over all vaults at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import frontmatter as fm, paths, text
from .checkpoints import checkpoint
from .common import KeyFilter, broadcast_if_small, is_small, listing_key

SEARCH_LIMITS = (1, 100)  # Fixed values: bounds of a search limit.


def visible_notes(notes: DataFrame) -> DataFrame:
    return notes.filter(paths.is_visible(F.col("path")))


def markdown_only(notes: DataFrame) -> DataFrame:
    return notes.filter(paths.is_markdown(F.col("path")))


def in_directory(notes: DataFrame, directory: str = "") -> DataFrame:
    """Notes of a subtree; the prefix test reaches the Parquet scan."""
    prefix = _prefix(directory)
    return notes.filter(F.startswith("path", F.lit(prefix))) if prefix else notes


def _prefix(directory: str) -> str:
    parts = [p for p in directory.replace("\\", "/").split("/") if p]
    return "/".join(parts) + "/" if parts else ""


def directory_status(notes: DataFrame, vaults: DataFrame, directory: str = "") -> DataFrame:
    """``(vault, status)``: whether a directory may be named and exists."""
    names = vaults.select(F.col("name").alias("vault"))
    if not directory:
        return names.withColumn("status", F.lit(S.OK))
    found = (
        in_directory(visible_notes(notes), directory)
        .select("vault")
        .distinct()
        .withColumn("found", F.lit(True))
    )
    rule = paths.path_status(F.lit(directory), "directory")
    return names.join(found, "vault", "left").select(
        "vault",
        F.when(rule != S.OK, rule)
        .when(F.col("found").isNull(), S.NOT_FOUND)
        .otherwise(S.OK)
        .alias("status"),
    )


def path_status(requests: DataFrame) -> DataFrame:
    """Classify a ``(path, kind)`` table by the path rules."""
    return requests.withColumn("status", paths.path_status(F.col("path"), F.col("kind")))


def list_notes(
    notes: DataFrame, directory: str = "", collation: str | None = "UNICODE"
) -> DataFrame:
    """``(vault, path, content_hash)`` in listing order, without reading text."""
    kept = markdown_only(visible_notes(in_directory(notes, directory)))
    return kept.select("vault", "path", "content_hash").orderBy(
        "vault", listing_key("path", collation), "path"
    )


def list_directory(notes: DataFrame, directory: str = "") -> DataFrame:
    """Distinct immediate children ``(vault, path, type)`` of a directory."""
    prefix = _prefix(directory)
    kept = markdown_only(visible_notes(in_directory(notes, directory)))
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    return kept.select(
        "vault",
        F.concat(F.lit(prefix), F.substring_index(rest, "/", 1)).alias("path"),
        F.when(F.contains(rest, F.lit("/")), "directory").otherwise("file").alias("type"),
    ).distinct()


def read_notes(notes: DataFrame, vaults: DataFrame, requests: DataFrame) -> DataFrame:
    """Look up ``(vault, path)`` requests; every request gets a status.

    Only the distinct requested keys meet the corpus, so a repeated request does
    not copy text through the shuffle.  Few keys leave the corpus in place; of many a bitmap keeps
    all but the requested notes out of the shuffle.
    """
    asked = (
        requests.join(
            broadcast_if_small(vaults.select(F.col("name").alias("vault"), F.lit(True).alias("known"))),
            "vault",
            "left",
        )
        .withColumn("rule", paths.path_status(F.col("path")))
        .withColumn("key", paths.normalize_path(F.col("path")))
    )
    keys = (
        asked.filter(F.col("known") & (F.col("rule") == S.OK))
        .select("vault", F.col("key").alias("path"))
        .distinct()
    )
    held = notes.select("vault", "path", "content", "content_hash")
    if is_small(keys):
        held = held.join(F.broadcast(keys), ["vault", "path"])
    else:
        keys = checkpoint(keys)
        held = KeyFilter.of(keys, "vault", "path").possible(held).join(keys, ["vault", "path"])
    found = held.select(
        "vault", F.col("path").alias("key"), "content", "content_hash"
    )
    status = (
        F.when(F.col("known").isNull(), S.NOT_REGISTERED)
        .when(F.col("rule") != S.OK, F.col("rule"))
        .when(F.col("content").isNull(), S.NOT_FOUND)
        .otherwise(S.OK)
    )
    return asked.join(found, ["vault", "key"], "left").select(
        *[c for c in requests.columns if c != "path"],
        F.when(status == S.OK, F.col("key")).otherwise(F.col("path")).alias("path"),
        "content",
        "content_hash",
        status.alias("status"),
    )


def get_frontmatter(notes: DataFrame) -> DataFrame:
    """``(vault, path, frontmatter VARIANT, frontmatter_error)`` of every note."""
    content = F.col("content")
    return notes.select(
        "vault",
        "path",
        fm.frontmatter("content").alias("frontmatter"),
        fm.frontmatter_error("content").alias("frontmatter_error"),
    )


def _needle(query: str) -> str:
    return query.strip(text.WS_CHARS).lower()


def _has(value: Column, needle: str) -> Column:
    return F.contains(F.lower(value), F.lit(needle))


def match_kinds(query: str) -> Column:
    """Which of file name, content and property text hold the query, in order."""
    q = _needle(query)
    kinds = [
        F.when(_has(F.col("path"), q), "filename"),
        F.when(_has(F.col("content"), q), "content"),
        F.when(_has(fm.frontmatter_text("content"), q), "frontmatter"),
    ]
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def _hits(notes: DataFrame, query: str, *columns: str) -> DataFrame:
    """``columns`` and ``kinds`` of the matching notes.

    The rows come out of a generator, so the property parser stands in the plan once: a filter over
    the kinds would be pushed below them and evaluate it again.  Joined text is only built for a
    query with a line break, which may match across two parts.
    """
    q = _needle(query)
    if not q:
        return notes.filter(F.lit(False)).select(*columns, F.array().cast("array<string>").alias("kinds"))
    if "\n" in q:
        whole = F.concat_ws("\n", "path", "content", fm.frontmatter_text("content"))
        hit = F.struct(match_kinds(query).alias("kinds"), _has(whole, q).alias("hit"))
    else:
        hit = text.let(match_kinds(query), lambda kinds: F.struct(kinds.alias("kinds"), (F.size(kinds) > 0).alias("hit")))
    rows = F.filter(F.array(hit), lambda h: h["hit"])
    return notes.select(*columns, F.inline(rows)).drop("hit")


def match_notes(notes: DataFrame, query: str) -> DataFrame:
    """Notes whose path, text or property text contain the query, any case."""
    return _hits(notes, query, *notes.columns).drop("kinds")


def search_notes(
    notes: DataFrame,
    query: str,
    limit: int = 20,
    directory: str = "",
    collation: str | None = "UNICODE",
) -> DataFrame:
    """First ``limit`` matches of every vault in listing order.

    ``(vault, rank, path, excerpt, matches)``.  Only names and kinds are ranked; excerpts are
    made of the winners' text.
    """
    n = text.clamp(limit, *SEARCH_LIMITS)
    kept = markdown_only(visible_notes(in_directory(notes, directory)))
    order = Window.partitionBy("vault").orderBy(listing_key("path", collation), "path")
    ranked = (
        _hits(kept, query, "vault", "path")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
    # At most ``limit`` rows of each vault.
    winners = broadcast_if_small(checkpoint(ranked))
    return kept.select("vault", "path", "content").join(winners, ["vault", "path"]).select(
        "vault", "rank", "path", text.excerpt(F.col("content"), _needle(query)).alias("excerpt"), F.col("kinds").alias("matches")
    )
