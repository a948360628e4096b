"""Wiki links: the edge table, backlinks and dangling links.

A link L points at a note whose name without ``.md`` is T when ``L = T``, L ends
in ``/T`` or T ends in ``/L``.  That suffix test is turned into equality: each
side is expanded into join keys of two kinds,

* ``name``   – the link itself against every path suffix of a note, and
* ``suffix`` – every shorter suffix of the link against the whole note name,

which meet in one equi join on ``(vault, kind, key)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, text
from .checkpoints import checkpoint
from .corpus import markdown_only, visible_notes


def _link_names(content: Column) -> Column:
    return F.array_distinct(F.transform(text.wikilinks(content), text.normalize_link))


def links(notes: DataFrame) -> DataFrame:
    """Edge table ``(vault, src, link)``: the distinct links of every note."""
    return markdown_only(visible_notes(notes)).select(
        "vault", F.col("path").alias("src"), F.explode(_link_names(F.col("content"))).alias("link")
    )


def _kinds(name: Column, suffix: Column) -> Column:
    def tagged(keys: Column, kind: str) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    return F.inline(F.concat(tagged(name, "name"), tagged(suffix, "suffix")))


def _shorter_suffixes(name: Column) -> Column:
    suffixes = paths.path_suffixes(name)
    return F.when(F.contains(name, F.lit("/")), F.slice(suffixes, F.lit(2), F.size(suffixes))).otherwise(
        F.array().cast("array<string>")
    )


def _link_keys(edges: DataFrame) -> DataFrame:
    return edges.select(
        "vault", "src", "link", _kinds(F.array("link"), _shorter_suffixes(F.col("link")))
    )


def _note_keys(notes: DataFrame) -> DataFrame:
    names = markdown_only(visible_notes(notes)).select(
        "vault", "path", text.normalize_link(F.col("path")).alias("name")
    )
    return names.select(
        "vault", "path", _kinds(paths.path_suffixes(F.col("name")), F.array("name"))
    )


def backlinks(notes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All ``(vault, path, src)``: note ``src`` links to note ``path``.

    Pass a stored :func:`links` table as ``edges`` to leave note text unread.
    A link name used everywhere makes the link side of the join skewed; adaptive
    execution splits such a partition over several tasks.
    """
    edges = links(notes) if edges is None else edges
    met = _link_keys(edges).join(_note_keys(notes), ["vault", "kind", "key"])
    return met.select("vault", "path", "src").distinct()


def link_targets(notes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(vault, link, path)``: the distinct links and the notes each points at.

    With :func:`links` this is the link graph in factorised form: a name that m notes
    link to and n notes match takes m edges and n targets, where :func:`backlinks`
    has m x n rows.  There are at most as many targets as notes and links have
    path suffixes, so the result grows with the names, not with their pairs.
    """
    edges = links(notes) if edges is None else edges
    names = edges.select("vault", "link").distinct()
    wanted = names.select("vault", "link", _kinds(F.array("link"), _shorter_suffixes(F.col("link"))))
    # A note meets a link by its own suffix or by the link's, never by both.
    return wanted.join(_note_keys(notes), ["vault", "kind", "key"]).select("vault", "link", "path")


def backlink_counts(notes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(vault, n)``: the rows of :func:`backlinks` per vault, without building them.

    A note may reach another by several links, which counts once.  The notes below a
    link (those whose name ends in it) lie wholly below every link that is a suffix of it,
    and two links without such a relation have no note in common.  So only the links
    of a note that have no other of its links as a suffix count: each by the notes below it,
    and by the notes named like one of its own shorter suffixes.  What is counted are keys of
    either kind, per source once; sources and notes are each summed up by key before they meet.
    Vaults without backlinks have no row.
    """
    edges = links(notes) if edges is None else edges
    spread = edges.select(
        "vault", "src", "link", F.explode(paths.path_suffixes(F.col("link"))).alias("key")
    ).repartition("vault", "src")
    whole = F.col("key") == F.col("link")
    linked = F.max(whole).over(Window.partitionBy("vault", "src", "key"))
    covered = F.max(F.col("linked") & ~whole).over(Window.partitionBy("vault", "src", "link"))
    least = spread.withColumn("linked", linked).withColumn("covered", covered).filter(~F.col("covered"))
    # The partitioning by source serves both windows and the distinct keys.
    sources = (
        least.select("vault", "src", F.when(whole, "name").otherwise("suffix").alias("kind"), "key")
        .distinct()
        .groupBy("vault", "kind", "key")
        .agg(F.count("*").alias("sources"))
    )
    targets = _note_keys(notes).groupBy("vault", "kind", "key").agg(F.count("*").alias("targets"))
    return (
        sources.join(targets, ["vault", "kind", "key"])
        .groupBy("vault")
        .agg(F.sum(F.col("sources") * F.col("targets")).alias("n"))
    )


def backlinks_of(notes: DataFrame, target: str) -> DataFrame:
    """``(vault, path)`` of the notes that link to ``target``: one filter, no
    shuffle.  The target need not exist."""
    name = text.normalize_link(F.lit(target))
    hit = F.exists(
        _link_names(F.col("content")),
        lambda l: (l == name)
        | F.endswith(l, F.concat(F.lit("/"), name))
        | F.endswith(name, F.concat(F.lit("/"), l)),
    )
    return markdown_only(visible_notes(notes)).filter(hit).select("vault", "path")


def dangling_links(notes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(vault, src, link)`` of the links that match no note.

    Link names are made distinct first, so a name is resolved once however often
    it is used.  Links that are not passed in are checkpointed, so note text is read once.
    """
    edges = checkpoint(links(notes)) if edges is None else edges
    names = edges.select("vault", "link").distinct()
    wanted = names.select("vault", "link", _kinds(F.array("link"), _shorter_suffixes(F.col("link"))))
    resolved = (
        wanted.join(
            _note_keys(notes).select("vault", "kind", "key"), ["vault", "kind", "key"], "left_semi"
        )
        .select("vault", "link")
        .distinct()
    )
    return edges.join(resolved, ["vault", "link"], "left_anti").select("vault", "src", "link")
