"""Project context, project activity and recent daily notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import frontmatter as fm, text
from .common import broadcast_if_small, listing_key
from .corpus import in_directory, list_directory, markdown_only, visible_notes
from .graph import backlink_counts
from .tags import tag_counts

# Bounds and defaults of budgets and limits.
CONTEXT_CHARS = (1000, 100_000)
CONTEXT_DEFAULT = 30_000
DAILY_LIMITS = (1, 30)
DAILY_DEFAULT = 10
ACTIVITY_CHARS = 20_000
DAILY_FOLDER = "Daily"
TASKS_NOTE = "06 - Tasks.md"
SECTION_NOTES = {
    "decisions": "04 - Decisions.md",
    "risks": "10 - Risks & Issues.md",
    "changelog": "11 - Changelog.md",
}


def roles() -> Column:
    """The canonical notes as an array of ``struct<idx, role, path>``."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("idx"), F.lit(role).alias("role"), F.lit(path).alias("path"))
            for i, (role, path) in enumerate(S.ROLES)
        ]
    )


def role_notes(notes: DataFrame) -> DataFrame:
    return notes.filter(F.col("path").isin([path for _, path in S.ROLES]))


def _budgeted(placed: DataFrame, budget: int) -> DataFrame:
    """Spend ``budget`` characters per vault in ``idx`` order.

    Expects ``head`` (the text cut to the budget) and ``n`` (its full length).
    Once a note is cut nothing is left, so what a note may use is the budget
    less the lengths before it: a prefix sum, no loop.
    """
    before = (
        Window.partitionBy("vault").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum("n").over(before), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("used")).cast("int")
    cut = F.col("n") > left
    marked = F.concat(F.substring("head", F.lit(1), left), F.lit(text.TRUNCATION_MARKER))
    return placed.withColumn("used", used).select(
        "vault",
        "idx",
        "role",
        "path",
        F.col("n").isNotNull().alias("exists"),
        F.when(cut, marked).otherwise(F.col("head")).alias("content"),
        "content_hash",
        cut.alias("truncated"),
    )


def context_budget(role_notes: DataFrame, max_chars: int = CONTEXT_DEFAULT) -> DataFrame:
    """Cut ``(vault, idx, role, path, content, content_hash)`` to a budget."""
    budget = text.clamp(max_chars, *CONTEXT_CHARS)
    heads = role_notes.select(
        "vault",
        "idx",
        "role",
        "path",
        F.substring("content", 1, budget).alias("head"),
        F.length("content").alias("n"),
        "content_hash",
    )
    return _budgeted(heads, budget)


def project_context(
    notes: DataFrame, vaults: DataFrame, max_chars: int = CONTEXT_DEFAULT
) -> DataFrame:
    """Every vault with its twelve canonical notes, cut to a character budget.

    ``(vault, idx, role, path, exists, content, content_hash, truncated)``.
    Texts are cut to the budget in the scan; at most twelve of them per vault are
    packed into one row, so the join and the budget share one shuffle by vault.
    """
    budget = text.clamp(max_chars, *CONTEXT_CHARS)
    found = (
        role_notes(notes)
        .select(
            "vault",
            "path",
            F.struct(
                F.substring("content", 1, budget).alias("head"),
                F.length("content").alias("n"),
                "content_hash",
            ).alias("note"),
        )
        .groupBy("vault")
        .agg(F.map_from_entries(F.collect_list(F.struct("path", "note"))).alias("found"))
    )
    placed = (
        vaults.select(F.col("name").alias("vault"))
        .join(found, "vault", "left")
        .select("vault", "found", F.inline(roles()))
        .withColumn("note", F.try_element_at("found", F.col("path")))
        .select("vault", "idx", "role", "path", "note.head", "note.n", "note.content_hash")
    )
    return _budgeted(placed, budget)


def missing_notes(notes: DataFrame, vaults: DataFrame) -> DataFrame:
    """``(vault, missing)``: absent canonical paths in role order."""
    found = role_notes(notes).groupBy("vault").agg(F.collect_set("path").alias("found"))
    every = F.transform(roles(), lambda r: r["path"])
    return (
        vaults.select(F.col("name").alias("vault"))
        .join(found, "vault", "left")
        .select(
            "vault",
            F.array_except(
                every, F.coalesce("found", F.array().cast("array<string>"))
            ).alias("missing"),
        )
    )


def recent_daily_notes(
    notes: DataFrame,
    limit: int = DAILY_DEFAULT,
    max_chars: int = ACTIVITY_CHARS,
    collation: str | None = "UNICODE",
) -> DataFrame:
    """The last ``limit`` notes of each vault's daily folder, newest first.

    ``(vault, rank, path, content, truncated)``.  Names alone are ranked, and
    each task keeps only its own best ``limit`` before the shuffle; text is
    fetched for the winners, in place while there are few of them.
    """
    n = text.clamp(limit, *DAILY_LIMITS)
    daily = markdown_only(visible_notes(in_directory(notes, DAILY_FOLDER)))
    newest = Window.partitionBy("vault").orderBy(
        listing_key("path", collation).desc(), F.col("path").desc()
    )
    top = (
        daily.select("vault", "path")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= n)
    )
    cut = daily.select(
        "vault", "path", text.truncate_content(F.col("content"), max_chars).alias("t")
    )
    return cut.join(broadcast_if_small(top), ["vault", "path"]).select(
        "vault", "rank", "path", "t.content", "t.truncated"
    )


def note_tasks(notes: DataFrame) -> DataFrame:
    """Check-list items of the tasks note: ``(vault, source, pos, completed, text)``."""
    return notes.filter(F.col("path") == TASKS_NOTE).select(
        "vault",
        F.col("path").alias("source"),
        F.posexplode(text.tasks(F.col("content"))).alias("pos", "task"),
    ).select("vault", "source", "pos", "task.completed", "task.text")


def note_sections(notes: DataFrame) -> DataFrame:
    """Entries of the section notes: ``(vault, kind, source, pos, content)``."""
    kind = F.lit(None).cast("string")
    for name, path in SECTION_NOTES.items():
        kind = F.when(F.col("path") == path, name).otherwise(kind)
    return notes.filter(F.col("path").isin(list(SECTION_NOTES.values()))).select(
        "vault",
        kind.alias("kind"),
        F.col("path").alias("source"),
        F.posexplode(text.sections(F.col("content"))).alias("pos", "content"),
    )


def project_activity(
    notes: DataFrame,
    daily_limit: int = DAILY_DEFAULT,
    max_chars: int = ACTIVITY_CHARS,
    collation: str | None = "UNICODE",
) -> DataFrame:
    """Tasks, decisions, risks, changelog and daily notes of every vault.

    ``(vault, kind, source, pos, completed, content)``.
    """
    no_mark = F.lit(None).cast("boolean").alias("completed")
    tasks = note_tasks(notes).select(
        "vault", F.lit("tasks").alias("kind"), "source", "pos", "completed",
        F.col("text").alias("content"),
    )
    parts = note_sections(notes).select("vault", "kind", "source", "pos", no_mark, "content")
    daily = recent_daily_notes(notes, daily_limit, max_chars, collation).select(
        "vault",
        F.lit("dailyNotes").alias("kind"),
        F.col("path").alias("source"),
        (F.col("rank") - 1).alias("pos"),
        no_mark,
        "content",
    )
    return tasks.unionByName(parts).unionByName(daily)


def _every_vault(rows: DataFrame, vaults: DataFrame | None, empty) -> DataFrame:
    """``rows`` with one of ``empty(column, type)`` values for each registered vault that has none."""
    if vaults is None:
        return rows
    full = vaults.select(F.col("name").alias("vault")).join(rows, "vault", "left")
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name != "vault"}
    return full.select("vault", *[F.coalesce(c, empty(t)).alias(c) for c, t in kinds.items()])


def project_activity_nested(activity: DataFrame, vaults: DataFrame | None = None) -> DataFrame:
    """One row per vault with the five lists of :func:`project_activity`.

    With ``vaults`` every registered vault has its row, if with empty lists.
    """

    def entries(kind: str, *fields: tuple[str, str]) -> Column:
        rows = F.sort_array(
            F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "completed", "content", "source")))
        )
        return F.transform(rows, lambda r: F.struct(*[r[f].alias(a) for f, a in fields]))

    entry = (("source", "source"), ("content", "content"))
    task = (("completed", "completed"), ("content", "text"), ("source", "source"))
    nested = activity.groupBy("vault").agg(
        entries("tasks", *task).alias("tasks"),
        *[entries(k, *entry).alias(k) for k in ("decisions", "risks", "changelog", "dailyNotes")],
    )
    return _every_vault(nested, vaults, lambda kind: F.array().cast(kind))


def vault_counts(notes: DataFrame, vaults: DataFrame | None = None) -> DataFrame:
    """Per vault: notes, daily notes, tasks, tag and link occurrences.

    With ``vaults`` every registered vault is counted, if with zeros.
    """
    content = F.col("content")
    kept = markdown_only(visible_notes(notes)).select(
        "vault",
        F.startswith("path", F.lit(DAILY_FOLDER + "/")).alias("daily"),
        F.when(F.col("path") == TASKS_NOTE, F.size(text.tasks(content))).otherwise(0).alias("tasks"),
        (F.size(fm.frontmatter_tags("content")) + F.size(text.hashtags(content))).alias("tags"),
        F.size(text.wikilinks(content)).alias("links"),
    )
    counts = kept.groupBy("vault").agg(
        F.count("*").alias("notes"),
        F.count_if("daily").alias("daily_notes"),
        F.sum("tasks").alias("tasks"),
        F.sum("tags").alias("tag_occurrences"),
        F.sum("links").alias("link_occurrences"),
    )
    return _every_vault(counts, vaults, lambda kind: F.lit(0).cast(kind))


def count_by_vault(**tables: DataFrame) -> DataFrame:
    """``(vault, measure, n)``: the rows of each named table per vault."""
    counted = [
        df.groupBy("vault").agg(F.count("*").alias("n")).select("vault", F.lit(name).alias("measure"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def vault_summary(notes: DataFrame) -> DataFrame:
    """Counts of what the listings return: top-level entries, tags, backlinks (counted without building the pairs)."""
    return count_by_vault(directory_entries=list_directory(notes), tags=tag_counts(notes)).unionByName(
        backlink_counts(notes).select("vault", F.lit("backlinks").alias("measure"), "n")
    )
