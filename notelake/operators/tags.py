"""Tags from properties and from hashtags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import frontmatter as fm, text
from .common import listing_key
from .corpus import in_directory, markdown_only, visible_notes


def note_tags(notes: DataFrame, directory: str = "") -> DataFrame:
    """Every tag occurrence as ``(vault, path, tag, origin)``, from one scan."""
    content = F.col("content")

    def labelled(tags, origin):
        return F.transform(tags, lambda t: F.struct(t.alias("tag"), F.lit(origin).alias("origin")))

    found = F.concat(
        labelled(fm.frontmatter_tags("content"), "frontmatter"),
        labelled(text.hashtags(content), "hashtag"),
    )
    return (
        markdown_only(visible_notes(in_directory(notes, directory)))
        .select("vault", "path", F.explode(found).alias("t"))
        .select("vault", "path", "t.tag", "t.origin")
    )


def tag_counts(notes: DataFrame, directory: str = "") -> DataFrame:
    """Occurrences per ``(vault, tag)``; counts are combined before the shuffle,
    so a tag on every note costs no more than a rare one."""
    return note_tags(notes, directory).groupBy("vault", "tag").agg(F.count("*").alias("count"))


def list_tags(
    notes: DataFrame, directory: str = "", collation: str | None = "UNICODE"
) -> DataFrame:
    """:func:`tag_counts` sorted by vault and tag name."""
    return tag_counts(notes, directory).orderBy("vault", listing_key("tag", collation), "tag")
