"""Column expressions over note text.

Everything here is a plain ``Column -> Column`` function made of built-ins, so
it stays in the JVM.  Lengths and positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space the text rules use, as a regex class body and
# as the characters themselves (for trimming).
WS_BODY = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_BODY}]"
WS_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Characters that end a line.
EOL_BODY = r"\n\r\u2028\u2029"

# White space worth collapsing: a run of it, or one other than a plain space.
# Single spaces are left unmatched and printable characters are ruled out by one
# range test, which makes this several times faster than replacing every run.
_NEXT = rf"[[^!-~]&&[{WS_BODY}]]"
COLLAPSIBLE = rf" {_NEXT}++|[[^ -~]&&[{WS_BODY}]]{_NEXT}*+"

# A hashtag opens the text or follows white space.
HASHTAG = rf"#(?<![^{WS_BODY}]#)([\w/-]+)"
WIKILINK = r"\[\[([^\]|#]++)(?:[|#][^\]]++)?\]\]"
TASK = rf"(?<![^{EOL_BODY}]){WS}*+-{WS}*+\[([ xX])\]{WS}+([^{EOL_BODY}]+)"
SECTION_BREAK = rf"\n(?=##{WS})"

# Search excerpt window and truncation marker.
EXCERPT_HEAD = 180
EXCERPT_BEFORE = 70
EXCERPT_AFTER = 110
TRUNCATION_MARKER = "\n[content truncated]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Without this, an expression used k times in a nested rule is copied k times
    into the tree.  The fold has no steps; the element of a one-item array would
    be typed anew for every row.
    """
    return F.aggregate(F.array().cast("array<boolean>"), value, lambda v, _: v, body)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, COLLAPSIBLE, " "))


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(content, 256)


def hashtags(content: Column) -> Column:
    """Inline ``#tag`` names in order of appearance (ASCII word characters)."""
    return F.when(
        F.contains(content, F.lit("#")), F.regexp_extract_all(content, F.lit(HASHTAG), 1)
    ).otherwise(F.array().cast("array<string>"))


def wikilinks(content: Column) -> Column:
    """Raw ``[[target]]`` names, embeds included, alias and heading cut off."""
    return F.when(
        F.contains(content, F.lit("[[")), F.regexp_extract_all(content, F.lit(WIKILINK), 1)
    ).otherwise(F.array().cast("array<string>"))


def normalize_link(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"(?i)\.md\z", "")


def tasks(content: Column) -> Column:
    """``array<struct<completed, text>>`` of the dash check-list items."""
    raw = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(TASK), 1).alias("mark"),
        F.regexp_extract_all(content, F.lit(TASK), 2).alias("text"),
    )
    items = F.transform(
        raw,
        lambda t: F.struct(
            (F.lower(t["mark"]) == "x").alias("completed"), trim_ws(t["text"]).alias("text")
        ),
    )
    return F.filter(items, lambda t: t["text"] != "")


def sections(content: Column) -> Column:
    """Trimmed ``##`` sections; text before the first one is kept as an entry."""
    parts = F.transform(F.split(content, SECTION_BREAK), trim_ws)
    return F.filter(parts, lambda s: s != "")


def excerpt(content: Column, query: Column | str) -> Column:
    """A window of the white-space-collapsed text around the first hit."""
    q = F.lower(F.lit(query) if isinstance(query, str) else query)

    def window(text: Column) -> Column:
        at = F.instr(F.lower(text), q)
        start = F.greatest(F.lit(1), at - EXCERPT_BEFORE)
        end = at + F.length(q) + EXCERPT_AFTER
        return F.when(at == 0, F.substring(text, 1, EXCERPT_HEAD)).otherwise(
            F.substring(text, start, end - start)
        )

    return let(collapse_ws(content), window)


def truncate_content(content: Column, limit: Column | int) -> Column:
    """``struct<content, truncated>``: the text, or its head and a marker."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.length(content) > n
    head = F.concat(F.substring(content, F.lit(1), F.greatest(F.lit(0), n)), F.lit(TRUNCATION_MARKER))
    return F.struct(
        F.when(cut, head).otherwise(content).alias("content"), cut.alias("truncated")
    )


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))
