"""Column expressions over vault-relative paths and vault names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_ws

SEP = r"[/\\]"
NOT_SEP = r"[^/\\]"
HIDDEN_SEGMENT = r"(^|/)(\.[^/]*|node_modules)/"


def relative_path(root: Column | str, absolute: Column) -> Column:
    """``absolute`` below ``root``, with ``/`` between the parts."""
    base = F.lit(root) if isinstance(root, str) else root
    slashed = F.replace(absolute, F.lit("\\"), F.lit("/"))
    prefix = F.rtrim(F.replace(base, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.ltrim(F.substring(slashed, F.length(prefix) + 1, F.length(slashed)), F.lit("/"))


def normalize_path(path: Column) -> Column:
    """Key form of a requested path: one ``/`` between parts, none at the ends."""
    return F.btrim(F.regexp_replace(path, rf"{SEP}+", "/"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_markdown(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".md"))


def is_visible(path: Column) -> Column:
    """No hidden directory on the way; hidden *files* stay visible."""
    return ~F.rlike(path, F.lit(HIDDEN_SEGMENT))


def is_inside(path: Column, root: Column | str) -> Column:
    """``path`` is ``root`` or lies below it."""
    base = F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/"))
    return (F.rtrim(path, F.lit("/")) == base) | F.startswith(path, F.concat(base, F.lit("/")))


def path_status(path: Column, kind: Column | str = "note") -> Column:
    """First rule the path breaks, else ``OK``.  A NULL path is an empty one."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    is_note = kind == "note"
    return (
        F.when(F.contains(path, F.char(F.lit(0))), "NULL_BYTE")
        .when(F.rlike(path, F.lit(rf"^([A-Za-z]:)?{SEP}")), "ABSOLUTE_PATH")
        .when(path.isNull() | (path == "") | F.rlike(path, F.lit(rf"(^|{SEP})\.\.({SEP}|\z)")), "TRAVERSAL")
        .when(is_note & ~F.rlike(path, F.lit(rf"(?i)\.md{SEP}*\z")), "MARKDOWN_REQUIRED")
        .when(F.rlike(path, F.lit(rf"(?i)(^|{SEP})node_modules({SEP}|\z)")), "EXCLUDED_PATH")
        .when(is_note & F.rlike(path, F.lit(rf"(^|{SEP})\.{NOT_SEP}*{SEP}+{NOT_SEP}")), "EXCLUDED_PATH")
        .when(~is_note & F.rlike(path, F.lit(rf"(^|{SEP})\.")), "EXCLUDED_PATH")
        .otherwise("OK")
    )


def daily_path(directory: Column, date_format: Column, day: Column) -> Column:
    """Path of a day's note; only ``YYYY``, ``MM`` and ``DD`` are placeholders."""
    name = date_format
    for token, part, width in (("YYYY", F.year(day), 4), ("MM", F.month(day), 2), ("DD", F.day(day), 2)):
        name = F.replace(name, F.lit(token), F.lpad(part.cast("string"), width, "0"))
    return F.concat(F.regexp_replace(directory, rf"{SEP}+\z", ""), F.lit("/"), name, F.lit(".md"))


def vault_name(name: Column) -> Column:
    return trim_ws(name)


def vault_name_valid(name: Column) -> Column:
    trimmed = trim_ws(name)
    return ~(trimmed.isin("", ".", "..") | F.rlike(trimmed, F.lit(SEP)))


def path_suffixes(path: Column) -> Column:
    """``a/b/c`` -> ``[a/b/c, b/c, c]``."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )
