"""Table schemas and the fixed dimension rows of the note model.

``(vault, path)`` is the primary key of ``notes``; ``seq`` is a unique,
non-negative command number and defines the order of change commands.
"""

from __future__ import annotations

from pyspark.sql import types as T

NOTES = T.StructType(
    [
        T.StructField("vault", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

TRASH = T.StructType(NOTES.fields + [T.StructField("deleted_from", T.StringType())])

VAULTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("read_only", T.BooleanType()),
        T.StructField(
            "daily_notes",
            T.StructType(
                [
                    T.StructField("directory", T.StringType()),
                    T.StructField("date_format", T.StringType()),
                ]
            ),
        ),
    ]
)

COMMANDS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("vault", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("expected_hash", T.StringType()),
        T.StructField("overwrite", T.BooleanType()),
        T.StructField(
            "properties",
            T.ArrayType(
                T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
            ),
        ),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("vault", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

# The state of one touched key after a batch: its new text, or a tombstone.
CHANGES = T.StructType(NOTES.fields + [T.StructField("deleted", T.BooleanType())])

# The canonical project notes, in budget order.
ROLES = (
    ("home", "00 - Project Home.md"),
    ("brief", "01 - Brief.md"),
    ("goals", "02 - Goals & Success Criteria.md"),
    ("requirements", "03 - Requirements.md"),
    ("decisions", "04 - Decisions.md"),
    ("plans", "05 - Plans.md"),
    ("tasks", "06 - Tasks.md"),
    ("research", "07 - Research.md"),
    ("meetings", "08 - Meeting Notes.md"),
    ("resources", "09 - Resources.md"),
    ("risks", "10 - Risks & Issues.md"),
    ("changelog", "11 - Changelog.md"),
)

# Defaults of a vault entry.
DEFAULT_DAILY_DIRECTORY = "Daily"
DEFAULT_DATE_FORMAT = "YYYY-MM-DD"

# Command operations and result statuses.
OPS = ("create", "update", "append", "append_daily", "delete", "move")
OK = "OK"
NOT_REGISTERED = "NOT_REGISTERED"
READ_ONLY = "READ_ONLY"
NOT_FOUND = "NOT_FOUND"
EXISTS = "EXISTS"
HASH_MISMATCH = "HASH_MISMATCH"
UNKNOWN_OP = "UNKNOWN_OP"
