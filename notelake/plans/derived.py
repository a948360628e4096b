"""Note tables derived from the analytics test tables.

``documents`` become notes of the vault named by their source, the first ten
documents of a source become its project notes, and ``events`` become daily
notes and change commands.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schema as S
from ..functions import text

_TASKS = 6
_SECTIONED = (4, 10, 11)
_DOC_KEY = "lpad(cast(doc_id as string), 6, '0')"

# Forms of the property block in turn, each as (block, tags as JSON, what follows the status as JSON); ``{lang}``,
# ``{source}`` and ``{status}`` stand for the document's.  The tags are its language and source in all of them.
PROPERTY_FORMS = (
    ("tags: [{lang}, {source}]\nstatus: {status}\n", '["{lang}","{source}"]', ""),
    ("tags:\n  - {lang}\n  -\n    - {source}\nstatus: {status}\n", '["{lang}",["{source}"]]', ""),
    ("tags: &t [{lang}, {source}]\nstatus: {status}\nmore: *t\n", '["{lang}","{source}"]', ',"more":["{lang}","{source}"]'),
    ("{tags: [{lang}, {no: tag}, {source}], status: {status}}\n", '["{lang}",{"no":"tag"},"{source}"]', ""),
    (
        "tags:\n- - {lang}\n  - {source}\n- true\nstatus: {status}\nby:\n- name: Ann\n  at:\n    day: 2026-01-02\n- name: Bo\n",
        '[["{lang}","{source}"],true]',
        ',"by":[{"name":"Ann","at":{"day":"2026-01-02T00:00:00.000Z"}},{"name":"Bo"}]',
    ),
    ("tags: [1e3, 0x1F, .5, 1_000, 007, {lang}, {source}]\nstatus: {status}\n", '[1000,31,0.5,1000,7,"{lang}","{source}"]', ""),
    ("tags: '{lang},\n  {source}'\nstatus: >-\n  {status}\ntitle: \"one\n\n  two\"\n", '"{lang}, {source}"', ',"title":"one\\ntwo"'),
)


def _filled(form: str) -> str:
    """A form as SQL text that both engines read."""
    parts = re.split(r"(\{(?:lang|source|status)\}|\n)", form)
    names = {"{lang}": "lang", "{source}": "source", "{status}": "CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'open' END", "\n": "chr(10)"}
    quoted = (names.get(p) or "'" + p.replace("'", "' || chr(39) || '").replace("\\", "' || chr(92) || '") + "'" for p in parts if p)
    return "concat(''" + "".join(f", {q}" for q in quoted) + ")"


def property_form(part: int) -> str:
    """SQL for one part of the form that a document's id chooses."""
    cases = " ".join(f"WHEN {i} THEN {_filled(form[part])}" for i, form in enumerate(PROPERTY_FORMS))
    return f"CASE doc_id % {len(PROPERTY_FORMS)} {cases} END"


DOCUMENT_NOTE = rf"""
    concat('---\n', {property_form(0)}, '---\n',
           text, '\n#', lang, '/', source, ' #q', cast(doc_id % 10 as string), '\n',
           'See [[', lpad(cast(doc_id + 20 as string), 6, '0'), '|next]] and [[',
           lang, '/', {_DOC_KEY}, '.md#top]]\n')
"""


# Given schemas save a footer-reading job per table.
_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(_SCHEMAS[name]) if name in _SCHEMAS else reader
    # A file stream takes a single file only as a pattern.
    return reader.parquet(f"{sf_dir}/{name}.parquet" + ("*" if streaming else ""))


def event_vault():
    return F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))


def event_day():
    return F.col("ts").cast("date")


def event_line():
    return F.concat(F.lit("- "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("\n"))


def document_notes(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents", streaming).select(
        F.col("source").alias("vault"),
        F.expr(f"concat(lang, '/', {_DOC_KEY}, '.md')").alias("path"),
        F.expr(DOCUMENT_NOTE).alias("content"),
    )


def project_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project notes made of each source's ten lowest documents.

    Only ids are ranked; text is fetched for the ranked few.
    """
    documents = table(spark, sf_dir, "documents")
    lowest = Window.partitionBy("source").orderBy("doc_id")
    first_ten = (
        documents.select("source", "doc_id")
        .withColumn("k", F.row_number().over(lowest) - 1)
        .filter("k < 10")
    )
    role_of_k = F.array(
        *[
            F.struct(F.lit(i % 10).alias("of_k"), F.lit(i).alias("idx"), F.lit(path).alias("path"))
            for i, (_, path) in enumerate(S.ROLES)
        ]
    )
    placed = (
        first_ten.select("source", "doc_id", "k", F.inline(role_of_k))
        .filter("of_k = k AND (cast(substring(source, 4) as int) + idx) % 5 <> 4")
        .drop("of_k", "k")
    )
    doc_text = F.col("text")
    newline = F.lit("\n")
    content = (
        F.when(
            F.col("idx") == _TASKS,
            F.concat(F.lit("- [ ] "), F.replace(doc_text, newline, F.lit("\n- [x] "))),
        )
        .when(
            F.col("idx").isin(*_SECTIONED),
            F.concat(F.lit("# Log\n## "), F.replace(doc_text, newline, F.lit("\n## "))),
        )
        .otherwise(doc_text)
    )
    return documents.select("doc_id", "text").join(placed, "doc_id").select(
        F.col("source").alias("vault"), "path", content.alias("content")
    )


def daily_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        event_vault().alias("vault"),
        F.concat(F.lit("Daily/"), event_day().cast("string"), F.lit(".md")).alias("path"),
        "event_id",
        event_line().alias("line"),
    )
    return lines.groupBy("vault", "path").agg(
        F.expr("listagg(line, '') WITHIN GROUP (ORDER BY event_id)").alias("content")
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived corpus with content hashes."""
    parts = document_notes(spark, sf_dir).unionByName(project_notes(spark, sf_dir))
    return parts.unionByName(daily_notes(spark, sf_dir)).withColumn(
        "content_hash", text.content_hash(F.col("content"))
    )


def vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("cast(substring(source, 4) as int)")
    return (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("name"),
            F.concat(F.lit("/vaults/"), "source").alias("path"),
            (number % 5 == 0).alias("read_only"),
            F.struct(
                F.when(number % 2 == 0, "Daily").otherwise("Journal/").alias("directory"),
                F.when(number % 3 == 0, "YYYY/MM/DD").otherwise("YYYY-MM-DD").alias("date_format"),
            ).alias("daily_notes"),
        )
    )


def commands(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """One command per event; ``seq`` is the event id, and every fifth one expects a hash that no note has."""
    event = F.col("event_type")
    op = (
        F.when(event == "signup", "create")
        .when(event == "click", "append")
        .when(event == "purchase", "update")
        .when(event == "error", "delete")
        .otherwise("append_daily")
    )
    path = F.when(
        event == "view", F.concat(F.lit("Daily/"), event_day().cast("string"), F.lit(".md"))
    ).otherwise(F.concat(F.lit("Log/n"), (F.col("event_id") % 25).cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "events", streaming).select(
        F.col("event_id").alias("seq"),
        event_vault().alias("vault"),
        op.alias("op"),
        path.alias("path"),
        F.lit(None).cast("string").alias("dest"),
        F.concat(event, F.lit(" "), F.col("event_id").cast("string"), F.lit("\n")).alias("body"),
        F.when(F.col("event_id") % 5 == 0, "stale").alias("expected_hash"),
        (F.col("event_id") % 7 == 0).alias("overwrite"),
        F.lit(None).cast(S.COMMANDS["properties"].dataType).alias("properties"),
    )
