"""From raw documents to piece ids: five stages, each applied to all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the last keep the
columns of ``docs``.  Rows of one ``doc_id`` go or stay together; rows without
``doc_id`` stay.  Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import common, exact, jaccard, language, leaks, pieces, queries
from notelake.operators.checkpoints import scratch


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for the ids in ``dropped``, which is written first so that its size is known."""
    return docs.join(common.stored(dropped.distinct(), "dropped"), "doc_id", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (empty, or without letters) go."""
    found = language.identify_languages(common.document_notes(docs), queries.language_model(docs))
    return _without(docs, found.where(F.col("lang_pred") == language.UNDETERMINED).select(common.doc_id().alias("doc_id")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays; rows that repeat a document are cut to one."""
    rows = exact.exact_duplicates(common.document_notes(docs)).select(common.doc_id().alias("doc_id"), "kept")
    ids = common.stored(
        rows.groupBy("doc_id").agg(F.max("kept").alias("any"), F.min("kept").alias("all"))
        .where("doc_id is not null and not (any and all)"),
        "exact-ids",
    )
    kept = _without(docs, ids.select("doc_id"))
    repeated = ids.where("any").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the smallest id stays."""
    groups = jaccard.jaccard_components(common.document_notes(docs)).select(
        common.doc_id().alias("doc_id"), common.doc_id("component_path").alias("component_id")
    )
    return _without(docs, groups.where("doc_id <> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = leaks.find_leaks(common.document_notes(docs), queries.benchmark_notes(spark, sf_dir))
    return _without(docs, found.select(common.doc_id().alias("doc_id")))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, text``: the piece ids of each document and the text they decode to."""
    file = queries.tokenizer_file("piece_bpe_32k.model")
    texts = pieces.decode_notes(pieces.encode_notes(common.document_notes(docs), file), file)
    return texts.select(common.doc_id().alias("doc_id"), "ids", F.col("content").alias("text"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("piece_ids", piece_ids),
]

#: SQL has neither the language model nor the piece search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
