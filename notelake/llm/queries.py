"""Queries of the operators over the given tables, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import common, exact, extraction, filter_audit, hard_negatives, jaccard, language, leaks, licenses, pieces, repeats, secrets, tokens, urls
from notelake.operators.checkpoints import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.document_notes(_table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_notes(spark, sf_dir)).select(
        common.doc_id().alias("doc_id"), "n_shingles", common.doc_id("component_path").alias("component_id"), "component_size"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    tokens.write_tokens(_notes(spark, sf_dir), folder, tokenizer_file("byte_bpe_50k.json"))
    return tokens.token_digests(spark, folder).select(common.doc_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_notes(spark, sf_dir)).select(
        common.doc_id().alias("doc_id"),
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def benchmark_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("vault"), F.format_string("%019d", "item_id").alias("path"), F.col("text").alias("content")
    )


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_notes(spark, sf_dir), benchmark_notes(spark, sf_dir)).select(
        common.doc_id().alias("doc_id"), common.doc_id("reserved_path").alias("item_id"),
        "passages", "found", "start", "end", "edits", "coverage",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_notes(spark, sf_dir)).select(
        common.doc_id().alias("doc_id"), "license", "start", "end", "matched", "words", "coverage"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, and beyond them the model learned from the labelled URLs of the module: rules as labels would only repeat the rules."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.learn_urls(urls.example_urls(spark))
    return urls.judge_urls(pages, model).select("row.page_id", "host", "path", "rule", "verdict")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return secrets.find_secrets(_notes(spark, sf_dir)).select(
        common.doc_id().alias("doc_id"),
        count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_notes(spark, sf_dir)).select(
        common.doc_id().alias("doc_id"), common.doc_id("keep_path").alias("keep_id"), "group_size", "kept", "text_sha256"
    )


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def language_model(documents: DataFrame) -> language.LanguageModel:
    """Learned from the labelled documents that are not held out."""
    learnable = documents.where(~F.coalesce(held_out(), F.lit(False)))
    return language.learn_languages(learnable.select(F.col("text").alias("content"), "lang"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = language.identify_languages(common.document_notes(documents), language_model(documents))
    return found.withColumn("doc_id", common.doc_id()).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op10_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_file("piece_bpe_32k.model")
    texts = pieces.decode_notes(pieces.encode_notes(_notes(spark, sf_dir), file), file)
    return texts.select(
        common.doc_id().alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    notes = common.document_notes(documents, others=["lang"])
    labels = _table(spark, sf_dir, "labels").select(
        "doc_id", F.lit("").alias("text"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
    )
    return filter_audit.audit_filters(notes, common.document_notes(labels, others=["good", "toxic"]), part="lang")


AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), failed AS (
  SELECT part,
         (len(words) < 100)::INT
         + (100 * len(list_distinct(words)) < 80 * len(words))::INT * 2
         + (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT * 4
         + regexp_matches(text, '[#$%&*|]')::INT * 8
         + coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT * 16 AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) USING (doc_id)
), counts AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM failed GROUP BY 1, 2
), letter(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(step)
), audited AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM audited
"""


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.document_notes(_table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"), "html", ["doc_id", "url"])
    return extraction.extract_text(pages, carry=["doc_id", "url"]).select(
        F.col("doc_id").alias("page_id"), "url", F.col("content").alias("text"), F.length("content").cast("bigint").alias("n_chars"), "n_blocks", "n_kept"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", label.alias("label"))
    return hard_negatives.mine_hard_negatives(vectors, F.col("id") % 100 == 0)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), q AS (
  SELECT vec_id, label, i, floor(256 * x)::BIGINT AS x FROM v
  WHERE vec_id NOT IN (SELECT vec_id FROM v WHERE x IS NULL OR NOT isfinite(x))
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, sum(a.x * b.x)::BIGINT AS score
  FROM q a JOIN q b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


SUITE = {
    "op1_jaccard_join": (op1_jaccard_join, None),
    "op2_token_files": (op2_token_files, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_benchmark_leaks": (op4_benchmark_leaks, None),
    "op5_license_scan": (op5_license_scan, None),
    "op6_url_filter": (op6_url_filter, None),
    "op7_secret_scan": (op7_secret_scan, None),
    "op8_exact_dedup": (op8_exact_dedup, EXACT_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_piece_ids": (op10_piece_ids, None),
    "op11_filter_audit": (op11_filter_audit, AUDIT_SQL),
    "op12_html_text": (op12_html_text, None),
    "op13_hard_negatives": (op13_hard_negatives, NEGATIVES_SQL),
}
