"""The physical plans that the operators are written for."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from notelake.functions import frontmatter
from notelake.operators import corpus, graph, project, tags
from notelake.operators import commands, common
from notelake.operators.commands import apply_commands
from notelake.operators.properties import update_frontmatter
from notelake.plans import derived
from notelake.sources.tables import NoteStore, save_notes


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    save_notes(derived.notes(spark, sf_dir), path)
    return NoteStore(spark, path).notes()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange\b", text))


def test_search_ranks_names_only_and_parses_once(stored):
    hits = corpus._hits(corpus.in_directory(stored, "Daily"), "the", "vault", "path")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("vault").orderBy("path"))).filter("rank <= 20")
    text = plan(ranked)
    assert "Partial" in text and text.count("WindowGroupLimit") == 2 and exchanges(text) == 1
    assert "StringStartsWith(path,Daily/)" in text
    once = plan(stored.select(frontmatter.frontmatter_text("content")))
    assert 0 < text.count("regexp_extract_all") <= once.count("regexp_extract_all")


def test_tag_counts_combine_before_the_shuffle(stored):
    text = plan(tags.tag_counts(stored))
    assert "partial_count" in text and exchanges(text) == 1


def test_backlinks_join_by_equality(stored):
    text = plan(graph.backlinks(stored, graph.links(stored)))
    assert "NestedLoop" not in text and "Cartesian" not in text
    # the note side reads no text
    assert re.search(r"ReadSchema: struct<path:string>", text)


def test_backlink_counts_share_one_partitioning_by_source(stored):
    """Both windows and the distinct keys stand on one shuffle by source; then only sums meet."""
    text = plan(graph.backlink_counts(stored, graph.links(stored)))
    assert len(re.findall(r"Exchange hashpartitioning\(vault#\d+, src", text)) == 1 and text.count("Window [") == 2
    assert text.count("partial_count") >= 2 and "NestedLoop" not in text and "CartesianProduct" not in text


def test_backlinks_of_one_note_is_a_filter(stored):
    assert exchanges(plan(graph.backlinks_of(stored, "en/000100.md"))) == 0


def test_context_reads_only_canonical_notes(stored, spark, sf_dir):
    text = plan(project.project_context(stored, derived.vaults(spark, sf_dir)))
    assert "In(path, [" in text and "NestedLoop" not in text


def test_daily_names_are_ranked_without_text(stored):
    text = plan(project.recent_daily_notes(stored))
    assert "WindowGroupLimit" in text and "BroadcastHashJoin" in text
    assert re.search(r"ReadSchema: struct<path:string>", text)


def test_reading_few_notes_leaves_the_corpus_in_place(stored, make_vaults, spark):
    asked = spark.createDataFrame([("src1", "en/000100.md")], "vault string, path string")
    text = plan(corpus.read_notes(stored, make_vaults("src1"), asked))
    joins = [line for line in text[: text.index("FileScan")].splitlines() if "Join" in line]
    assert "BroadcastHashJoin" in joins[-1]


def test_moves_read_the_notes_once(spark, make_notes, make_vaults, make_commands):
    """One read of the touched notes for one move and for a chain of many."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    plain = make_notes([("v", f"n{i:02d}.md", str(i)) for i in range(30)])
    notes = plain.mapInPandas(count, plain.schema)
    read = []
    for moves in (1, 6):
        chain = [{"vault": "v", "op": "move", "path": f"m{i}.md" if i else "n00.md", "dest": f"m{i + 1}.md"} for i in range(moves)]
        before = seen.value
        applied = apply_commands(notes, None, make_vaults("v"), make_commands(*chain))
        assert {r.status for r in applied.results.collect()} == {"OK"}
        read.append(seen.value - before)
    assert read == [30, 30]


@pytest.mark.parametrize("fold_commands", [1000, 3])
def test_commands_are_read_once(spark, make_notes, make_vaults, make_commands, fold_commands):
    """However many steps a batch takes, with hot notes too, its commands are made and judged once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ops = ["append_daily", "delete", "create", "update", "append"]
    plain = make_commands(*[{"vault": "v", "op": ops[i % 5], "path": f"n{i % 2}.md", "body": str(i)} for i in range(40)])
    batch = plain.mapInArrow(count, plain.schema)
    applied = apply_commands(make_notes([("v", "n0.md", "A")]), None, make_vaults("v"), batch, fold_commands=fold_commands, blocks=4)
    assert applied.results.count() == 40 and applied.trashed.count() and applied.changes.count() == 2
    assert seen.value == 40


def test_texts_leave_a_fold_in_small_batches():
    """What a worker holds is bounded by a note's text, not by the texts of a batch."""
    names = ["vault", "root", "seq", "op", "key", "dest_key", "dest_rule", "body", "expected_hash", "overwrite"]
    rows = []
    for i in range(40):
        key = f"n{i:02d}.md"
        rows.append(("v", key, -1, "base", key, None, None, "x" * (1 << 20), None, False))
        rows.append(("v", key, i, "move", key, f"to/{key}", "OK", "", "", False))
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    given = list(commands._stream_groups(iter([batch])))
    assert sum(b.num_rows for b in given) == 40 * 3
    assert max(b.nbytes for b in given) < 8 << 20


def test_texts_reach_a_fold_in_small_batches(spark, make_notes, make_vaults, monkeypatch):
    """However many texts a task reads, few of them are in its worker at a time."""
    fold = commands._stream_groups

    def checked(batches):
        def small():
            for batch in batches:
                assert batch.nbytes < 9 << 20, "too much text at once"
                yield batch

        yield from fold(small())

    monkeypatch.setattr(commands, "_stream_groups", checked)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    notes = make_notes([("v", "a.md", "x")]).selectExpr(
        "vault", "inline(transform(sequence(1, 100), i -> struct(concat('n', i, '.md') AS path, repeat(cast(i % 10 as string), 400000) AS content)))"
    ).withColumn("content_hash", F.sha2("content", 256))
    moves = notes.selectExpr("row_number() OVER (ORDER BY path) AS seq", "vault", "path", "concat('to/', path) AS dest")
    moved = commands.move_notes(notes, make_vaults("v"), moves).notes
    assert moved.filter("path LIKE 'to/%' AND length(content) = 400000").count() == 100


# -- many keys ------------------------------------------------------------------


@pytest.fixture()
def many_keys(monkeypatch):
    """Every batch counts as one of many keys."""
    for module in (common, commands):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    for module in (commands, corpus):
        monkeypatch.setattr(module, "is_small", lambda *_: False)
    monkeypatch.setattr("notelake.operators.properties.BROADCAST_ROWS", -1)


def _batch(spark):
    rows = [(1, "src1", "append", "en/000021.md"), (2, "src1", "create", "new.md"), (3, "src2", "delete", "en/000022.md"), (4, "src3", "update", "Daily/2024-01-01.md")]
    df = spark.createDataFrame(rows, "seq bigint, vault string, op string, path string")
    nothing = F.lit(None).cast("string")
    return df.select("*", nothing.alias("dest"), F.lit("x").alias("body"), nothing.alias("expected_hash"), F.lit(True).alias("overwrite"))


def test_a_key_filter_lets_little_pass(stored):
    keys = stored.select("vault", "path").limit(20)
    touched = common.KeyFilter.of(keys, "vault", "path")
    passed = touched.possible(stored)
    assert passed.join(keys, ["vault", "path"], "left_semi").count() == 20
    assert passed.count() <= 25 and passed.count() + touched.others(stored).count() == stored.count()
    assert common.KeyFilter.of(keys.limit(0), "vault", "path").possible(stored).count() == 0
    text = plan(passed.join(keys, ["vault", "path"], "left_semi"))
    assert "BroadcastExchange" in text and re.search(r"getbit", text)


def test_untouched_notes_stay_out_of_shuffles(spark, stored, sf_dir, many_keys):
    """Of many keys a bitmap is broadcast; what it lets pass is joined, and nothing else is shuffled."""
    vaults = derived.vaults(spark, sf_dir)
    applied = apply_commands(stored, None, vaults, _batch(spark))
    text = plan(applied.notes)
    assert text.count("getbit") >= 2 and not re.search(r"BroadcastExchange.*\n.*path", text)
    asked = corpus.read_notes(stored, vaults, _batch(spark).select("vault", "path"))
    assert "getbit" in plan(asked)
    assert {r.path: r.status for r in asked.collect()}["en/000021.md"] == "OK"


def test_many_keys_give_what_few_give(spark, stored, sf_dir, monkeypatch):
    vaults = derived.vaults(spark, sf_dir)
    updates = _batch(spark).select("seq", "vault", "path", F.array(F.struct(F.lit("k").alias("k"), F.lit("1").alias("v"))).alias("properties"))

    def everything():
        applied, updated = apply_commands(stored, None, vaults, _batch(spark)), update_frontmatter(stored, vaults, updates)
        frames = (applied.notes.select("vault", "path", "content_hash"), applied.results, updated.notes.select("vault", "path", "content_hash"), corpus.read_notes(stored, vaults, updates.select("vault", "path")))
        return [sorted(map(str, f.collect())) for f in frames]

    few = everything()
    for module in ("commands", "properties"):
        monkeypatch.setattr(f"notelake.operators.{module}.BROADCAST_ROWS", -1)
    for module in (commands, corpus):
        monkeypatch.setattr(module, "is_small", lambda *_: False)
    assert everything() == few


def test_text_bounds_a_broadcast(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert common.is_small(df, 10, 10_000) and not common.is_small(df, 9, 10_000) and not common.is_small(df, 10, 9_999)
