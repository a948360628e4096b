import glob
import random

import pytest
from pyspark.sql import Row, functions as F

import model
from notelake import schema as S
from notelake.operators.commands import apply_commands
from notelake.plans import derived, suite
from notelake.sources.tables import NoteStore, save_notes
from notelake.streaming import streams
from test_commands import PLAIN, random_batch


def feed(spark, tmp_path, commands, parts):
    """Write commands as ``parts`` files, in order, and stream them one per batch."""
    source = tmp_path / f"in{parts}"
    source.mkdir()
    size = -(-len(commands) // parts)
    names = [f.name for f in S.COMMANDS.fields]
    for i in range(parts):
        rows = [tuple(c.get(n) for n in names) for c in commands[i * size : (i + 1) * size]]
        df = spark.createDataFrame(rows, S.COMMANDS).coalesce(1)
        df.write.mode("append").parquet(str(source))
    return (
        spark.readStream.schema(S.COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(source))
    )


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


def replay(checkpoint, batch):
    """Forget that a batch was committed."""
    for name in (str(batch), f".{batch}.crc"):
        file = checkpoint / "commits" / name
        if file.exists():
            file.unlink()


def test_no_writer_replaces_what_another_stored(spark, tmp_path, make_notes, make_vaults):
    def appends(seq, body):
        return [{"seq": seq, "vault": "v", "op": "append", "path": "a.md", "body": body}]

    def stored():
        return store.notes().first().content

    vaults = make_vaults("v")
    store = NoteStore(spark, str(tmp_path / "store"))
    save_notes(make_notes([("v", "a.md", "A")]), store.path)
    names = [f.name for f in S.COMMANDS.fields]
    batch = spark.createDataFrame([tuple(c.get(n) for n in names) for c in appends(1, "+batch")], S.COMMANDS)
    store.append(apply_commands(store.notes(), store.trash(), vaults, batch))
    for name, body in (("one", "+first"), ("two", "+second")):
        (tmp_path / name).mkdir()
        stream = feed(spark, tmp_path / name, appends(1, body), 1)
        run(streams.stream_batches(stream, store, vaults), tmp_path / f"cp-{name}")
    assert stored() == "A+batch+first+second"
    store.compact()
    save_notes(store.notes(), store.path)
    (tmp_path / "three").mkdir()
    run(streams.stream_batches(feed(spark, tmp_path / "three", appends(1, "+third"), 1), store, vaults), tmp_path / "cp-three")
    assert stored() == "A+batch+first+second+third"


def test_commands_in_one_or_many_batches(spark, tmp_path, make_notes, make_vaults):
    notes, vaults, batch = random_batch(random.Random(11), 40, PLAIN, ["a.md", "b.md", "x/a.md"])
    want = model.run(notes, vaults, batch)
    table = make_vaults(*vaults, read_only=("locked",))
    for parts in (1, 3):
        store = NoteStore(spark, str(tmp_path / f"store{parts}"))
        save_notes(make_notes([(v, p, c) for (v, p), c in notes.items()]), store.path, 0)
        stream = feed(spark, tmp_path, batch, parts)
        run(streams.stream_batches(stream, store, table), tmp_path / f"cp{parts}")
        assert {(r.vault, r.path): r.content for r in store.notes().collect()} == want[0]
        assert {(r.vault, r.path): r.content for r in store.trash().collect()} == want[1]
        results = {r.seq: (r.vault, r.path, r.content_hash, r.status) for r in store.results().collect()}
        assert results == want[2]
        # the last batch once more, as after a lost commit: it replaces its own outcome
        replay(tmp_path / f"cp{parts}", parts - 1)
        run(streams.stream_batches(stream, store, table), tmp_path / f"cp{parts}")
        assert {(r.vault, r.path): r.content for r in store.notes().collect()} == want[0]
        assert store.results().count() == len(results)
        # ... and nothing if a snapshot holds it already
        store.compact()
        replay(tmp_path / f"cp{parts}", parts - 1)
        run(streams.stream_batches(stream, store, table), tmp_path / f"cp{parts}")
        assert {(r.vault, r.path): r.content for r in store.notes().collect()} == want[0]


def outcome_of(spark, folder):
    return spark.read.schema(streams.OUTCOME).parquet(str(folder))


def append(stream, notes, vaults, place):
    """Run a command stream into plain files."""
    rows = streams.stream_commands(stream, notes, vaults)
    run(rows.writeStream.format("parquet").option("path", str(place / "outcome")), place / "progress")


@pytest.mark.parametrize("parts", [1, 4])
def test_keyed_commands_equal_the_sequential_model(spark, tmp_path, make_notes, make_vaults, parts):
    notes, vaults, batch = random_batch(random.Random(13), 40, PLAIN, ["a.md", "b.md", "x/a.md", "../bad.md"])
    want = model.run(notes, vaults, batch)
    table, start = make_vaults(*vaults, read_only=("locked",)), make_notes([(v, p, c) for (v, p), c in notes.items()])
    stream = feed(spark, tmp_path, batch, parts)

    def check():
        outcome = outcome_of(spark, tmp_path / "outcome")
        got = {r.seq: (r.vault, r.path, r.content_hash, r.status) for r in outcome.filter("kind = 'result'").collect()}
        # A trash name always has its suffix here.
        assert {k: v[3] for k, v in got.items()} == {k: v[3] for k, v in want[2].items()}
        assert all(got[k][1:3] == v[1:3] for k, v in want[2].items() if not (v[1] or "").startswith(".trash/"))
        assert {(r.vault, r.path): r.content for r in streams.current_notes(start, outcome).collect()} == want[0]
        binned = outcome.filter("kind = 'trash'").collect()
        assert sorted(r.content for r in binned) == sorted(want[1].values())
        assert {r.path for r in binned} == {got[r.seq][1] for r in binned} and len({(r.vault, r.path) for r in binned}) == len(binned)

    append(stream, start, table, tmp_path)
    check()
    # The last batch once more, as after a lost commit.
    replay(tmp_path / "progress", parts - 1)
    append(stream, start, table, tmp_path)
    check()


def test_keyed_commands_go_on_after_a_restart_and_beside_another_query(spark, tmp_path, make_notes, make_vaults):
    vaults, start = make_vaults("v"), make_notes([("v", "a.md", "A"), ("v", "z.md", "Z")])
    source = tmp_path / "in"
    names = [f.name for f in S.COMMANDS.fields]

    def put(folder, *commands):
        spark.createDataFrame([tuple(c.get(n) for n in names) for c in commands], S.COMMANDS).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(S.COMMANDS).parquet(str(folder))

    one = {"vault": "v", "op": "append", "path": "a.md"}
    append(put(source, one | {"seq": 1, "body": "+1"}), start, vaults, tmp_path / "first")
    append(put(source, one | {"seq": 2, "body": "+2"}, {"seq": 3, "vault": "v", "op": "move", "path": "a.md", "dest": "b.md"}), start, vaults, tmp_path / "first")
    after = streams.current_notes(start, outcome_of(spark, tmp_path / "first" / "outcome"))
    assert {r.path: r.content for r in after.collect()} == {"a.md": "A+1+2", "z.md": "Z"}
    assert {r.seq: r.status for r in outcome_of(spark, tmp_path / "first" / "outcome").collect() if r.kind == "result"} == {1: "OK", 2: "OK", 3: "UNKNOWN_OP"}
    append(put(tmp_path / "in2", one | {"seq": 1, "body": "+other"}), after, vaults, tmp_path / "second")
    last = streams.current_notes(after, outcome_of(spark, tmp_path / "second" / "outcome"))
    assert {r.path: r.content for r in last.collect()} == {"a.md": "A+1+2+other", "z.md": "Z"}


def daily(spark, place, batches, vaults, notes=None, **more):
    schema = "seq bigint, vault string, day string, body string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(place / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place / "in")).withColumn("day", F.to_date("day"))
    days = streams.stream_daily_notes(stream, vaults, notes, **more)
    run(days.writeStream.format("parquet").option("path", str(place / "days")), place / "progress")
    saved = spark.read.parquet(str(place / "days"))
    return {r.path: (r.content, r.version) for r in saved.groupBy("path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version")).collect()}


def test_late_entries_correct_their_day(spark, tmp_path, make_notes, make_vaults):
    vaults = make_vaults("v", "locked", read_only=("locked",), directory="Journal")
    batches = [
        [(5, "v", "2026-07-30", "e"), (2, "v", "2026-07-30", "b"), (1, "locked", "2026-07-30", "x"), (9, "gone", "2026-07-30", "x"), (8, "v", None, "x")],
        [(6, "v", "2026-08-02", "new")],
        [(3, "v", "2026-07-30", "c"), (4, "v", "2026-07-30", None), (7, "v", "2020-01-01", "old")],
    ]
    notes = make_notes([("v", "Journal/2020-01-01.md", "was ")])
    assert daily(spark, tmp_path, batches, vaults, notes) == {
        "Journal/2026-07-30.md": ("bce", 2), "Journal/2026-08-02.md": ("new", 1), "Journal/2020-01-01.md": ("was old", 1),
    }


def test_settled_days_are_appended_to(spark, tmp_path, make_vaults):
    vaults = make_vaults("v", directory="Journal")
    batches = [[(5, "v", "2026-07-30", "e")], [(1, "v", "2026-08-02", "n")], [(2, "v", "2026-08-03", "m")], [(3, "v", "2026-07-30", "c")]]
    assert daily(spark, tmp_path, batches, vaults, settle_seconds=0, slack="0 seconds")["Journal/2026-07-30.md"] == ("ec", 2)


def test_windowed_daily_notes(spark, sf_dir, tmp_path):
    events = derived.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        derived.event_vault().alias("vault"),
        F.col("ts").cast("timestamp").alias("ts"),
        derived.event_line().alias("body"),
    )
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    vaults = derived.vaults(spark, sf_dir)
    writer = (
        streams.windowed_daily_notes(stream, vaults)
        .writeStream.format("memory").queryName("windowed_days").outputMode("append")
    )
    run(writer, tmp_path / "cp")
    emitted = {(r.vault, r.path): r.content for r in spark.table("windowed_days").collect()}
    from notelake.operators.commands import daily_notes_from_events

    entries = events.select("seq", "vault", F.to_date("ts").alias("day"), "body")
    whole = {(r.vault, r.path): r.content for r in daily_notes_from_events(entries, vaults).collect()}
    assert 0 < len(emitted) < len(whole)
    assert all(whole[k] == v for k, v in emitted.items())


def test_tag_counts_take_edits_back(spark, tmp_path):
    schema = "vault string, path string, content string, prior_content string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("v", "a.md", "#x #y", None), ("v", "b.md", "#x", None)], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("v", "a.md", "#x #z", "#x #y"), ("v", "b.md", None, "#x")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = streams.stream_tag_counts(stream).writeStream.format("memory").queryName("live_tags").outputMode("complete")
    run(writer, tmp_path / "cp")
    got = {r.tag: r["count"] for r in spark.table("live_tags").collect() if r["count"]}
    assert got == {"x": 1, "z": 1}


def test_tag_counts_remember_what_notes_had(spark, tmp_path):
    schema = "seq bigint, vault string, path string, content string"
    source = str(tmp_path / "in")
    batches = [
        [(1, "v", "a.md", "#x #y #y"), (2, "v", "b.md", "---\ntags: [x, z]\n---\n"), (3, "v", ".h/c.md", "#hidden"), (4, "v", "d.txt", "#no"), (5, "w", "e.md", "#x")],
        [(7, "v", "a.md", "#x #y #new"), (6, "v", "a.md", "#lost"), (8, "w", "e.md", None), (9, "v", "f.md", None)],
        [(10, "v", "b.md", "none"), (11, "w", "e.md", "#back")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = streams.stream_tag_counts(stream).writeStream.format("memory").queryName("kept_tags").outputMode("complete")
    run(writer, tmp_path / "cp")
    got = {(r.vault, r.tag): r["count"] for r in spark.table("kept_tags").collect() if r["count"]}
    assert got == {("v", "x"): 1, ("v", "y"): 1, ("v", "new"): 1, ("w", "back"): 1}


@pytest.mark.parametrize("name, folder, batches", [("stream_tag_counts", "notes", 3), ("stream_daily_notes", "entries", 2)])
def test_what_a_stream_takes_in_is_spread(spark, sf_dir, tmp_path, monkeypatch, name, folder, batches):
    """Every batch is many files, so no task writes or reads all of it; the state lasts from one run to the next."""
    files, run_stream = [], suite._run_stream

    def counted(writer, place):
        files.append(len(glob.glob(f"{place.removeprefix('file:')}/{folder}/part-*")))
        run_stream(writer, place)

    monkeypatch.setattr(suite, "_run_stream", counted)
    given = derived.table(spark, sf_dir, "events").repartition(3)
    given.write.parquet(str(tmp_path / "events.parquet"))
    for other in ("documents",):
        derived.table(spark, sf_dir, other).write.parquet(str(tmp_path / f"{other}.parquet"))
    assert suite.SUITE[name][0](spark, str(tmp_path)).count() > 0
    assert len(files) == batches and files[0] > 1
    assert all(later - former > 1 for former, later in zip(files, files[1:]))


class Held:
    """Keyed state of one key."""

    def __init__(self, value=None):
        self.value = value

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_states_take_plain_rows():
    """A note with a row or two costs no frame."""
    tags = streams._Tags()
    tags.tags = Held((["a", "c"],))
    rows = [Row(seq=2, tags=["a", "b", "b"]), Row(seq=1, tags=["x"])]
    assert {tuple(r) for r in tags.handleInputRows(("v", "n.md"), iter(rows), None)} == {("v", "b", 2), ("v", "c", -1)}
    assert list(tags.handleInputRows(("v", "n.md"), iter([Row(seq=3, tags=None)]), None)) and tags.tags.value == ([],)

    note = streams._Commands()
    note.note, note.begun = Held(), None
    for content in ("A", "B"):
        note.handleInitialState(("v", "n.md"), Row(content=content), None)
    rest = {"status": S.OK, "expected_hash": "", "overwrite": False}
    commands = [Row(seq=None, op="append", body="+last", **rest), Row(seq=5, op="append", body="+5", **rest), Row(seq=4, op="create", body="new", **rest)]
    got = list(note.handleInputRows(("v", "n.md"), iter(commands), None))
    assert [(r.kind, r.seq, r.status) for r in got] == [("result", 4, S.EXISTS), ("result", 5, S.OK), ("result", None, S.OK), ("change", None, S.OK)]
    assert note.note.value == ("A+5+last", 1)
