import random

import pytest
from pyspark.sql import functions as F

import model
from notelake.operators import commands as cmd, linked


def outcome(applied):
    results = {r.seq: (r.vault, r.path, r.content_hash, r.status) for r in applied.results.collect()}
    notes = {(r.vault, r.path): r.content for r in applied.notes.collect()}
    trash = {(r.vault, r.path): r.content for r in applied.trashed.collect()}
    return notes, trash, results


def test_command_sequence(make_notes, make_vaults, make_commands):
    one, stale = model.sha("one"), model.sha("nope")
    applied = cmd.apply_commands(
        make_notes([("v", "other.md", "o")]),
        None,
        make_vaults("v"),
        make_commands(
            dict(vault="v", op="create", path="a.md", body="one"),
            dict(vault="v", op="create", path="a.md", body="again"),
            dict(vault="v", op="update", path="a.md", body="two", expected_hash=one),
            dict(vault="v", op="update", path="a.md", body="three", expected_hash=stale),
            dict(vault="v", op="append", path="a.md", body="\nthree"),
        ),
    )
    notes, _, results = outcome(applied)
    assert notes == {("v", "a.md"): "two\nthree", ("v", "other.md"): "o"}
    assert [results[i][3] for i in range(1, 6)] == ["OK", "EXISTS", "OK", "HASH_MISMATCH", "OK"]
    assert results[5][2] == model.sha("two\nthree")


@pytest.mark.parametrize("hot", [False, True])
def test_racing_updates_have_one_winner(make_notes, make_vaults, make_commands, hot):
    expected = model.sha("start")
    limits = dict(fold_commands=3, blocks=4) if hot else {}
    applied = cmd.apply_commands(
        make_notes([("v", "a.md", "start")]),
        None,
        make_vaults("v"),
        make_commands(
            *[dict(vault="v", op="update", path="a.md", body=f"w{i}", expected_hash=expected) for i in range(12)]
        ),
        **limits,
    )
    statuses = [r.status for r in applied.results.collect()]
    assert statuses.count("OK") == 1 and statuses.count("HASH_MISMATCH") == 11
    assert applied.notes.first().content == "w0"


def test_first_writer_wins(make_notes, spark):
    notes = make_notes([("v", "a.md", "start"), ("v", "b.md", "b")])
    h = model.sha("start")
    updates = spark.createDataFrame(
        [(7, "v", "a.md", h), (3, "v", "a.md", h), (1, "v", "a.md", "old"), (2, "v", "b.md", h)],
        "seq bigint, vault string, path string, expected_hash string",
    )
    got = {r.seq: r.status for r in cmd.first_writer_wins(notes, updates).collect()}
    assert got == {3: "OK", 7: "HASH_MISMATCH", 1: "HASH_MISMATCH", 2: "HASH_MISMATCH"}


def test_checks_come_in_order(make_notes, make_vaults, make_commands):
    applied = cmd.apply_commands(
        make_notes([("v", "a.md", "a")]),
        None,
        make_vaults("v", "locked", read_only=("locked",)),
        make_commands(
            dict(vault="none", op="create", path="../x.md"),
            dict(vault="locked", op="create", path="../x.md"),
            dict(vault="v", op="create", path="../x.md"),
            dict(vault="v", op="update", path="missing.md", body="x"),
            dict(vault="v", op="paint", path="a.md", body="x"),
            dict(vault="v", op="append", path="//a.md"),
            dict(vault="v", op="append", path="sub\\\\b.md"),
        ),
    )
    got = {r.seq: r.status for r in applied.results.collect()}
    assert got == {
        1: "NOT_REGISTERED", 2: "READ_ONLY", 3: "TRAVERSAL", 4: "NOT_FOUND",
        5: "UNKNOWN_OP", 6: "ABSOLUTE_PATH", 7: "NOT_FOUND",
    }
    assert applied.changes.count() == 0


def test_delete_keeps_names_apart(make_notes, make_vaults, make_commands, spark):
    trash = spark.createDataFrame(
        [("v", ".trash/b.md", "old", "h", "b.md")],
        "vault string, path string, content string, content_hash string, deleted_from string",
    )
    applied = cmd.delete_notes(
        make_notes([("v", "a.md", "1"), ("v", "x/a.md", "2"), ("v", "b.md", "3")]),
        trash,
        make_vaults("v"),
        make_commands(
            dict(vault="v", path="a.md"), dict(vault="v", path="x/a.md"),
            dict(vault="v", path="b.md"), dict(vault="v", path="a.md"),
        ),
    )
    got = {r.seq: (r.path, r.content_hash, r.status) for r in applied.results.collect()}
    assert got[1] == (".trash/a.md", None, "OK")
    assert got[2][0].startswith(".trash/a-") and len(got[2][0]) == len(".trash/a-.md") + 32
    assert got[3][0].startswith(".trash/b-")
    assert got[4][2] == "NOT_FOUND"
    assert {r.deleted_from for r in applied.trashed.collect()} == {"a.md", "x/a.md", "b.md"}
    assert applied.trash.count() == 4 and applied.notes.count() == 0


def test_moves(make_notes, make_vaults, make_commands):
    start = make_notes([("v", "a.md", "A"), ("v", "b.md", "B"), ("v", "s.md", "source")])
    applied = cmd.move_notes(
        start,
        make_vaults("v"),
        make_commands(
            dict(vault="v", path="a.md", dest="b.md"),
            dict(vault="v", path="s.md", dest="b.md", overwrite=True),
            dict(vault="v", path="a.md", dest="s.md"),
            dict(vault="v", path="a.md", dest="c.md"),
            dict(vault="v", path="b.md", dest="../x.md"),
            dict(vault="v", path="b.md", dest="b.md"),
            dict(vault="v", path="b.md", dest="b.md", overwrite=True),
        ),
    )
    notes, _, results = outcome(applied)
    assert [results[i][3] for i in range(1, 8)] == [
        "EXISTS", "OK", "OK", "NOT_FOUND", "TRAVERSAL", "EXISTS", "OK",
    ]
    assert notes == {("v", "b.md"): "source", ("v", "s.md"): "A"}


def test_a_chain_of_moves_takes_as_many_jobs_as_one(spark, make_notes, make_vaults, make_commands):
    start = make_notes([("v", "0.md", "text"), ("v", "other.md", "o")])

    def jobs_of(length):
        spark.sparkContext.setJobGroup(f"chain-{length}", "")
        batch = [dict(vault="v", path=f"{i}.md", dest=f"{i + 1}.md") for i in range(length)]
        applied = cmd.move_notes(start, make_vaults("v"), make_commands(*batch))
        assert {r.status for r in applied.results.collect()} == {"OK"}
        assert {(r.path, r.content) for r in applied.notes.collect()} == {(f"{length}.md", "text"), ("other.md", "o")}
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{length}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert jobs_of(8) <= jobs_of(1) + 2


@pytest.mark.parametrize("few", [0, 1000])
def test_groups_of_tied_notes(spark, few):
    rng = random.Random(few)
    edges = [(rng.choice("vw"), f"{a:03d}", f"{a + rng.choice([0, 1, 1, 7]):03d}") for a in range(0, 200) if rng.random() < 0.8]
    edges += [("v", "hub", f"h{i}") for i in range(100)] + [("w", f"{i:03d}c", f"{i + 1:03d}c") for i in rng.sample(range(60), 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for v, a, b in edges:
        low, high = sorted((find((v, a)), find((v, b))))
        root[high] = low
    df = spark.createDataFrame(edges, "vault string, a string, b string")
    got = {(r.vault, r.key): (r.vault, r.root) for r in linked.groups(df, len(edges), few).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_daily_appends(make_notes, make_vaults, spark):
    vaults = make_vaults("v", directory="Journal/", date_format="YYYY-MM-DD")
    entries = spark.createDataFrame(
        [(1, "v", "2026-07-30", "first"), (2, "v", "2026-07-30", "second")],
        "seq bigint, vault string, day string, body string",
    ).selectExpr("seq", "vault", "to_date(day) AS day", "body")
    applied = cmd.append_daily_notes(make_notes([]), vaults, entries)
    assert [(r.path, r.content) for r in applied.notes.collect()] == [
        ("Journal/2026-07-30.md", "firstsecond")
    ]
    built = cmd.daily_notes_from_events(entries, vaults).collect()
    assert [(r.path, r.content) for r in built] == [("Journal/2026-07-30.md", "firstsecond")]


def random_batch(rng, size, ops, names):
    """Random commands; some expected hashes are right at their turn."""
    notes = {("v", n): f"start {n}" for n in names if rng.random() < 0.5}
    vaults = {"v": False, "w": False, "locked": True}
    batch, seq = [], 0
    for _ in range(size):
        seq += rng.randint(1, 3)
        c = dict(
            seq=seq,
            vault=rng.choices(["v", "w", "locked", "gone"], [80, 15, 3, 2])[0],
            op=rng.choice(ops),
            path=rng.choice(names),
            body=rng.choice(["", "x", "yy\n", f"b{seq}"]),
            overwrite=rng.random() < 0.3,
        )
        if c["op"] == "move":
            c["dest"] = rng.choice([*names, "bad.txt"])
        if c["op"] == "update" and rng.random() < 0.7:
            state, _, _ = model.run(notes, vaults, batch)
            here = state.get((c["vault"], model.key_of(c["path"])), "")
            c["expected_hash"] = model.sha(here if rng.random() < 0.6 else here + "?")
        batch.append(c)
    return notes, vaults, batch


PLAIN = ["create", "update", "update", "append", "append", "append_daily", "delete"]


@pytest.mark.parametrize(
    "seed,ops,names,limits",
    [
        (1, PLAIN, ["a.md", "b.md", "x/a.md"], {}),
        (2, PLAIN, ["a.md", "b.md", "x/a.md"], dict(fold_commands=5, blocks=7)),
        (3, PLAIN, ["a.md"], dict(fold_commands=0, blocks=3)),
        (4, ["update", "append", "append"], ["a.md", "b.md"], dict(fold_commands=2, blocks=5)),
        (5, PLAIN + ["move", "move"], ["a.md", "b.md", "x//a.md", "c.md", "d.md"], {}),
        (6, PLAIN + ["move"], ["a.md", "b.md", "c.md"], dict(fold_commands=2, blocks=3)),
        (7, PLAIN + ["move"], ["a.md", "b.md", "x//a.md", "c.md"], dict(fold_chars=60, few_links=0)),
        (8, PLAIN + ["move"] * 9, [f"{i}.md" for i in range(12)], dict(few_links=0)),
        (9, ["move", "delete", "create"], [f"{i}.md" for i in range(8)], {}),
    ],
)
def test_against_sequential_model(spark, make_notes, make_vaults, make_commands, seed, ops, names, limits):
    size = 25 if "move" in ops else 120
    notes, vaults, batch = random_batch(random.Random(seed), size, ops, names)
    trash = spark.createDataFrame(
        [("v", ".trash/b.md", "old", "h", "b.md")],
        "vault string, path string, content string, content_hash string, deleted_from string",
    )
    applied = cmd.apply_commands(
        make_notes([(v, p, c) for (v, p), c in notes.items()]),
        trash,
        make_vaults(*vaults, read_only=("locked",)),
        make_commands(*batch),
        **limits,
    )
    expected = model.run(notes, vaults, batch, trash=[("v", ".trash/b.md")])
    got = outcome(applied)
    assert got[2] == expected[2]
    assert got[0] == expected[0]
    assert got[1] == expected[1]


def test_null_keys_and_racing_writers(spark, make_notes, make_vaults, make_commands):
    notes, vaults = make_notes([("v", "a.md", "A")]), make_vaults("v")
    applied = cmd.apply_commands(notes, None, vaults, make_commands({"vault": "v", "op": "create", "body": "x"}))
    assert [(r.path, r.status) for r in applied.results.collect()] == [(None, "TRAVERSAL")]
    assert applied.notes.count() == 1
    entries = spark.createDataFrame([(1, "v", None, "x")], "seq bigint, vault string, day date, body string")
    assert [r.status for r in cmd.append_daily_notes(notes, vaults, entries).results.collect()] == ["TRAVERSAL"]
    sha = model.sha("A")
    rows = [
        (1, "v", "a.md", "stale"), (2, "v", "a.md", sha), (3, "v", "a.md", sha), (4, "v", "a.md", ""), (5, "v", "a.md", None),
        (6, "v", "none.md", sha), (7, "v", "none.md", None),
    ]
    updates = spark.createDataFrame(rows, "seq bigint, vault string, path string, expected_hash string")
    got = {r.seq: r.status for r in cmd.first_writer_wins(notes, updates).collect()}
    assert got == {1: "HASH_MISMATCH", 2: "OK", 3: "HASH_MISMATCH", 4: "OK", 5: "OK", 6: "NOT_FOUND", 7: "NOT_FOUND"}
    # Only an empty hash counts as none, as in apply_commands.
    blank = spark.createDataFrame([(1, "v", "a.md", " ")], updates.schema)
    assert [r.status for r in cmd.first_writer_wins(notes, blank).collect()] == ["HASH_MISMATCH"]
    same = make_commands({"vault": "v", "op": "update", "path": "a.md", "body": "x", "expected_hash": " "})
    assert [r.status for r in cmd.apply_commands(notes, None, vaults, same).results.collect()] == ["HASH_MISMATCH"]
    late = cmd.first_writer_wins(notes, updates.filter("seq in (3, 4)").withColumn("seq", 7 - F.col("seq")))
    assert {r.seq: r.status for r in late.collect()} == {3: "OK", 4: "HASH_MISMATCH"}
