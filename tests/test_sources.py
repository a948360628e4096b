import json
import os

import pytest
from pyspark.sql import functions as F

import model
from notelake.operators import commands as cmd
from notelake.sources.files import scan_notes, scan_trash
from notelake.sources.registry_file import load_vaults, save_vaults
from notelake.sources.tables import NoteStore, save_notes


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "v"

    def put(path, data=b"x"):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    for path in ("Sub/a.md", "a/b/c/d/e/f.md", "_b.md", "_under/e.md", ".g.md", "UP.MD", "dir.md/n.md"):
        put(path, path.encode())
    put("empty.md", b"")
    put("bad.md", b"ok \xff\xfe caf\xc3\xa9")
    put("bom.md", b"\xef\xbb\xbfx")
    for path in ("Sub/b.txt", "Sub/.hidden/c.md", ".trash/t.md", ".trash/deep/u.md", "node_modules/m.md"):
        put(path)
    put(".trash/x.txt")
    os.symlink(root / "Sub" / "a.md", root / "link.md")
    os.symlink(root / "Sub", root / "linked")
    return root


def test_scan(spark, folder, tmp_path):
    vaults = spark.createDataFrame([("v", str(folder))], "name string, path string")
    rows = {r.path: r for r in scan_notes(spark, vaults, 4).collect()}
    assert set(rows) == {
        "Sub/a.md", "a/b/c/d/e/f.md", "_b.md", "_under/e.md", ".g.md", "UP.MD", "dir.md/n.md",
        "empty.md", "bad.md", "bom.md",
    }
    assert rows["empty.md"].content == ""
    assert rows["bad.md"].content == "ok �� café"
    assert rows["bom.md"].content == "﻿x"
    for r in rows.values():
        assert r.content_hash == model.sha(r.content)


def test_scan_trash(spark, folder, tmp_path):
    (tmp_path / "w").mkdir()
    vaults = spark.createDataFrame(
        [("v", str(folder)), ("w", str(tmp_path / "w"))], "name string, path string"
    )
    assert [(r.vault, r.path) for r in scan_trash(spark, vaults, 2).collect()] == [("v", ".trash/t.md")]


def test_registry_file(spark, tmp_path):
    file = tmp_path / "vaults.json"
    file.write_text(
        json.dumps(
            {
                "vaults": {
                    "one": {"path": "/r/one"},
                    "two": {"path": "/r/two", "readOnly": True, "dailyNotes": {"directory": "J"}},
                    "far": {"path": "/rest/far"},
                }
            },
            indent=2,
        )
    )
    rows = {r.name: r for r in load_vaults(spark, str(file), "/r").collect()}
    assert set(rows) == {"one", "two"}
    assert tuple(rows["one"].daily_notes) == ("Daily", "YYYY-MM-DD") and not rows["one"].read_only
    assert tuple(rows["two"].daily_notes) == ("J", "YYYY-MM-DD") and rows["two"].read_only
    saved = str(tmp_path / "saved")
    save_vaults(load_vaults(spark, str(file)), saved)
    again = load_vaults(spark, saved, lines=True)
    assert {r.name for r in again.collect()} == {"one", "two", "far"}
    assert load_vaults(spark, str(tmp_path / "none.json")).count() == 0
    for text in ('{"vaults": {"a": ', '{"vaults": {"a/b": {"path": "/r/x"}}}', '{"vaults": {"a": {"path": " "}}}'):
        bad = tmp_path / "bad.json"
        bad.write_text(text)
        with pytest.raises(Exception):
            load_vaults(spark, str(bad)).collect()


def test_note_store(spark, tmp_path, make_notes, make_vaults, make_commands):
    path = str(tmp_path / "store")
    notes = make_notes([("001", "a.md", "A"), ("001", "b.md", "B"), ("w=x", "c/d.md", "")])
    assert save_notes(notes, path) == 0
    store = NoteStore(spark, path)
    vaults = make_vaults("001", "w=x")
    first = cmd.apply_commands(
        store.notes(), store.trash(), vaults,
        make_commands(dict(vault="001", op="append", path="a.md", body="1"), dict(vault="001", op="delete", path="b.md")),
    )
    assert store.append(first) == 1
    second = cmd.apply_commands(
        store.notes(), store.trash(), vaults,
        make_commands(
            dict(vault="001", op="append", path="a.md", body="2"),
            dict(vault="w=x", op="create", path="b.md", body="new"),
            dict(vault="001", op="update", path="b.md", body="gone"),
        ),
    )
    assert store.append(second) == 2

    def state(df):
        return {(r.vault, r.path): r.content for r in df.collect()}

    want = {("001", "a.md"): "A12", ("w=x", "c/d.md"): "", ("w=x", "b.md"): "new"}
    assert state(store.notes()) == want
    assert state(store.notes(before=2)) == {("001", "a.md"): "A1", ("w=x", "c/d.md"): ""}
    assert state(store.trash()) == {("001", ".trash/b.md"): "B"}
    assert sorted(r.status for r in store.results(2).collect()) == ["NOT_FOUND", "OK", "OK"]
    assert store.compact() == 2
    assert state(store.notes()) == want
    # a directory without its mark is not there yet
    os.remove(f"{path}/snapshot=2/_SUCCESS")
    assert state(store.notes()) == want and store._snapshot(None) == 0
    # storing nothing is a batch too
    empty = cmd.apply_commands(store.notes(), store.trash(), vaults, make_commands().limit(0))
    assert store.append(empty) == 3 and state(store.notes()) == want


def test_folder_filter_reaches_the_files(spark, tmp_path, make_notes):
    from notelake.operators.corpus import list_notes

    path = str(tmp_path / "store")
    save_notes(make_notes([("v", "Daily/x.md", "1"), ("v", "y.md", "2")]), path)
    listed = list_notes(NoteStore(spark, path).notes().filter(F.col("vault") == "v"), "Daily")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,Daily/)" in plan and "content:" not in plan
    assert [r.path for r in listed.collect()] == ["Daily/x.md"]
