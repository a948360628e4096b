import json
import random

import pytest
from pyspark.sql import functions as F

import model
from notelake.functions import frontmatter as fm
from notelake.operators.properties import update_frontmatter


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


NOTES = [
        ("---\ntags: [mast]\ncrew: four\n---\nText.", {"tags": ["mast"], "crew": "four"}, ["mast"]),
        ("no block", {}, []),
        ("---\n---\nempty block", {}, []),
        ("---\r\ntags: '#one, two'\r\n---\r\nx", {"tags": "#one, two"}, ["one", "two"]),
        ("---\ntags:\n  - a b\n  - '#c,d'\n  - 2\n  - 2026-01-02\n  - \"#\"\n---\n",
         {"tags": ["a b", "#c,d", 2, "2026-01-02T00:00:00.000Z", "#"]}, ["a", "b", "c", "d", ""]),
        ("---\nn: 1.50\ni: -3\np: +7\nb: yes\nt: True\nz: ~\ne:\ns: 'it''s'\nq: \"x\\ny\" # c\n---\n",
         {"n": 1.5, "i": -3, "p": 7, "b": "yes", "t": True, "z": None, "e": None, "s": "it's", "q": "x\ny"}, []),
        ("---\n# note\nurl: http://x.y/z?a=b\ntitle: A - b, c\n---\n", {"url": "http://x.y/z?a=b", "title": "A - b, c"}, []),
        ('---\ntags: [["p"], "q", {"z": "no"}]\nm: {"a":[1,{"b":null}]}\n---\n',
         {"tags": [["p"], "q", {"z": "no"}], "m": {"a": [1, {"b": None}]}}, ["p", "q"]),
        ("---\nd: 2026-07-30\nlist: [2026-07-30, 'x, y', z]\n---\n",
         {"d": "2026-07-30T00:00:00.000Z", "list": ["2026-07-30T00:00:00.000Z", "x, y", "z"]}, []),
        ("﻿---\na: b\n---\nx", {"a": "b"}, []),
]


def read(spark, notes):
    df = spark.createDataFrame(list(enumerate(notes)), "i int, content string")
    columns = [fm.frontmatter_text("content"), fm.frontmatter_error("content"), fm.frontmatter_tags("content")]
    return df.select("i", *[c.alias(a) for c, a in zip(columns, ("text", "error", "tags"))]).orderBy("i").collect()


def test_read(spark):
    for (note, properties, tags), row in zip(NOTES, read(spark, [n for n, _, _ in NOTES])):
        assert json.loads(row.text) == properties, note
        assert list(json.loads(row.text)) == list(properties)
        assert row.error is False and row.tags == tags, note


NESTED = [
    ("---\nauthor:\n  name: B\n  born: 1902\n  'odd key': [x, 2]\ntags: [keep]\n---\nx",
     {"author": {"name": "B", "born": 1902, "odd key": ["x", 2]}, "tags": ["keep"]}, ["keep"]),
    ("---\nsummary: |\n  first line\n    # no comment\n\n  last: line\ntags: [keep]\n---\n",
     {"summary": "first line\n  # no comment\n\nlast: line\n", "tags": ["keep"]}, ["keep"]),
    ("---\nfolded: >-\n  one\n  two\n\n  three\ntags:\n- keep\n---\n", {"folded": "one two\nthree", "tags": ["keep"]}, ["keep"]),
    ("---\ntags: [a,\n  b,\n  'c d'\n  ]\nn: 1\n---\n", {"tags": ["a", "b", "c d"], "n": 1}, ["a", "b", "c", "d"]),
    ("---\nm:\n  day: 2026-01-02\n  # between\n  e:\n---\n", {"m": {"day": "2026-01-02T00:00:00.000Z", "e": None}}, []),
]


def test_nested_values(spark):
    for (note, properties, tags), row in zip(NESTED, read(spark, [n for n, _, _ in NESTED])):
        assert json.loads(row.text) == properties, note
        assert row.error is False and row.tags == tags, note


FLOWS = [
    ("---\ntags: [a, [b, c]]\nn: 1\n---\n", {"tags": ["a", ["b", "c"]], "n": 1}, ["a", "b", "c"]),
    ("---\ntags:\n- a\n- [b, 'c d']\n- e\n---\n", {"tags": ["a", ["b", "c d"], "e"]}, ["a", "b", "c", "d", "e"]),
    ("---\ntags: [[a, [#b]], \"c\", {no: [d, 1.50], 'k 2': x: y}]\nk: 1\n---\n", None, []),
    ("---\ntags: [a, {no: [d, 1.50], 'k 2': 'it''s', 3: ~}, [],\n  [e f, ],]\n---\n",
     {"tags": ["a", {"no": ["d", 1.5], "k 2": "it's", "3": None}, [], ["e f"]]}, ["a", "e", "f"]),
    ("---\nup: [[Note|x]] # c\nm: {a: {b: 2026-01-02}, url: http://x.y/z}\nd: [[2026-01-02, ',2026-01-02T']]\n---\n",
     {"up": [["Note|x"]], "m": {"a": {"b": "2026-01-02T00:00:00.000Z"}, "url": "http://x.y/z"}, "d": [["2026-01-02T00:00:00.000Z", ",2026-01-02T"]]}, []),
    ("---\ntags: [a, [b, \"c]]\nk: 1\n---\n", None, []),
    ("---\ntags: [a, [b]\nk: 1\n---\n", None, []),
]


def test_nested_flow_collections(spark):
    for (note, properties, tags), row in zip(FLOWS, read(spark, [n for n, _, _ in FLOWS])):
        assert json.loads(row.text) == ({"k": 1} if properties is None else properties), note
        assert row.error is (properties is None) and row.tags == tags, note


DEEP = [
    ("a:\n  b:\n    c: 1\n    d: [x, {y: z}]\n  e: 2\nf: 3", {"a": {"b": {"c": 1, "d": ["x", {"y": "z"}]}, "e": 2}, "f": 3}, []),
    ("tags:\n  - a\n  -\n    - b", {"tags": ["a", ["b"]]}, ["a", "b"]),
    ("tags:\n- - b\n  - - c\n    - d\n- e", {"tags": [["b", ["c", "d"]], "e"]}, ["b", "c", "d", "e"]),
    ("people:\n  - name: Ann\n    age: 3\n    likes:\n    - tea\n    - jam\n  - name: Bo\n\n  -\n    name: Cy\ntags: x",
     {"people": [{"name": "Ann", "age": 3, "likes": ["tea", "jam"]}, {"name": "Bo"}, {"name": "Cy"}], "tags": "x"}, ["x"]),
    ("a:\n- b: 1\n  c:\n    - d\n- - e: 1\n    f: 2\n  - g\nh:\n  i:\n  j: ~\n", {"a": [{"b": 1, "c": ["d"]}, [{"e": 1, "f": 2}, "g"]], "h": {"i": None, "j": None}}, []),
    ("title: one two\n  three\n\n  four\nq: \"a\n  b\n\n  c \\n d\"\ns: 'it''s\n  on'\nu:\n  below the key\n  and on\n", {"title": "one two three\nfour", "q": "a b\nc \n d", "s": "it's on", "u": "below the key and on"}, []),
    ("tags: &t [a, b]\nmore: *t\nx: &s 'k'\ny: [*s, {z: *s}]\ndeep: &d\n  p: *s\nagain:\n- *d\n- &n 5\n- *n", {"tags": ["a", "b"], "more": ["a", "b"], "x": "k", "y": ["k", {"z": "k"}], "deep": {"p": "k"}, "again": [{"p": "k"}, 5, 5]}, ["a", "b"]),
    ("{tags: [a, b], m: {k: 'v, w'}, n: 1}", {"tags": ["a", "b"], "m": {"k": "v, w"}, "n": 1}, ["a", "b"]),
    ('{"tags": ["a"],\n "n": null,\n}', None, []),
    ("m:\n  text: |\n    - no: item\n      # no comment\n\n    end\n  keep: >+\n    a\n    b\n\n  last: 1\nl:\n- |-\n  x\n   y\n- z", {"m": {"text": "- no: item\n  # no comment\n\nend\n", "keep": "a b\n\n", "last": 1}, "l": ["x\n y", "z"]}, []),
    ("a: [x, # first\n  y, # it's\n  z]\nb:\n  # between\n  c: 1 # end\n  # after\nd: # nothing\n  - 1\n", {"a": ["x", "y", "z"], "b": {"c": 1}, "d": [1]}, []),
    ("tags: [\n  a,\n  b\n]\nm: {\n  k: 1\n}\nu: http://a:80/b#c\n", {"tags": ["a", "b"], "m": {"k": 1}, "u": "http://a:80/b#c"}, ["a", "b"]),
    ("a: |2\n    two\n  none\nb: 1\n", {"a": "  two\nnone\n", "b": 1}, []),
    ('"\\xfc": "\\x41\\t\\e[0m\\U0001F600 \\\\x41\\_\\\n  end"\n', {"ü": "A\t\x1b[0m😀 \\x41\xa0end"}, []),
    ("'a b': 1\n\"c\\td\": 2\n3: x\nm:\n  'k''k': 1\n  \"q\": 2", {"a b": 1, "c\td": 2, "3": "x", "m": {"k'k": 1, "q": 2}}, []),
    ("tags:\n  - x\n  - {name: y}\n  - [z]\n  - 5\n  - 'v w'\n  - ~\n", {"tags": ["x", {"name": "y"}, ["z"], 5, "v w", None]}, ["x", "z", "v", "w"]),
]


def test_blocks_of_any_depth(spark):
    for (block, properties, tags), row in zip(DEEP, read(spark, [f"---\n{b}\n---\nx" for b, _, _ in DEEP])):
        if properties is not None:
            assert (json.loads(row.text), row.error, row.tags) == (properties, False, tags), block
            assert list(json.loads(row.text)) == list(properties)


TEXTS = [
    "a", "two words", "x: y", "- dash", "#no", "it's", 'say "hi"', "12", "1.5", "true", "null", "2026-01-02", "[x]", "{y}", "é😀", "a,b", "*star", "&amp", "end:",
    "line one\nline two\n", "tab\there", "long " + "word " * 30, "", " lead", "trail ", "!bang", "%p", "@at", "`tick", "|", "> x", "?", "-", "~", "a\n\nb", "  two\n more\n",
]


def test_against_a_yaml_writer(spark):
    """Random values in all styles that a writer of YAML has."""
    yaml = pytest.importorskip("yaml")
    draw = random.Random(7)

    def value(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.5:
            return draw.choice([*TEXTS, 1, -7, 2.5, True, False, None])
        if kind < 0.75:
            return [value(depth - 1) for _ in range(draw.randint(0, 3))]
        return {draw.choice(["k", "key two", "n1", "q'q", "x-y", "über"]): value(depth - 1) for _ in range(draw.randint(0, 3))}

    held = [{f"p{j}": value(3) for j in range(draw.randint(1, 4))} for _ in range(150)]
    blocks = [
        yaml.safe_dump(
            m, default_flow_style=draw.choice([None, False, True]), indent=draw.choice([2, 3, 4]), width=draw.choice([30, 80, 1000]),
            allow_unicode=draw.random() < 0.7, sort_keys=False, default_style=draw.choice([None] * 9 + ["'", '"']),
        )
        for m in held
    ]
    cases = [(b, m) for b, m in zip(blocks, held) if "!!" not in b]
    for (block, want), row in zip(cases, read(spark, [f"---\n{b}---\nx" for b, _ in cases])):
        assert (json.loads(row.text), row.error) == (want, False), block


SCALARS = [
    ("1e3", 1000), ("0x1F", 31), (".5", 0.5), ("1_000", 1000), ("007", 7), ("-0b101", -5), ("+12", 12), ("0o7", "0o7"), ("08", "08"), ("1.", 1),
    ("1_0.2_5", 10.25), ("-1.5E-2", -0.015), ("1e-9", 1e-9), ("2.5e+30", 2.5e30), ("190:20:30", 685230), ("-1:30", -90), ("1:60", "1:60"), ("0", 0), ("-0", 0), ("1_", "1_"),
    (".inf", None), ("-.INF", None), (".nan", None), (".Nan", ".Nan"), ("1.2.3", "1.2.3"), ("12e", "12e"), ("TRUE", True), ("yes", "yes"), ("Null", None), ("nUll", "nUll"),
    ("2026-01-02", "2026-01-02T00:00:00.000Z"), ("2026-01-02T03:04:05Z", "2026-01-02T03:04:05.000Z"), ("2026-1-2 3:04:05.1", "2026-01-02T03:04:05.100Z"),
    ("2026-01-02 03:04:05 +2", "2026-01-02T01:04:05.000Z"), ("2026-01-02T03:04:05-02:30", "2026-01-02T05:34:05.000Z"), ("2026-1-2", "2026-1-2"), ("20260102", 20260102),
]


def test_scalars(spark):
    notes = [f"---\nv: {s}\ntags: [{s}]\n---\n" for s, _ in SCALARS]
    for (given, want), row in zip(SCALARS, read(spark, notes)):
        is_tag = isinstance(want, str) and not want.endswith("Z")
        assert (json.loads(row.text), row.error) == ({"v": want, "tags": [want]}, False), given
        assert row.tags == ([want] if is_tag else []), given


def test_merge_keeps_odd_scalars(spark, make_notes, make_vaults):
    notes = make_notes([("v", "a.md", "---\nbig: .inf\nday: 2026-01-02\nlist: [.nan, x]\nm:\n  k:\n  - 1\n---\nT")])
    after = update_frontmatter(notes, make_vaults("v"), commands(spark, [(1, "v", "a.md", [("z", "1")])])).notes.first()
    assert after.content == '---\nbig: .inf\nday: 2026-01-02T00:00:00.000Z\nlist: [.nan,"x"]\nm: {"k":[1]}\nz: 1\n---\nT'


# What cannot be read is left out by itself and flagged.
ODD = [
    ("---\na:\n  b: 1\n c: 1\ntags: [keep]\n---\nx", {"tags": ["keep"]}),
    ("---\n<<: {a: 1}\nm: !!set {x}\nn: *nobody\ntags: [keep]\n---\nx", {"tags": ["keep"]}),
    ("---\na: 'one' two\nb: [1] 2\nc: \"x\ntags: [keep]\n---\nx", {"tags": ["keep"]}),
    ("---\nm: {a: 1, a: 2}\nd:\n  k: 1\n  k: 2\nl:\n- a\n k: 1\ntags: [keep]\n---\nx", {"tags": ["keep"]}),
    ("---\na: 1\na: 2\ntags: [keep]\n---\n", {"a": 1, "tags": ["keep"]}),
    ("---\nnever closed", {}),
    ("---\n- just\n- a list\n---\n", {}),
    ("---\na: b: c\ntags: [keep]\n---\n", {"tags": ["keep"]}),
    ("---\nplain text\ntags: [keep]\n---\n", {"tags": ["keep"]}),
]


def test_odd_entries_hide_no_others(spark):
    for (note, want), row in zip(ODD, read(spark, [n for n, _ in ODD])):
        assert (json.loads(row.text), row.error, row.tags) == (want, True, want.get("tags", [])), note


def test_body(spark):
    assert one(spark, fm.frontmatter_body, "---\na: b\n---\nBody\n---\nrest") == "Body\n---\nrest"
    assert one(spark, fm.frontmatter_body, "--- \n---\nx") == "x"
    assert one(spark, fm.frontmatter_body, "----\nx") == "----\nx"


def test_flatten_tags(spark):
    for value, want in [
        ('"a, #b  ##c"', ["a", "b", "#c"]), ('[["x"],["y z"]]', ["x", "y", "z"]), ("2", []),
        ("null", []), ('{"a":"b"}', []), ('[1,true,null,"k"]', ["k"]), ('"#"', [""]), ('[{"m":["{x}"]},"n"]', ["n"]),
        ("[" + '{"k":[' * 12 + '"k"' + "]}" * 12 + ',"n"]', ["n"]),
    ]:
        assert one(spark, fm.flatten_tags, value) == want, value


def commands(spark, rows):
    schema = "seq bigint, vault string, path string, properties array<struct<k:string,v:string>>"
    return spark.createDataFrame(rows, schema)


def test_merge_keeps_body_and_order(spark, make_notes, make_vaults):
    notes = make_notes([
        ("v", "a.md", "---\ntags: [hull]\nstage: wet\nday: 2026-01-02\n---\nPlanks and pitch."),
        ("v", "plain.md", "Only text"),
        ("v", "odd.md", "---\na: !x\n  b:\n    c: d\nstage: wet\n---\nx"), ("v", "open.md", "---\na: b\n"),
    ])
    done = [("stage", '"dry"'), ("berths", '["n", "m"]')]
    applied = update_frontmatter(
        notes, make_vaults("v", "locked", read_only=("locked",)),
        commands(spark, [
            (1, "v", "a.md", done), (2, "v", "a.md", [("berths", "null"), ("new key:", "1"), ("berths", "2")]),
            (3, "v", "plain.md", done), (4, "v", "odd.md", done), (7, "v", "open.md", done), (5, "v", "none.md", done), (6, "locked", "a.md", done),
        ]),
    )
    results = {r.seq: r for r in applied.results.collect()}
    assert [results[i].status for i in range(1, 8)] == [
        "OK", "OK", "OK", "OK", "NOT_FOUND", "READ_ONLY", "UNREADABLE_FRONTMATTER",
    ]
    after = applied.notes.select(
        "path", "content", "content_hash", fm.frontmatter_text(F.col("content")).alias("p"),
        fm.frontmatter_body(F.col("content")).alias("body"),
    ).collect()
    rows = {r.path: r for r in after}
    assert rows["a.md"].p == (
        '{"tags":["hull"],"stage":"dry","day":"2026-01-02T00:00:00.000Z","berths":2,"new key:":1}'
    )
    assert rows["a.md"].body == "Planks and pitch."
    assert rows["a.md"].content_hash == results[2].content_hash != results[1].content_hash
    assert rows["plain.md"].p == '{"stage":"dry","berths":["n","m"]}' and rows["plain.md"].body == "Only text"
    assert rows["odd.md"].content == '---\na: !x\n  b:\n    c: d\nstage: "dry"\nberths: ["n", "m"]\n---\nx'
    assert rows["open.md"].content == "---\na: b\n"


def test_many_updates_equal_one_by_one(spark, make_notes, make_vaults):
    rows = [
        (3 * i, "v", "hot.md", [(f"k{i % 4}", str(i)), (f"x{i % 7}", "true")]) for i in range(40)
    ] + [(1000, "v", "cold.md", [("a", "1")])]
    notes = make_notes([("v", "hot.md", "---\nx3: no\n---\nbody"), ("v", "cold.md", "c")])
    together = update_frontmatter(notes, make_vaults("v"), commands(spark, rows))
    cut = update_frontmatter(
        notes, make_vaults("v"), commands(spark, rows), fold_commands=5, blocks=10
    )
    held = {"x3": "no"}
    for _, _, _, properties in rows[:-1]:
        held.update((k, json.loads(v)) for k, v in properties)
    for applied in (together, cut):
        texts = {r.path: r.content for r in applied.notes.collect()}
        got = texts["hot.md"].split("---\n")[1].strip().split("\n")
        want = [f"{k}: {json.dumps(v)}" for k, v in held.items()]
        assert got == [w.replace('"no"', '"no"') for w in want]
        assert texts["hot.md"].endswith("---\nbody")
    assert sorted(together.results.collect()) == sorted(cut.results.collect())
    last = [r for r in cut.results.collect() if r.seq == 117][0]
    assert last.content_hash == model.sha({r.path: r.content for r in cut.notes.collect()}["hot.md"])
