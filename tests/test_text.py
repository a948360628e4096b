import pytest
from pyspark.sql import functions as F

from notelake.functions import paths, text

NBSP, LS = "\u00a0", "\u2028"


@pytest.fixture(scope="session")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("x")).first().x

    return run


def test_hash(value):
    assert value(text.content_hash(F.lit("one"))) == (
        "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"
    )


def test_hashtags(value):
    note = f"# Title\n#a #b/c x#no {NBSP}#nb ##x #123 (#p)\n#caf\u00e9{LS}#ls\t#t-1 # no\n#"
    assert value(text.hashtags(F.lit(note))) == ["a", "b/c", "nb", "123", "caf", "ls", "t-1"]
    assert value(text.hashtags(F.lit("none"))) == []


def test_wikilinks(value):
    note = "![[x]] [[a/b|c]] [[#h]] [[n|]] [[n#]] [[[q]] [[m#t]] [[l\nm]] [[ s ]] [[open"
    assert value(text.wikilinks(F.lit(note))) == ["x", "a/b", "[q", "m", "l\nm", " s "]


def test_normalize_link(value):
    got = [value(text.normalize_link(F.lit(s))) for s in ("a\\b.md", "A.MD", "x.md.md", "n.mdx", ".md")]
    assert got == ["a/b", "A", "x.md", "n.mdx", ""]


def test_tasks(value):
    note = "- [ ] one\n  - [x] two \n* [ ] star\n- [ ] \n- [X] b\n -[x] tight\nx - [ ] no\n- [ ]  "
    got = [tuple(t) for t in value(text.tasks(F.lit(note)))]
    assert got == [(False, "one"), (True, "two"), (False, "- [X] b"), (True, "tight")]


def test_sections(value):
    note = "pre\n## a\ntext\n### s\n##\n## b\n\n##nospace\n"
    assert value(text.sections(F.lit(note))) == ["pre", "## a\ntext\n### s", "##", "## b\n\n##nospace"]
    assert value(text.sections(F.lit("\n## one"))) == ["## one"]
    assert value(text.sections(F.lit(" \n "))) == []


def js_excerpt(content, query):
    body = " ".join(content.split())
    at = body.lower().find(query)
    return body[:180] if at < 0 else body[max(0, at - 70) : at + len(query) + 110]


@pytest.mark.parametrize(
    "content,query",
    [
        ("word " * 50 + "NEEDLE here " + "tail " * 60, "needle"), ("a  b\n\nc", "zz"), ("NEE x", "nee"),
        ("x" * 400, "y"), ("a  b", "a  b"), ("", "q"), ("\n lead NEEDLE", "needle"), ("x" * 70 + "k", "k"),
    ],
)
def test_excerpt(value, content, query):
    assert value(text.excerpt(F.lit(content), query)) == js_excerpt(content, query)


def test_truncate(value):
    mark = "\n[content truncated]"
    cases = [("hello", 5, ("hello", False)), ("hello", 3, ("hel" + mark, True)), ("hello", 0, (mark, True)),
             ("hello", -2, (mark, True)), ("", 0, ("", False)), ("a\U0001f600b", 2, ("a\U0001f600" + mark, True))]
    for content, n, want in cases:
        assert tuple(value(text.truncate_content(F.lit(content), n))) == want


def test_trim(value):
    assert value(text.trim_ws(F.lit(f"\n\t{NBSP} a b \ufeff{LS}\r\n"))) == "a b"


PATHS = [
        ("C:\\outside.md", "ABSOLUTE_PATH", "ABSOLUTE_PATH"), ("/outside.md", "ABSOLUTE_PATH", "ABSOLUTE_PATH"),
        ("\\outside.md", "ABSOLUTE_PATH", "ABSOLUTE_PATH"), ("../outside.md", "TRAVERSAL", "TRAVERSAL"),
        ("folder/../../outside.md", "TRAVERSAL", "TRAVERSAL"), ("folder\\..\\outside.md", "TRAVERSAL", "TRAVERSAL"),
        ("a\0.md", "NULL_BYTE", "NULL_BYTE"), ("", "TRAVERSAL", "TRAVERSAL"), ("..", "TRAVERSAL", "TRAVERSAL"),
        (".config/app.json", "MARKDOWN_REQUIRED", "EXCLUDED_PATH"), (".hidden/note.md", "EXCLUDED_PATH", "EXCLUDED_PATH"),
        ("notes.txt", "MARKDOWN_REQUIRED", "OK"), ("a.md", "OK", "OK"), ("a.MD/", "OK", "OK"), ("C:x.md", "OK", "OK"),
        (".a.md", "OK", "EXCLUDED_PATH"), ("./a.md", "EXCLUDED_PATH", "EXCLUDED_PATH"), ("a/.", "MARKDOWN_REQUIRED", "EXCLUDED_PATH"),
        ("x/Node_Modules/y.md", "EXCLUDED_PATH", "EXCLUDED_PATH"), ("x/.TRASH/y.md", "EXCLUDED_PATH", "EXCLUDED_PATH"),
        ("a..b/c.md", "OK", "OK"),
    ]


def test_path_status(spark):
    df = spark.createDataFrame(PATHS, "path string, note string, directory string")
    wrong = df.filter(
        (paths.path_status(F.col("path")) != F.col("note"))
        | (paths.path_status(F.col("path"), "directory") != F.col("directory"))
    )
    assert wrong.collect() == []


def test_paths(value):
    assert value(paths.normalize_path(F.lit("a\\\\b//c.md/"))) == "a/b/c.md"
    assert value(paths.relative_path("/v/a/", F.lit("/v/a/b\\c.md"))) == "b/c.md"
    assert value(paths.path_suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert [value(paths.is_inside(F.lit(p), "/a")) for p in ("/ab", "/a", "/a/b", "/a/", "/")] == [
        False, True, True, True, False,
    ]
    visible = [value(paths.is_visible(F.lit(p))) for p in (".g.md", "a/.h/b.md", "node_modules/x.md", "Node_Modules/x.md", "a.b/c.md")]
    assert visible == [True, False, False, True, True]
    day = F.to_date(F.lit("2026-07-03"))
    assert value(paths.daily_path(F.lit("Journal\\/"), F.lit("YYYY/[MM]DD 'day'"), day)) == "Journal/2026/[07]03 'day'.md"
    assert value(paths.daily_path(F.lit("D"), F.lit("DD-YYYYY"), day)) == "D/03-2026Y.md"
    names = [(value(paths.vault_name(F.lit(n))), value(paths.vault_name_valid(F.lit(n)))) for n in (" a ", "..", " ", "a/b", "a\\b", "\n")]
    assert names == [("a", True), ("..", False), ("", False), ("a/b", False), ("a\\b", False), ("", False)]
