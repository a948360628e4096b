import pytest

import __spark_entry__ as entry
from notelake.plans.suite import SUITE
from oracle import compare, connect

# One query per kind; the whole suite runs with `python tests/oracle.py <table folder>`.
CHECKED = (
    "frontmatter_text", "search_notes", "list_directory", "tag_counts", "backlinks", "project_context",
    "project_activity", "read_notes", "apply_commands", "append_daily_notes", "stream_tag_counts",
)


def test_every_query_has_checking_sql():
    assert set(SUITE) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["vault", "tag", "count"]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, sf_dir, name):
    ok, note, _ = compare(
        spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir
    )
    assert ok, note
