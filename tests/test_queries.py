"""Registered queries against their SQL twins on the smallest data."""

import re

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "fold_accents", "parse_link", "hier_name", "resolve_shared", "closure", "preorder", "sort_forest", "find_text", "all_matches",
    "replace_text", "rank_nodes", "merge_store", "delete_subtree", "export_text", "html_blocks", "outline_to_tree", "list_lines",
    "history", "audit_links", "sync_store", "stream_sync", "find_text_stored", "find_grid_stored",
    "stream_to_store", "sync_version", "watch_versions", "multifile_store", "export_html", "html_files", "indent_lists", "renumber_lists", "list_items",
    "indented_lines", "store_diff", "one_page", "duplicate_shared", "split_journal", "objects_before", "all_matches_objects", "style_runs",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, info = compare(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert ok, info


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert {"node_id", "hier_name", "line_content"} <= set(df.columns)
    queries, oracles = entry.queries(), entry.oracle_sql()
    own = [n for n in queries if not re.match(r"op\d+_|pipeline$", n)]  # not the training-text subpackage's
    assert set(oracles) <= set(queries) and set(own) <= set(oracles)


def test_registry_without_session():
    """The registry must load before any session exists."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    done = subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
