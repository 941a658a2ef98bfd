"""The pipeline, the registered queries with SQL, and life without the subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from odd import no_docs, odd_docs, words
from test_dedup import groups_by_hand, spans_by_hand

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(entry.__file__)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_ngram_jaccard", "op6_substring_dedup", "op10_warc", "op11_embedding_neighbours", "op12_conversation_repair", "op13_centroid_clusters"])
def test_query(spark, con, name):
    ok, info = compare(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert ok, info


def test_all_are_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_stages(spark):
    """Each stage's decisions against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        rows = sorted(before.items())
        if name == "n-gram jaccard join":
            expected, _ = groups_by_hand(rows)
            assert set(after) == {i for i, _, root in expected if i == root}
        elif name == "substring dedup":
            assert after == {i: kept if gone else before[i] for i, _, gone, kept, _ in spans_by_hand(rows, 13)}
        else:
            assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(words(t)) for t in after.values())
    assert {r.doc_id for r in packed} == {i for i, t in after.items() if words(t)}


def test_no_rows_through_all_stages(spark):
    docs = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark):
    """Rows without an id and rows that share one: the near-duplicate stage keeps one row of each group, packing all words."""
    docs = odd_docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "quality rules"):
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = corpus_pipeline.materialize(stages[name](spark, docs, SF))
        assert {(r.doc_id, r.text) for r in docs.collect()} <= before
    docs = odd_docs(spark)
    kept = corpus_pipeline.materialize(stages["n-gram jaccard join"](spark, docs, SF))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, n_groups = groups_by_hand(rows)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == n_groups
    blank = [t for t in rows if not words(t[1])]
    assert sorted(map(repr, (r for r in left if not words(r[1])))) == sorted(map(repr, blank))
    groups = {}
    for row, (_, _, least) in zip(rows, expected, strict=True):
        if words(row[1]):
            groups.setdefault((least, None if least is not None else row[1]), []).append(row)
    assert sorted(repr(r[0]) for r in left if words(r[1])) == sorted(repr(least) for least, _ in groups)
    cut = corpus_pipeline.materialize(stages["substring dedup"](spark, kept, SF))
    assert cut.count() == len(left)
    packed = corpus_pipeline.materialize(stages["best-fit packing"](spark, cut, SF)).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(words(r.text)) for r in cut.collect())


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/thicket", tmp_path / "thicket", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
