"""Texts kept once: what is written and moved, and sums and differences that nulls or large ids spoil."""

import re

from pyspark.sql import functions as F

from thicket.catalog.stores import _digest
from thicket.functions.grids import pad_cells
from thicket.model import TABLES
from thicket.operators import merge as M
from thicket.operators import sync as SY
from thicket.sinks.export import save_store
from thicket.sources import versions as V
from thicket.sources.files import csv_to_grid
from thicket.sources.store import Store, align_schema, join_texts, load_store, schema_of, split_texts
from thicket.sources.stored import encode_store


def store_of(spark, n=60, first=1):
    ids = spark.range(first, first + n).withColumnRenamed("id", "node_id")
    texts = F.when(F.col("node_id") % 3 == 0, "first text").when(F.col("node_id") % 3 == 1, "<node> is no XML")
    rows = {
        "node": ids.withColumns({"name": F.concat(F.lit("n"), "node_id"), "txt": texts, "syntax": F.when(F.col("node_id") % 2 == 0, "custom-colors").otherwise("plain-text")}),
        "children": ids.withColumns({"father_id": F.lit(0), "sequence": F.col("node_id"), "master_id": F.lit(0)}),
    }
    return Store(**{t: align_schema(rows[t], schema_of(t)) if t in rows else spark.createDataFrame([], schema_of(t)) for t in TABLES})


def rows_of(df):
    return sorted((r.asDict(True) for r in df.select("node_id", "name", "txt", "syntax").collect()), key=lambda r: r["node_id"])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_saved_store_holds_each_text_once(spark, tmp_path):
    store = store_of(spark)
    save_store(store, f"{tmp_path}/s")
    assert "txt" not in spark.read.parquet(f"{tmp_path}/s/node").columns
    assert spark.read.parquet(f"{tmp_path}/s/text").count() == 2
    assert rows_of(load_store(spark, f"{tmp_path}/s", decode=False).node) == rows_of(store.node)
    coded = encode_store(store)
    save_store(coded, f"{tmp_path}/x")
    assert rows_of(load_store(spark, f"{tmp_path}/x", decode=False).node) == rows_of(coded.node)
    want = [r | ({"txt": r["txt"] or ""} if r["node_id"] % 2 == 0 else {}) for r in rows_of(store.node)]
    assert rows_of(load_store(spark, f"{tmp_path}/x").node) == want


def test_queries_without_texts_join_none_and_filters_come_before(spark):
    store = store_of(spark).with_parts(*split_texts(store_of(spark).node))
    assert "Join" not in plan_of(store.node.where("syntax = 'sql'").select("node_id", "name"))
    ids = spark.range(3, 5).withColumnRenamed("id", "node_id")
    plan = plan_of(store.nodes(ids))
    assert plan.index("LeftOuter") < plan.index("LeftSemi")  # the outer plan comes first
    assert rows_of(store.nodes(ids)) == rows_of(store.node.where("node_id IN (3, 4)"))


def test_operators_move_rows_and_not_texts(spark):
    store = store_of(spark)
    pending = spark.createDataFrame([(1, True, False, False, True, False), (3, False, True, False, True, False), (5, False, False, False, True, True)], "node_id long, prop boolean, buff boolean, hier boolean, is_update boolean, removed boolean")
    changed = store.with_tables(node=store.node.withColumns({"name": F.lit("new"), "txt": F.lit("new text")}))
    got = {r["node_id"]: r for r in rows_of(SY.sync_store(store, pending, changed).node)}
    assert (got[1]["name"], got[1]["txt"]) == ("new", "<node> is no XML") and (got[3]["name"], got[3]["txt"]) == ("n3", "new text") and 5 not in got
    gone = M.export_subtree(store, store.children.withColumns({"path": F.array("node_id"), "pos": F.col("node_id")}), 4)
    assert rows_of(gone.node) == rows_of(store.node.where("node_id = 4"))
    assert gone.parts is not None


def test_sums_of_ids_beyond_a_long_end_no_job(spark):
    store = store_of(spark, n=3, first=4 * 10**18)
    assert {r["table_name"]: r["ids"] for r in _digest(store).collect()}["node"] is None
    small = {r["table_name"]: (r["n"], r["ids"]) for r in _digest(store_of(spark)).collect()}
    assert small["node"] == (60, 1830)


def test_stores_that_differ_in_where_a_null_stands_differ(spark):
    a = store_of(spark, n=4)
    b = a.with_tables(node=a.node.withColumns({"tags": F.col("name"), "name": F.lit(None).cast("string")}))
    assert M.store_diff(a, b).where("table_name = 'node'").count() == 8


def test_a_version_keeps_texts_apart_and_drops_those_that_no_node_names(spark, tmp_path):
    root, store = f"{tmp_path}/v", store_of(spark)
    V.create_versions(store, root, buckets=4)
    pending = spark.createDataFrame([(n, False, True, False, True, False) for n in range(3, 61, 3)], "node_id long, prop boolean, buff boolean, hier boolean, is_update boolean, removed boolean")
    V.write_changes(spark, root, pending, store.with_tables(node=store.node.withColumn("txt", F.lit("later"))))
    after = rows_of(V.read_version(spark, root).node)
    assert {r["txt"] for r in after if r["node_id"] % 3 == 0} == {"later"}
    kept = V.compact_texts(spark, root)
    assert V._read(spark, root, kept, "text").count() == 2 and rows_of(V.read_version(spark, root).node) == after
    V.forget_versions(spark, root)
    assert rows_of(V.read_version(spark, root).node) == after


def test_short_texts_are_dealt_to_many_tasks_and_read_once(spark):
    one = spark.range(1).select("id", F.lit('a,b\nc\n').alias("t")).coalesce(1)
    grids = csv_to_grid(one, "t", ["id"])
    assert grids.head()["cells"] == [["a", "b"], ["c", ""]]
    plan = plan_of(grids)
    assert "Repartition" in plan and "size" not in plan[plan.index("Repartition"):]
    # the cells stand once in the expression that pads them
    expression = spark.range(1).select(pad_cells(F.expr("array(array('needle'), array(cast(id as string)))")).alias("c"))
    assert plan_of(expression).count("needle") == 1


def written(spark, name):
    """The tables so named in the shared folder."""
    from glob import glob

    from thicket.session import shared_dir

    return set(glob(f"{shared_dir(spark).removeprefix('file:')}/thicket-{name}-*"))


def with_runs(spark):
    """A store with rich texts kept as XML under rows that are decoded, nodes without a text and texts shared by both kinds."""
    rows, texts = split_texts(encode_store(store_of(spark)).node)
    more = spark.createDataFrame([("shared",)], "txt string").select(F.unhex(F.substring(F.sha2("txt", 256), 1, 32)).alias("text_id"), "txt")
    rows = rows.withColumn("stored", F.col("syntax") == "custom-colors").withColumn("text_id", F.when(F.col("node_id") > 50, more.head()[0]).otherwise(F.col("text_id")))
    return store_of(spark).with_parts(rows, texts.unionByName(more).unionByName(more))


def test_a_save_and_an_encoding_of_texts_kept_apart_join_none_by_node(spark, tmp_path):
    store = with_runs(spark)
    known = written(spark, "rows")
    whole = store.with_tables(node=store.node)
    coded = encode_store(store)
    assert rows_of(coded.node) == rows_of(encode_store(whole).node)
    save_store(coded, f"{tmp_path}/x")
    version = V.create_versions(store, f"{tmp_path}/v", buckets=2, indexed=False)
    assert written(spark, "rows") == known  # rows were not split from their texts anew
    assert rows_of(load_store(spark, f"{tmp_path}/x", decode=False).node) == rows_of(coded.node)
    assert rows_of(load_store(spark, f"{tmp_path}/x").node) == [r | ({"txt": r["txt"] or ""} if r["node_id"] % 2 == 0 else {}) for r in rows_of(whole.node)]
    texts = spark.read.parquet(f"{tmp_path}/x/text")
    assert texts.count() == texts.select("text_id").distinct().count() == spark.read.parquet(f"{tmp_path}/x/node").where("text_id IS NOT NULL").select("text_id").distinct().count()
    assert version.number == 1 and rows_of(V.read_version(spark, f"{tmp_path}/v").node) == rows_of(whole.node)


def test_stores_are_compared_by_names_of_texts(spark):
    from thicket.operators import search as X

    store = with_runs(spark)
    opts = X.SearchOptions("text", match_case=True)
    other = X.replace_store_text(store, opts, "word")
    assert other.parts is not None
    # the same store with its texts in the rows
    changed = {r["node_id"]: r for r in rows_of(X.replace_text(store.node, opts, "word"))}
    assert changed and rows_of(other.node) == [changed.get(r["node_id"], r) for r in rows_of(store.node)]
    found = M.store_diff(store, other)
    assert not re.search(r"\btxt#", plan_of(found.where("table_name = 'node'")))
    assert sorted(map(tuple, found.collect())) == sorted((side, "node", i) for side in ("left", "right") for i in changed)
    assert M.store_diff(store, store.with_tables(node=store.node)).count() == 0


def test_rows_that_one_store_has_more_often_count_each_time(spark):
    store = store_of(spark, n=3)
    twice = store.with_tables(children=store.children.unionByName(store.children).unionByName(store.children.where("node_id = 2")))
    assert sorted(map(tuple, M.store_diff(twice, store).collect())) == [("left", "children", 1), ("left", "children", 2), ("left", "children", 2), ("left", "children", 3)]
    assert M.store_diff(store, twice).where("side = 'right'").count() == 4


def test_bookmarks_of_the_folder_form_need_no_written_files(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    known = written(spark, "files")
    got = entry.queries()["multifile_bookmarks"](spark, sf)
    want = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal < 0").orderBy("c_custkey").select((F.col("c_custkey") + 1001).alias("id")).collect()
    assert [tuple(r) for r in got.orderBy("sequence").collect()] == [(r["id"], i + 1) for i, r in enumerate(want)]
    assert written(spark, "files") == known
