"""Stores to folders and XML files and back, objects included."""

import html
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from thicket.model import TABLES
from thicket.operators.forest import names_on_path, preorder, root_paths
from thicket.operators.merge import store_diff
from thicket.operators.shared import resolve_shared
from thicket.session import materialize
from thicket.sinks import node_xml as NX
from thicket.sinks.export import export_html, html_files
from thicket.sources import node_xml as NR
from thicket.sources.store import Store, schema_of

RICH = "custom-colors"


def full_store(spark):
    """Every kind of object, marks to escape, shared nodes, ties of offsets, empty texts."""
    rows = {
        "node": [
            (1, "a & <b>", "x < y & \"z\"\nline 2 日本\n", RICH, "t1 t2", 3, 2**3 * 0xA0B0C0 + 7, True, True, True, 3, 10, 20),
            (2, "code", "if a < b:\n\tpass", "python", "", 0, 0, False, False, False, 0, 0, 0),
            (3, "empty", "", RICH, "", 0, 1, False, False, True, 1, 5, 6), (70, "plain", "p  q", "plain-text", "", 8, 0, False, False, False, 2, 0, 0),
        ],
        "children": [(1, 0, 1, 0), (2, 1, 1, 0), (3, 1, 2, 0), (70, 0, 2, 0), (71, 70, 1, 1), (72, 2, 1, 70)],
        "codebox": [(1, 4, "left", "SELECT '</p>' <&>\n", "sql", 500, 120, True, False, True), (1, 9, "center", "", "c", 30, 4, False, True, False)],
        "grid": [(1, 6, "left", None, 400, 400, [["h", "k<"], ["", "v\n2"], [" s ", "&"]], True, [0, 60]), (1, 4, "right", None, 60, 60, [["only"]], False, [])],
        "image": [
            (1, 0, "left", "h1-1", None, "", "state:coll", 0), (1, 1, "left", "note", None, "", "", 0), (1, 12, "left", "", bytes(range(256)) * 3, "", "webs http://a?b&c", 0),
            (1, 13, "right", "", b"\\frac{a}{b} <&>", "__ct_special.tex", "", 0), (1, 14, "left", "", b"data", "my file.tar", "", 1234), (1, 15, "left", "", b"data", "other.txt", "", 7),
            (3, 0, "left", "", b"png!", "", "node 1 h1-1", 0), (3, 0, "left", "", b"png!", "", "", 0),
        ],
        "bookmark": [(70, 1), (1, 2)],
    }
    return Store(**{t: spark.createDataFrame(rows[t], schema_of(t)) for t in TABLES})


def same(a, b):
    flat = lambda s: s.with_tables(grid=s.grid.drop("txt").withColumn("cells", F.col("cells").cast("string")).withColumn("col_widths", F.col("col_widths").cast("string")))
    x, y = flat(a), flat(b)
    for t in TABLES:
        left, right = (sorted(map(repr, getattr(s, t).collect())) for s in (x, y))
        assert left == right, t
    assert store_diff(a.with_tables(grid=x.grid), b.with_tables(grid=y.grid)).count() == 0


def test_folders_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(NX, "IDS_AT_ONCE", 2)
    store, folder = full_store(spark), f"{tmp_path}/12/a+b (1)"
    paths = root_paths(store.children)
    files = NX.export_multifile(store, paths)
    n = NX.write_files(files, folder)
    assert n == files.count() == 6 + 4 + 1 + 4  # nodes, fathers with children, bookmarks, blobs: three of one node, one of another
    (tmp_path / "12" / "a+b (1)" / "notes.txt").write_text("not the form's")
    (tmp_path / "12" / "a+b (1)" / "1" / "old").mkdir()
    (tmp_path / "12" / "a+b (1)" / "1" / "old" / "node.xml").write_text("<node")
    same(NR.load_multifile_store(spark, folder), store)
    NX.write_files(files, folder)  # again: the same files
    assert not list((tmp_path / "12").rglob(".*"))
    same(NR.load_multifile_store(spark, f"file://{folder}"), store)
    for path in (tmp_path / "12" / "a+b (1)" / "1").glob("node.xml"):
        xml.dom.minidom.parse(str(path))


def test_one_file(spark, tmp_path):
    store = full_store(spark)
    ordered = preorder(root_paths(store.children))
    text = "".join(r.piece for r in NX.export_xml(store, ordered).orderBy("pos").collect())
    (tmp_path / "s.xml").write_text(text, encoding="utf-8")
    doc = xml.dom.minidom.parseString(text.encode())
    assert len(doc.getElementsByTagName("node")) == 6 and len(doc.getElementsByTagName("encoded_png")) == 8
    same(NR.load_xml_corpus_store(spark, f"{tmp_path}/s.xml", keep_ids=True), store)


def test_runs_of_a_stored_text_are_kept(spark, tmp_path):
    store = full_store(spark)
    rich = '<?xml version="1.0" encoding="UTF-8"?>\n<node><rich_text weight="heavy">x &lt; </rich_text><rich_text link="webs http://a">y</rich_text></node>'
    kept = store.with_tables(node=store.node.withColumn("txt", F.when(F.col("node_id") == 1, F.lit(rich)).otherwise(F.col("txt"))))
    files = NX.export_multifile(kept, root_paths(store.children))
    body = files.where("path = '1/node.xml'").select(F.col("content").cast("string").alias("c")).head().c
    assert '<rich_text weight="heavy">x &lt; </rich_text><rich_text link="webs http://a">y</rich_text>' in body
    assert {r.node_id: r.txt for r in NR.multifile_store(files).node.collect()}[1] == "x < y"


def test_several_files_get_fresh_ids(spark):
    a = '<s><bookmarks list="5,9"/><node unique_id="5" name="m" prog_lang="custom-colors"><rich_text>t</rich_text><encoded_png char_offset="0" anchor="q"/>'
    a += '<node unique_id="9" name="k" master_id="5"/></node></s>'
    b = '<s><node unique_id="5" name="n" prog_lang="plain-text"><rich_text>u</rich_text><node unique_id="5" name="twin"><codebox char_offset="1"/></node></node></s>'
    store = NR.xml_corpus_store(spark.createDataFrame([("a", a), ("b", b)], "path string, text string"))
    kids = {r.node_id: (r.father_id, r.master_id) for r in store.children.collect()}
    assert kids == {1: (0, 0), 2: (1, 1), 3: (0, 0), 4: (3, 0)}
    assert sorted((r.node_id, r.name, r.txt) for r in store.node.collect()) == [(1, "m", "t"), (3, "n", "u"), (4, "twin", "")]
    assert [(r.node_id, r.anchor) for r in store.image.collect()] == [(1, "q")]
    assert sorted((r.node_id, r.sequence) for r in store.bookmark.collect()) == [(1, 1), (2, 2)]


def test_bodies_are_not_kept(spark, monkeypatch):
    """A read store keeps each text once and no body, however many nodes show the text."""
    store = full_store(spark)
    node = store.node.where("node_id = 1")
    many = node.join(spark.range(100, 400).withColumnRenamed("id", "n"), how="cross").withColumn("node_id", F.col("n")).drop("n")
    children = spark.range(100, 400).select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("father_id"), F.col("id").alias("sequence"), F.lit(0).cast("long").alias("master_id"))
    big = store.with_tables(node=store.node.unionByName(many), children=store.children.unionByName(children))
    files = NX.export_multifile(big, root_paths(big.children))
    kept = {}

    def keep(df, name="step", outlives=False):
        kept[name] = materialize(df, name, outlives)
        return kept[name]

    monkeypatch.setattr(NR, "materialize", keep)
    read = NR.multifile_store(files)
    assert not any("body" in df.columns for df in kept.values())
    assert 0 < kept["read-nodes"].where("txt IS NOT NULL").count() < 150 and read.parts[1].select("text_id").distinct().count() == 4
    assert read.node.where("node_id >= 100").select("txt").distinct().collect() == node.select("txt").collect()
    assert {r.node_id: r.sequence for r in read.children.where("father_id = 1").collect()}[399] == 302


def test_a_file_that_changes_while_it_is_read(spark, tmp_path, monkeypatch):
    """A text that has to be read again and is another by then ends the job; no node loses its text."""
    monkeypatch.setattr(NR, "TEXT_IN", 1_000_003)
    folder = str(tmp_path / "s")
    store = full_store(spark)
    NX.write_files(NX.export_multifile(store, root_paths(store.children)), folder)

    def keep(df, name="step", outlives=False):
        out = materialize(df, name, outlives)
        if name == "read-nodes":
            file = tmp_path / "s" / "1" / "2" / "node.xml"
            file.write_text(file.read_text().replace("pass", "exit"))
        return out

    monkeypatch.setattr(NR, "materialize", keep)
    with pytest.raises(RuntimeError, match="changed"):
        NR.load_multifile_store(spark, folder)


def test_texts_read_again_have_a_small_plan(spark, monkeypatch):
    """The second reading plans no more than the first: a filter on what a body holds would repeat it all in the plan."""
    monkeypatch.setattr(NR, "TEXT_IN", 1_000_003)
    store, sizes = full_store(spark), {}

    def keep(df, name="step", outlives=False):
        sizes[name] = len(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, name, outlives)

    monkeypatch.setattr(NR, "materialize", keep)
    files = NX.multifile_kinds(store, root_paths(store.children))
    assert {r.node_id: r.txt for r in NR.multifile_store(files).node.collect()} == {r.node_id: r.txt for r in store.node.collect()}
    assert sizes["texts"] < 1.5 * sizes["read-nodes"]


def test_no_nodes(spark):
    none = Store(**{t: spark.createDataFrame([], schema_of(t)) for t in TABLES})
    files = NX.export_multifile(none, root_paths(none.children))
    assert files.count() == 0 and NR.multifile_store(files).node.count() == 0


def test_pages_show_pictures_and_files(spark):
    store = full_store(spark)
    paths = root_paths(store.children)
    ordered, named = preorder(paths), names_on_path(paths, resolve_shared(store, "name").select("node_id", "name"))
    page = {r.node_id: r.html for r in export_html(store, ordered, named).collect()}
    for part in (
        '<a name="h1-1"></a>', '<a href="http://a?b&amp;c"><img src="images/1-1.png" alt="images/1-1.png" /></a>', '<img src="images/1-2.png" alt="images/1-2.png" />',
        '<table style="display:inline-table"><tr><td><a href="EmbeddedFiles/1-my file.tar">Linked file: my file.tar </a></td></tr></table>',
    ):
        assert page[1].count(part) == 1 and page[71].count(part) == 1, part
    target = next(r.file_name for r in export_html(store, ordered, named).collect() if r.node_id == 1)
    numbers = ["images/3-1.png", "images/3-2.png"]
    assert all(page[3].count(n) == 2 for n in numbers) and f'<a href="{html.escape(target)}#h1-1">' in page[3]
    single = {r.node_id: r.html for r in export_html(store, ordered, named, single_file=True).collect()}
    assert '<a href="#h1-1"><img' in single[3]
    files = {r.path: bytes(r.content) for r in html_files(store).collect()}
    assert files == {"images/1-1.png": bytes(range(256)) * 3, "EmbeddedFiles/1-my file.tar": b"data", "EmbeddedFiles/1-other.txt": b"data", "images/3-1.png": b"png!", "images/3-2.png": b"png!"}
