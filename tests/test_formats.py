"""Import and export formats, files, streams and round trips."""

import time

from pyspark.sql import functions as F

from thicket.operators import merge as M
from thicket.operators import sync as SY
from thicket.sinks import export as E
from thicket.sources import files as FI
from thicket.sources import html as HT
from thicket.sources import markup as MK
from thicket.sources import xml_store as XS
from thicket.sources.store import align_schema, decode_nodes, encode_node_bits, load_store
from thicket.streaming import sync as ST

SF = "/root/testdata/sf0.001"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_note_with_empty_tag(spark):
    xml = (
        '<?xml version="1.0" encoding="utf-8"?>\n<note version="0.3">\n  <title>Pumps and valves</title>\n  <tags>\n    <tag></tag>\n'
        '  </tags>\n  <text>\n    <note-content version="0.1">Check the seals.</note-content>\n  </text>\n</note>\n'
    )
    skip = "<note><title>Some Long Notebook Template</title><text><note-content>x</note-content></text></note>"
    df = spark.createDataFrame([("a", xml), ("b", skip), ("c", "<note><title>t</title></note>")], "path string, text string")
    assert [(r.name, r.notebook, r.body) for r in XS.note_xml_records(df).collect()] == [("Pumps and valves", "", "Check the seals.")]


def test_encodings(spark, tmp_path):
    text = "Ünïcode 😀\nline"
    forms = {
        "u8": text.encode(), "u8bom": b"\xef\xbb\xbf" + text.encode(), "u16le": b"\xff\xfe" + text.encode("utf-16-le"),
        "u16be": b"\xfe\xff" + text.encode("utf-16-be"), "u32le": b"\xff\xfe\x00\x00" + text.encode("utf-32-le"), "u32be": b"\x00\x00\xfe\xff" + text.encode("utf-32-be"),
        "latin": "Ünïcode".encode("latin-1"),
    }
    for name, data in forms.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r.name: r.txt for r in FI.ingest_text(spark, str(tmp_path)).collect()}
    assert got == {n: ("Ünïcode" if n == "latin" else text) for n in forms}


def test_dir_tree(spark):
    paths = ["a/x.txt", "a/x/one.txt", "b/b.txt", "b/two.txt", "c.txt"]
    rows = FI.dir_to_tree(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    ids = {r.node_id: r.name for r in rows}
    assert sorted((ids.get(r.father_id, ""), r.name, r.has_content) for r in rows) == [
        ("", "a", False), ("", "b", True), ("", "c", True), ("a", "x", True), ("b", "two", True), ("x", "one", True),
    ]


def test_html(spark):
    html = "<h2>A &amp; B&#233;&#x1F600;</h2>text <b>bold</b><ul><li>one<li>two <a href='/x?a=1&amp;b=2'>L</a></ul><script>var p='<p>no</p>'</script>"
    got = [(r.kind, r.level, r.text) for r in HT.html_blocks(frame(spark, html), "t", ["id"]).orderBy("block_no").collect()]
    assert got == [("heading", 2, "A & Bé😀"), ("paragraph", 0, "text bold"), ("item", 0, "one"), ("item", 0, "two L")]
    assert [(r.href, r.text) for r in HT.html_links(frame(spark, html), "t", ["id"]).collect()] == [("/x?a=1&b=2", "L")]
    table = "<table><td>h</td><tr><td rowspan=3>a</td><td>b</td></tr><tr><th rowspan=0>z</th></tr></table>"
    assert HT.html_tables(frame(spark, table), "t", ["id"]).head().cells == [["h", "", "", ""], ["a", "", "", "b"], ["z", "", "", ""]]


def test_markdown_and_wiki(spark):
    md = "Title\n---\n\nSub\n----\n# H1\n#### H4\n~~~py\nx = 1\n# no\n~~~\n* item\ntext"
    got = [(r.kind, r.level, r.lang, r.content) for r in MK.markdown_blocks(frame(spark, md), "t", ["id"]).orderBy("line_no").collect()]
    assert got == [
        ("paragraph", 0, "", "Title"), ("paragraph", 0, "", "---"), ("heading", 2, "", "Sub"), ("heading", 1, "", "H1"), ("heading", 3, "", "H4"),
        ("code", 0, "py", "x = 1\n# no"), ("item", 0, "", "item"), ("paragraph", 0, "", "text"),
    ]
    wiki = "Creation-Date: x\n== Big ==\n======== Plain ========\n[>] later\n* a [[B]]"
    got = [(r.kind, r.level, r.content) for r in MK.wiki_blocks(frame(spark, wiki), "t", ["id"]).orderBy("line_no").collect()]
    assert got == [("heading", 3, "Big"), ("paragraph", 0, "======== Plain ========"), ("todo_dropped", 0, "later"), ("item", 0, "a [[B]]")]


def test_grid_xml_round_trip(spark):
    rows = [(1, [["h<", "&"], ["", "x\ny"]], True), (2, [["only"]], False)]
    g = spark.createDataFrame(rows, "node_id long, cells array<array<string>>, is_light boolean")
    xml = g.select("node_id", E.grid_to_xml(F.col("cells"), F.lit(3), F.lit("left"), F.lit(60), F.lit("10,20"), F.col("is_light")).alias("txt"))
    back = XS.parse_grid_xml(xml).orderBy("node_id").collect()
    assert [(r.node_id, r.cells, r.is_light, r.col_widths) for r in back] == [(i, c, l, [10, 20]) for i, c, l in rows]


def test_bits_round_trip(spark):
    rows = [(1, 3, (0x00FF10 << 3) | 7, 2), (2, 10, 1, 1), (3, 0, 0, 3)]
    node = spark.createDataFrame(rows, "node_id long, is_ro long, is_richtxt long, level long").withColumn("syntax", F.lit("custom-colors"))
    d = decode_nodes(node)
    assert [(r.read_only, r.custom_icon_id, r.foreground, r.exclude_me) for r in d.orderBy("node_id").collect()] == [
        (True, 1, "#00ff10", False), (False, 5, "", True), (False, 0, "", True)]
    assert encode_node_bits(d).select("node_id", "is_ro", "is_richtxt", "level").exceptAll(node.drop("syntax")).count() == 0


def test_old_store_columns(spark):
    old = spark.createDataFrame([(1, 0, 1)], "node_id long, father_id long, sequence long")
    assert align_schema(old, "node_id long, father_id long, sequence long, master_id long").head().master_id is None


def test_xml_files_and_folders(spark, tmp_path):
    (tmp_path / "s1.xml").write_text('<r><node unique_id="1" name="A &lt;1&gt;" readonly="TRUE"><rich_text>x</rich_text><node unique_id="2" name="B"/></node><node unique_id="1" name="C"></node></r>')
    got = XS.load_xml_corpus(spark, str(tmp_path / "*.xml")).orderBy("pos").collect()
    assert [(r.name, r.fixed_id, r.depth, r.read_only) for r in got] == [("A <1>", 1, 0, True), ("B", 2, 1, False), ("C", 3, 0, False)]
    root = tmp_path / "multi"
    (root / "5" / "6").mkdir(parents=True)
    (root / "5" / "node.xml").write_text('<node unique_id="5" name="five"></node>')
    (root / "5" / "6" / "node.xml").write_text('<node unique_id="6" name="six"></node>')
    (root / "subnodes.lst").write_text("5")
    (root / "5" / "subnodes.lst").write_text("6")
    got = XS.load_multifile(spark, str(root)).orderBy("node_id").collect()
    assert [(r.node_id, r.father_id, r.name, r.sequence) for r in got] == [(5, 0, "five", 1), (6, 5, "six", 1)]
    (root / "bookmarks.lst").write_text("6,5")
    marks = XS.multifile_bookmarks(XS.read_multifile(spark, str(root))).orderBy("sequence").collect()
    assert [(r.node_id, r.sequence) for r in marks] == [(6, 1), (5, 2)]
    text = spark.createDataFrame([("f", '<r><bookmarks list="3,x,1"/></r>'), ("g", "<r/>")], "path string, text string")
    assert [(r.path, r.node_id, r.sequence) for r in XS.xml_bookmarks(text).collect()] == [("f", 3, 1), ("f", 1, 2)]


def test_link_targets_in_runs(spark):
    from thicket.catalog.base import store
    from thicket.operators import search as X

    s = store(spark, SF)
    runs = XS.parse_runs_xml(
        spark.createDataFrame([(3, '<node><rich_text>ab</rich_text><rich_text link="webs http://old.x">c</rich_text></node>')], "node_id long, x string"), "x", ["node_id"]
    )
    links = XS.run_links(runs)
    assert [(r.node_id, r.offset, r.link) for r in links.collect()] == [(3, 2, "webs http://old.x")]
    found = X.find_link_targets(X.link_objects(s, links).where("source = 'text'"), X.SearchOptions("old")).collect()
    assert [(r.match_start, r.match_end) for r in found] == [(7, 10)]
    opts = X.SearchOptions("old", replace_in_link_targets=True)
    out = X.replace_in_objects(s, opts, "new", links)["run_link"].collect()
    assert [r.link for r in out] == ["webs http://new.x"]


def test_store_round_trip_and_blobs(spark, tmp_path):
    from thicket.catalog.base import store

    s = E.prepare_store(store(spark, SF))
    E.save_store(s, str(tmp_path / "store"))
    back = load_store(spark, str(tmp_path / "store"))
    diff = M.store_diff(s, back)
    assert diff.count() == 0
    blobs = str(tmp_path / "blobs")
    n = E.blob_store(s.image, blobs)
    assert n == s.image.where("png IS NOT NULL").select("png").distinct().count()
    assert E.blob_store(s.image, blobs) == 0


def test_pending_flags(spark):
    rows = [(1, "buff"), (2, "prop"), (3, "hier"), (4, "prop"), (4, "new"), (5, "buff"), (5, "remove"), (1, "buff")]
    got = {r.node_id: (r.prop, r.buff, r.hier, r.is_update, r.removed) for r in SY.coalesce_pending(spark.createDataFrame(rows, "node_id long, kind string")).collect()}
    assert got == {
        1: (False, True, False, True, False), 2: (True, False, False, True, False), 3: (False, False, True, True, False),
        4: (True, True, True, False, False), 5: (False, False, False, True, True),
    }


def test_watched_files_stream(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    q = ST.stream_latest_version(ST.watched_files(spark, str(src)), out, trigger={"availableNow": True}, checkpoint=str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in ST.latest_of_batches(spark, out).collect()}
    assert got == {"a.txt": "one", "b.txt": "two"}


def test_changed_files_are_read_again(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    (src / "sub" / "locked.txt").write_text("old")
    seen = lambda: {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in ST.latest_files(spark, out).collect()}

    def holders():
        return spark.createDataFrame([(f"file:{src}/sub/locked.txt", 7), (f"file:{src}/a.txt", 1)], "path string, node_id long")

    locked = spark.createDataFrame([(7,)], "node_id long")
    assert ST.latest_files(spark, out).count() == 0
    assert ST.poll_versions(spark, str(src), out, 0, holders(), locked) == 2
    assert seen() == {"a.txt": "one", "b.txt": "two"}
    assert ST.poll_versions(spark, str(src), out, 1, holders(), locked) == 0
    (src / "a.txt").write_text("one, longer")
    (src / "c.txt").write_text("three")
    (src / "b.txt").unlink()
    for _ in range(2):  # a repeated poll replaces itself
        assert ST.poll_versions(spark, str(src), out, 2, holders(), locked) == 3
        assert seen() == {"a.txt": "one, longer", "c.txt": "three"}
    (src / "b.txt").write_text("back")
    assert ST.poll_versions(spark, str(src), out, 3) == 2  # and locked.txt, as nothing is read-only now
    assert seen() == {"a.txt": "one, longer", "b.txt": "back", "c.txt": "three", "locked.txt": "old"}


def test_a_watching_stream_sees_overwritten_files(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("one")

    def wait_for(text):
        end = time.time() + 120
        while time.time() < end:
            if [bytes(r.content).decode() for r in ST.latest_files(spark, out).collect()] == [text]:
                return True
            time.sleep(1)
        return False

    start = lambda: ST.watch_versions(spark, str(src), out, trigger={"processingTime": "1 second"}, checkpoint=str(tmp_path / "cp"))
    q = start()
    try:
        assert wait_for("one")
        (src / "a.txt").write_text("two")
        assert wait_for("two")
    finally:
        q.stop()
    (src / "a.txt").write_text("three!")
    q = start()
    try:
        assert wait_for("three!")
    finally:
        q.stop()


def test_delete_hands_over_masters(spark):
    from thicket.operators.forest import root_paths
    from thicket.sources.store import Store, schema_of

    kids = spark.createDataFrame([(1, 0, 1, 0), (2, 1, 1, 0), (3, 0, 2, 2), (4, 0, 3, 2)], schema_of("children"))
    empty = lambda t: spark.createDataFrame([], schema_of(t))
    node = align_schema(spark.createDataFrame([(1, "one", "t1"), (2, "two", "t2")], "node_id long, name string, txt string"), schema_of("node"))
    s = Store(node=node, children=kids, codebox=empty("codebox"), grid=empty("grid"), image=empty("image"), bookmark=empty("bookmark"))
    out = M.delete_subtree(s, root_paths(kids), [1])
    assert sorted((r.node_id, r.master_id) for r in out.children.collect()) == [(3, 0), (4, 3)]
    assert [(r.node_id, r.name) for r in out.node.collect()] == [(3, "two")]


def test_stored_rich_text_and_grids(spark, tmp_path):
    """A store as it is kept: XML texts and grids are searched as plain ones."""
    from thicket.operators.search import SearchOptions, find_grid, find_text
    from thicket.sinks.export import save_store
    from thicket.sources.store import Store, load_store, schema_of
    from thicket.sources.stored import encode_store, stored_runs

    xml = '<?xml version="1.0" encoding="UTF-8"?>\n<node><rich_text weight="heavy">ab</rich_text><rich_text> rich &lt;x&gt;</rich_text><rich_text/></node>'
    rows = {
        "node": [(1, "n", xml, "custom-colors", "", 0, 1, False, True, False, 0, 0, 0), (2, "p", "<node> is plain here", "plain-text", "", 0, 0, False, False, False, 0, 0, 0)],
        "grid": [(1, 0, "left", '<table col_widths="3,4" is_light="1"><row><cell>a rich cell</cell></row><row><cell>head</cell></row></table>', 40, 60, None, None, None)],
        "children": [(1, 0, 1, 0), (2, 0, 2, 0)], "codebox": [], "image": [], "bookmark": [],
    }
    store = Store(**{name: spark.createDataFrame(rows[name], schema_of(name)) for name in rows})
    for name, df in store.tables().items():
        df.write.parquet(f"{tmp_path}/a/{name}")
    read = load_store(spark, f"{tmp_path}/a")
    assert {r.node_id: r.txt for r in read.node.collect()} == {1: "ab rich <x>", 2: "<node> is plain here"}
    grid = read.grid.head()
    assert grid.cells == [["head"], ["a rich cell"]] and grid.is_light and grid.col_widths == [3, 4]
    assert [(r.match_start, r.match_end) for r in find_text(read, SearchOptions("rich")).collect()] == [(3, 7)]
    assert find_grid(read, SearchOptions("rich")).count() == 1
    raw = load_store(spark, f"{tmp_path}/a", decode=False)
    assert [(r.start_offset, r.text) for r in stored_runs(raw).orderBy("run_idx").collect()] == [(0, "ab"), (2, " rich <x>")]
    save_store(encode_store(read), f"{tmp_path}/b")
    again = load_store(spark, f"{tmp_path}/b")
    assert again.node.select("node_id", "txt").exceptAll(read.node.select("node_id", "txt")).count() == 0
    assert again.grid.head().cells == grid.cells
