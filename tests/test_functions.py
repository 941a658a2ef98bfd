"""Scalar functions on small known cases."""

import pytest
from pyspark.sql import functions as F

from thicket.functions import grids as G
from thicket.functions import links as L
from thicket.functions import text as S
from thicket.functions.arrays import prefix_sums

C = F.col


def test_header_anchor_level(spark):
    want = {"ciao": 0, "h0-2": 0, "h7-10": 0, "h710": 0, "h-710": 0, "h1-1": 1, "h2-10": 2, "h3-20": 3, "h6-50": 6}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r.a: r.l for r in df.select("a", S.header_anchor_level("a").alias("l")).collect()} == want


def test_words(spark):
    want = {"": 0, "   \n\t  ": 0, "one two three": 3, "one, two.\nthree": 3, "Saitama さいたま市": 2}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r.a: r.n for r in df.select("a", S.word_count("a").alias("n")).collect()} == want


def test_natural_order(spark):
    pairs = [
        ("", "", 0), ("", "a", -1), ("a", "", 1), ("a", "a", 0), ("", "9", -1), ("9", "", 1), ("1", "1", 0), ("1", "2", -1), ("3", "2", 1),
        ("a1", "a1", 0), ("a1", "a2", -1), ("a2", "a1", 1), ("a1a2", "a1a3", -1), ("a1a2", "a1a0", 1), ("134", "122", 1), ("12a3", "12a3", 0),
        ("12a1", "12a0", 1), ("12a1", "12a2", -1), ("a", "aa", -1), ("aaa", "aa", 1), ("Alpha 2", "Alpha 2", 0), ("Alpha 2", "Alpha 2A", -1),
        ("Alpha 2 B", "Alpha 2", 1), ("Order 9", "Order 10", -1), ("007", "7", 0),
    ]
    df = spark.createDataFrame(pairs, "l string, r string, w int")
    l, r = S.natural_key("l"), S.natural_key("r")
    got = df.select("l", "r", "w", F.when(l < r, -1).when(l > r, 1).otherwise(0).alias("g")).collect()
    assert [x for x in got if x.w != x.g] == []


def test_accents(one):
    assert one(S.fold_accents("a"), a="GIÀ PERCHÉ LÌ PUÒ PIÙ già perché lì può più øđħłŧıŀŉ Ẓẓ ṿ ß") == (
        "GIA PERCHE LI PUO PIU gia perche li puo piu odhltiln Zz ṿ ß"
    )
    assert len(S.ACCENTS_SRC) == len(S.ACCENTS_DST) == len(set(S.ACCENTS_SRC))


def test_escape_swap_join(one):
    assert one(S.xml_escape("a"), a="1<2\"3\"4&>Ру") == "1&lt;2&quot;3&quot;4&amp;&gt;Ру"
    assert one(S.swap_case("a"), a="mIXed 😀É") == "MixED 😀é"
    assert one(S.join_numbers(F.array(F.lit(-1), F.lit(1), F.lit(0), F.lit(1000)), ",")) == "-1,1,0,1000"
    assert one(S.split_ints("a"), a="1,-2,0x1F,x") == [1, -2, 31, 0]


def test_links(spark):
    rows = {
        "webs https://example.com": ("webs", -1, "https://example.com", ""),
        "file L2hvbWUvZm9vL2Jhcgo=": ("file", -1, "/home/foo/bar\n", ""),
        "fold L2hvbWUvZm9vL2Jhcgo=": ("fold", -1, "/home/foo/bar\n", ""),
        "node 2 hi hi": ("node", 2, "hi hi", "hi hi"), "node 7": ("node", 7, "", ""),
        "": ("none", -1, "", ""), "https://example.com": ("none", -1, "", ""), "/home/foo/bar": ("none", -1, "", ""),
        "home https://example.com": ("none", -1, "", ""), "node x": ("none", -1, "", ""),
    }
    df = spark.createDataFrame([(k,) for k in rows], "a string").withColumn("l", L.parse_link("a"))
    for r in df.select("a", "l", L.link_target(C("l")).alias("t"), L.format_link(C("l")).alias("f")).collect():
        kind, node, target, anchor = rows[r.a]
        assert (r.l.type, r.l.node_id, r.t, r.l.anch) == (kind, node, target, anchor)
        assert r.f == (r.a if kind != "none" else "")


def test_url_and_camel(spark):
    want = {"http://a": True, "ftp://": True, "://": True, "mailto:x": True, "ab1://x": False, "www.x.org": False, "": False}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r.a: r.u for r in df.select("a", S.is_url("a").alias("u")).collect()} == want
    camel = {"notcamelcase": False, "yesCamel1": True, "YesCamel2": True, "yes Camel": False, "ABC": False}
    df = spark.createDataFrame([(k,) for k in camel], "a string")
    assert {r.a: r.u for r in df.select("a", S.is_camel_case("a").alias("u")).collect()} == camel


def test_direction_words_uri(one):
    assert one(S.base_direction("a"), a="Test 123") == "ltr"
    assert one(S.base_direction("a"), a="12 זה טקסט") == "rtl"
    assert one(S.base_direction("a"), a="123 .") == "neutral"
    assert one(S.contains_words("a", ["due", "tre"]), a="uno due tre")
    assert not one(S.contains_words("a", ["tre", "quattro"]), a="uno due tre")
    assert one(S.contains_words("a", ["tre", "quattro"], False), a="uno due tre")
    assert one(S.highlight_words("a", ["due", "TRE"]), a="uno due tre <b>") == "uno <b>due</b> <b>tre</b> &lt;b&gt;"
    assert one(S.highlight_words("a", ["due"], "u"), a="uno due") == "uno <u>due</u>"
    for uri, kind in [("https://g.com", "web"), ("/home", "local"), ("C:\\\\windows", "local"), ("smb://l", "unknown"), ("my uri", "unknown")]:
        assert one(S.classify_uri("a"), a=uri) == kind


@pytest.mark.parametrize("path,kind,enc,want", [
    ("a/test.ctd", "xml", False, "a/test.ctd"), ("a/test.ctd", "xml", True, "a/test.ctz"), ("a/test.ctz", "sqlite", False, "a/test.ctb"),
    ("a/test.ctb", "sqlite", True, "a/test.ctx"), ("b\\test.ctx", "none", False, "b\\test"),
])
def test_extensions(one, path, kind, enc, want):
    assert one(S.fix_extension("a", kind, enc), a=path) == want


def test_lines(one):
    text = "\n\n" + "x" * 120 + "\nlast 😀 line"
    assert one(S.first_line("a"), a=text) == "x" * 100 + "..."
    assert one(S.line_at("a", 130), a=text) == "last 😀 line"
    assert one(S.line_number("a", 130), a=text) == 4
    assert one(S.line_at("a", 0), a="abc") == ""


def test_file_name_tail(one):
    names = F.array(F.lit("é" * 100), F.lit("a/b*c d"))
    name = one(S.hier_name(names))
    assert name.endswith("--a-bc_d") and len(name.encode()) <= 142 and len(name.encode()) > 138


def test_csv(one):
    t = 'a,"b,1",c\\"d\n"x\ny",\\\\z\n"",two,three,four\nlost'
    assert one(G.csv_to_cells("a"), a=t) == [["a", "b,1", 'c"d'], ["x\ny", "\\z"], ["", "two", "three", "four"]]
    assert one(G.pad_cells(G.csv_to_cells("a")), a=t) == [["a", "b,1", 'c"d'], ["x\ny", "\\z", ""], ["", "two", "three"]]
    assert one(G.cells_to_csv(F.array(F.array(F.lit('a"b'), F.lit(""))))) == '"a\\"b",""\n'


def test_grid_sort(one):
    cells = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in [("h", "z"), ("10", "b"), ("9", "b"), ("9", "a")]])
    assert one(G.sort_rows(cells)) == [["h", "z"], ["9", "a"], ["9", "b"], ["10", "b"]]
    assert one(G.sort_rows(cells, False)) == [["h", "z"], ["10", "b"], ["9", "b"], ["9", "a"]]
    assert one(G.row_delete(F.array(F.array(F.lit("x"))), 0)) == [["x"]]
    assert one(G.header_first(G.header_last(cells)))[0] == ["h", "z"]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50, 101])
def test_prefix_sums(one, n):
    values = F.expr(f"transform(sequence(1, {n}), x -> bigint(x * x))") if n else F.expr("cast(array() as array<bigint>)")
    total, want = 0, []
    for i in range(1, n + 1):
        total += i * i
        want.append(total)
    assert one(prefix_sums(values)) == want
