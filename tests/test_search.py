"""Search and replace against Python's own regex engine."""

import random
import re

from conftest import SF
from pyspark.sql import functions as F

from thicket.operators import object_index as OI
from thicket.operators import search as X

O = X.SearchOptions


def spans(spark, texts, opts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return {
        i: [(r.match_start, r.match_end, r.line_num, r.line_content) for r in rows]
        for i, rows in group(X.text_matches(df, "t", opts, ["id"]).orderBy("id", "match_idx").collect())
    }


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.id, []).append(r)
    return out.items()


def python_spans(text, pattern, flags=0):
    out = []
    for m in re.finditer(pattern, text, flags | re.M):
        if m.end() == m.start():
            continue
        line = text[: m.end()].count("\n")
        content = text.split("\n")[line]
        out.append((m.start(), m.end(), text[: m.start()].count("\n") + 1, content if len(content) <= 100 else content[:100] + "..."))
    return out


TEXTS = ["", "abc", "ab ab\nab", "😀ab 😀\n\nabab\n", "x" * 150 + "ab" + "y" * 20, "Été été ab\nÀB", "a.b a+b", "ab\n" * 40]


def test_literal_offsets(spark):
    got = spans(spark, TEXTS, O("ab", match_case=True))
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == python_spans(t, "ab")


def test_regex_and_case(spark):
    got = spans(spark, TEXTS, O("a.b?", reg_exp=True))
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == python_spans(t, "a.b?", re.I)
    got = spans(spark, TEXTS, O("a+b", match_case=True))
    assert got == {6: [(4, 7, 1, "a.b a+b")]}


def test_words_and_accents(spark):
    texts = ["over the cat", "the cats over", "cat\nthe over", "éclair Eclair", "scatter cat"]
    both = spans(spark, texts, O("cat over", multiple_words=1))
    assert both == {0: [(0, 12, 1, texts[0])], 1: [(0, 13, 1, texts[1])]}
    either = spans(spark, texts, O("over eclair", multiple_words=2, accent_insensitive=True))
    assert sorted(either) == [0, 1, 2, 3] and either[2] == [(4, 12, 2, "the over")]
    assert spans(spark, texts, O("cat", whole_word=True)) == {0: [(9, 12, 1, texts[0])], 2: [(0, 3, 1, "cat")], 4: [(8, 11, 1, texts[4])]}
    assert sorted(spans(spark, texts, O("cat", start_word=True))) == [0, 1, 2, 4]
    assert len(spans(spark, texts, O("ECLAIR", accent_insensitive=True))[3]) == 2


def test_replace(spark):
    df = spark.createDataFrame([(1, "Été à la plage, ÉTÉ 😀 été", 0), (2, "été", 1), (3, "none", 2)], "node_id long, txt string, is_ro long")
    got = X.replace_text(df, O("ete", accent_insensitive=True), "$1 winter\\").collect()
    assert [(r.node_id, r.txt) for r in got] == [(1, "$1 winter\\ à la plage, $1 winter\\ 😀 $1 winter\\")]
    got = X.replace_text(df, O("(p)(l)", reg_exp=True, match_case=True), "\\2\\1").collect()
    assert [(r.node_id, r.txt) for r in got] == [(1, "Été à la lpage, ÉTÉ 😀 été")]


def test_replace_names_modes(spark):
    df = spark.createDataFrame([(1, "Café café", "", 0), (2, "x", "cafe", 0)], "node_id long, name string, tags string, is_ro long")
    opts = O("cafe", accent_insensitive=True)
    legacy = {r.node_id: r.name for r in X.replace_names(df, opts, "bar").collect()}
    assert legacy == {1: "bar bar", 2: "x"}
    keep = spark.createDataFrame([(1, "Café à Nîmes", "", 0)], df.schema)
    assert X.replace_names(keep, opts, "bar").head().name == "bar a Nimes"
    assert X.replace_names(keep, opts, "bar", legacy_fold_write=False).head().name == "bar à Nîmes"


def test_urls(spark):
    text = "go (http://a.b/c) or [www.x.org/y] and https://q.r/(z) end of it"
    df = spark.createDataFrame([(1, text), (2, "http:/"), (3, "tail http://abc.de")], "id long, t string")
    got = [(r.id, r.url) for r in X.find_urls(df, "t", ["id"]).orderBy("id", "url_start").collect()]
    assert got == [(1, "http://a.b/c"), (1, "www.x.org/y"), (1, "https://q.r/(z)"), (3, "http://abc.de")]
    for r in X.find_urls(df, "t", ["id"]).where("id = 1").collect():
        assert text[r.url_start : r.url_end] == r.url


def test_objects_shift(spark):
    pts = spark.createDataFrame([(1, p) for p in range(0, 12)], "node_id long, match_start long")
    offsets = [3, 4, 8]
    objs = spark.createDataFrame([(1, o, "png", o) for o in offsets], "node_id long, offset long, kind string, obj_id long")
    texts = spark.createDataFrame([(1, "0123\n567\n90")], "node_id long, txt string")
    index = OI.index_of(objs, texts)
    got = {r.match_start: r.n_before for r in X.objects_before(pts, index).collect()}
    # Literal count: each object found moves the limit on by one.
    def count(limit):
        n, at = 0, 0
        while at <= limit:
            if at in offsets:
                n, limit = n + 1, limit + 1
            at += 1
        return n

    assert got == {p: count(p) for p in range(12)}
    # offsets count objects, places in the text don't: 3, 3 and 6
    assert [(r.offset, r.text_pos, r.line_num) for r in index.place.orderBy("offset").collect()] == [(3, 3, 1), (4, 3, 1), (8, 6, 2)]


def test_object_index_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(OI, "STRETCH", 10)
    rng = random.Random(8)
    texts = {n: "".join(rng.choice("ab\n") for _ in range(rng.choice([0, 5, 9, 10, 95, 240]))) for n in range(12)}
    objs = [(n, rng.randrange(0, len(t) + 12), rng.choice(["png", "codebox"]), k) for n, t in texts.items() for k in range(rng.randrange(0, 40))]
    objs += [(50, 3, "png", 1), (50, 7, "png", 2)]  # a node without a text
    index = OI.index_of(
        spark.createDataFrame(objs, "node_id long, offset long, kind string, obj_id long"),
        spark.createDataFrame(list(texts.items()), "node_id long, txt string"),
    )
    places = {}
    for n in {o[0] for o in objs}:
        for rank, (_, offset, kind, k) in enumerate(sorted((o for o in objs if o[0] == n), key=lambda o: o[1:]), 1):
            places.setdefault(n, []).append((offset, kind, rank, offset - rank + 1))
    got = {}
    for r in index.place.collect():
        got.setdefault(r.node_id, []).append((r.offset, r.kind, r.obj_rank, r.text_pos))
        text = texts.get(r.node_id, "")
        assert r.line_num == 1 + text[: max(r.text_pos, 0)].count("\n"), r
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(v) for n, v in places.items()}
    points = [(n, p) for n, t in texts.items() for p in range(len(t) + 1)] + [(50, 3), (50, 9), (99, 1)]
    for r in X.objects_before(spark.createDataFrame(points, "node_id long, match_start long"), index).collect():
        assert r.n_before == sum(p[3] <= r.match_start for p in places.get(r.node_id, [])), r


def test_a_search_ranks_no_objects(spark):
    """With an index the plan of a search sorts and ranks nothing of the object tables."""
    from thicket.catalog import base

    store, index = base.store(spark, SF), base.object_index(spark, SF)
    plan = X.find_text(store, X.SearchOptions("the"), index=index)._jdf.queryExecution().toString()
    assert "Window" not in plan and "thicket-store" not in plan


def test_pages_are_numbered_alone(spark):
    names = ["pos", "is_name", "start_offset", "kind_rank", "object_kind", "cell_idx", "inner_start", "line_content"]
    rows = [(n // 3, 0, n % 3, 1, "text", 0, 0, str(n)) for n in range(2345)]
    random.Random(4).shuffle(rows)
    pages = X.match_pages(spark.createDataFrame(rows, names).repartition(7), size=100, ranges=9)
    assert pages.total == 2345 and len(pages.ranges) > 1
    for n in (0, 7, 23):
        got = X.page(pages, n).orderBy("row_num").collect()
        assert [int(r.line_content) for r in got] == list(range(n * 100, min(2345, (n + 1) * 100)))
        assert [r.row_num for r in got] == list(range(n * 100 + 1, min(2345, (n + 1) * 100) + 1))
    read = X.page(pages, 23).inputFiles()
    assert X.page(pages, 24).count() == 0 and read
    assert X.match_pages(spark.createDataFrame([], "pos long, is_name int, start_offset long, kind_rank int, object_kind string, cell_idx long, inner_start long, line_content string")).total == 0
    labels = lambda n: [r.label for r in X.page_labels(spark.createDataFrame([(n,)], "n long"), 100).orderBy("page").collect()]
    assert labels(250) == ["1..100", "101..200", "201..250"] and labels(0) == ["1..0"]
