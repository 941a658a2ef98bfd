"""Texts with stand-in symbols, old limits, and references to groups that don't exist."""

import pytest
from pyspark.sql import functions as F

from thicket.functions import grids as G
from thicket.functions import text as S
from thicket.functions.arrays import MARKS
from thicket.operators import forest, lists
from thicket.operators import search as X
from thicket.plans import joins
from thicket.sources import files, html, outline

ODD = "﷐﷑﷒﷓﷔"


def test_matches_in_a_text_with_marks(spark):
    df = spark.createDataFrame([(1, f"ab {ODD[0]} avec x")], "id long, t string")
    got = X.text_matches(df, "t", X.SearchOptions("avec"), ["id"]).collect()
    assert [(r.match_start, r.match_end) for r in got] == [(5, 9)]


def test_functions_keep_marks(one):
    assert one(S.highlight_words("t", ["b"]), t=f"a{ODD}b") == f"a{ODD}<b>b</b>"
    assert one(G.csv_to_cells("t"), t=f'a{ODD},"x,y"\n') == [[f"a{ODD}", "x,y"]]
    assert one(lists.rotate_todo(F.col("t")), t=f"☐ a{ODD}\n☑ b") == f"☑ a{ODD}\n☒ b"


def test_blocks_keep_marks(spark):
    df = spark.createDataFrame([(1, f"<p>a{ODD[0]}b</p><p>c</p>")], "id long, h string")
    assert [r.text for r in html.html_blocks(df, "h", ["id"]).orderBy("block_no").collect()] == [f"a{ODD[0]}b", "c"]
    df = spark.createDataFrame([(1, f"<n>a{ODD[0]}<n>b</n></n>")], "id long, x string")
    assert [r.body for r in outline.xml_tree_rows(df, "x", ["id"], "n").orderBy("pos").collect()] == [f"a{ODD[0]}", "b"]


def test_no_free_marks(spark):
    df = spark.createDataFrame([("".join(b[0] for b in MARKS),)], "t string")
    with pytest.raises(Exception, match="each block of marks"):
        df.select(S.highlight_words("t", ["x"])).collect()


def test_missing_groups_are_empty(spark):
    df = spark.createDataFrame([(1, "order one", "", 0, "an order here")], "node_id long, name string, tags string, is_ro long, txt string")
    assert X.replace_names(df, X.SearchOptions("order"), r"x\1y").head().name == "xy one"
    assert X.replace_text(df, X.SearchOptions("o(r)der", reg_exp=True), r"<\1\2>").head().txt == "an <r> here"


@pytest.mark.parametrize(("pattern", "n"), [("a", 0), ("(a)(?:b)(?<n>c)(?=d)(?<!e)", 2), (r"\(a\)[(](b)", 1), (r"\Q(\E(x)", 1)])
def test_group_count(pattern, n):
    assert X.group_count(pattern) == n


def test_long_records_of_a_tagged_outline(spark):
    long = "<node>\nname\n" + "no digits\n" * 3000 + "level 2\nbody\nmore\n<end node>\n"
    endless = "<node>\nname\n" + "no digits\n" * 100_000
    df = spark.createDataFrame([(1, "<node>\na 1\nb\n3\nc\n<end node>\n" + long + endless)], "id long, t string")
    rows = outline.tagged_outline_to_rows(df, "t", ["id"]).orderBy("pos").collect()
    assert [(r.level, r.contents) for r in rows] == [(3, "c\n"), (2, "body\nmore\n")]
    assert rows[0].name == "a 1 b" and len(rows[1].name.split(" no ")) == 3001


def test_sorted_grid_keeps_all_rows(spark):
    rows = [["h"]] + [[str(k)] for k in range(250, 0, -1)]
    got = spark.createDataFrame([(rows,)], "c array<array<string>>").select(G.sort_rows(F.col("c")).alias("s")).head().s
    assert [r[0] for r in got] == ["h"] + [str(k) for k in range(1, 251)]


def test_numbers_of_any_length(one):
    long = "9" * 1_000_001
    assert one(S.natural_key(F.lit("a2"))) < one(S.natural_key(F.lit("a10"))) < one(S.natural_key(F.concat(F.lit("a"), F.lit(long))))
    assert one(html.decode_entities(F.lit("&#00000000065;&#x000000042;"))) == "AB"
    assert one(html.decode_entities(F.lit("&Agrave;&deg; &times;&amp;lt; &nosuch; & &;&nbsp;"))) == "À° ×&lt; &nosuch; & &; "


def test_deep_chains_have_paths(spark):
    n = 300
    children = spark.createDataFrame([(k + 1, k, 1, 0) for k in range(n)], "node_id long, father_id long, sequence long, master_id long")
    assert forest.root_paths(children).agg(F.max("depth")).head()[0] == n - 1


def test_text_after_a_byte_order_mark(spark):
    df = spark.createDataFrame([(bytearray("﻿äbc".encode("utf-8")),)], "c binary")
    assert df.select(files.decode_text(F.col("c"))).head()[0] == "äbc"


def test_hot_keys_are_salted(spark):
    left = spark.range(3000).select((F.col("id") % 3).alias("k"), "id").withColumn("k", F.when(F.col("id") < 2000, 7).otherwise(F.col("k")))
    right = spark.range(10).select(F.col("id").alias("r"), (F.col("id") * 10).alias("v"))
    got = joins.lookup_join(left, right, "k", "r", hot_rows=500)
    assert got.count() == 3000 and got.where("v <> k * 10 OR v IS NULL").count() == 0 and "__hot" not in got.columns
