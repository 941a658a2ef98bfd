"""Tree operators against plain Python on small, awkward forests."""

import random

from pyspark.sql import functions as F

from thicket.operators import forest as T
from thicket.plans.joins import lookup_join
from thicket.plans.scan import Running, numbered, running

DDL = "node_id long, father_id long, sequence long, master_id long"


def random_forest(seed, n=60):
    rnd = random.Random(seed)
    rows, ids = [], list(range(1, n + 1))
    rnd.shuffle(ids)
    for i, node in enumerate(ids):
        father = 0 if i == 0 or rnd.random() < 0.1 else ids[rnd.randrange(i)]
        rows.append((node, father, rnd.randrange(5), 0))
    return rows


def walk(rows):
    kids = {}
    for node, father, seq, _ in rows:
        kids.setdefault(father, []).append((seq, node))
    out, stack = [], [(n, (n,)) for _, n in sorted(kids.get(0, []), reverse=True)]
    while stack:
        node, path = stack.pop()
        out.append((node, path))
        stack += [(n, path + (n,)) for _, n in sorted(kids.get(node, []), reverse=True)]
    return out


def test_paths_and_order(spark):
    for seed in (1, 2):
        rows = random_forest(seed)
        paths = T.root_paths(spark.createDataFrame(rows, DDL))
        got = {r.node_id: tuple(r.path) for r in paths.collect()}
        want = walk(rows)
        assert got == dict(want)
        order = [r.node_id for r in T.preorder(paths).orderBy("pos").collect()]
        assert order == [n for n, _ in want]


def test_deep_chain_orphans_and_cycles(spark):
    rows = [(i, i - 1, 1, 0) for i in range(1, 130)]
    rows += [(900, 901, 1, 0), (901, 900, 1, 0), (902, 900, 1, 0), (903, 999, 1, 0)]
    paths = T.root_paths(spark.createDataFrame(rows, DDL))
    depth = {r.node_id: r.depth for r in paths.collect()}
    assert depth == {i: i - 1 for i in range(1, 130)}
    counts = {r.node_id: r.n_nodes for r in T.subtree_counts(paths).collect()}
    assert counts[1] == 129 and counts[129] == 1
    assert T.closure(paths).count() == 129 * 130 // 2


def test_moves(spark):
    rows = [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 1, 0), (5, 1, 2, 0), (6, 4, 1, 0)]
    kids = spark.createDataFrame(rows, DDL)
    shape = lambda df: sorted((r.father_id, r.sequence, r.node_id) for r in df.collect())
    assert shape(T.move_step(kids, 2, "up"))[:3] == [(0, 1, 2), (0, 2, 1), (0, 3, 3)]
    assert shape(T.move_step(kids, 2, "down"))[:3] == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]
    assert shape(T.move_step(kids, 1, "up")) == sorted((f, s, n) for n, f, s, _ in rows)
    assert (1, 3, 2) in shape(T.move_step(kids, 2, "indent"))
    assert shape(T.move_step(kids, 4, "outdent"))[:4] == [(0, 1, 1), (0, 2, 4), (0, 3, 2), (0, 4, 3)]
    assert (1, 1, 3) in shape(T.move_subtree(kids, 3, 1, first=True))
    paths = T.root_paths(kids)
    moves = spark.createDataFrame([(1, 6), (1, 1), (1, 2), (4, 0), (4, 77)], "src long, dst long")
    assert {(r.src, r.dst): r.valid for r in T.move_is_valid(moves, paths).collect()} == {
        (1, 6): False, (1, 1): False, (1, 2): True, (4, 0): True, (4, 77): False,
    }


def test_sort_is_natural_and_stable(spark):
    rows = [(1, 0, 1, "Node 10"), (2, 0, 2, "node 9"), (3, 0, 3, "NODE 9"), (4, 0, 4, "a")]
    named = spark.createDataFrame(rows, "node_id long, father_id long, sequence long, name string")
    up = [r.node_id for r in T.sort_forest(named).orderBy("sequence").collect()]
    down = [r.node_id for r in T.sort_forest(named, False).orderBy("sequence").collect()]
    assert up == [4, 2, 3, 1] and down == [1, 2, 3, 4]


def test_scan_equals_window(spark):
    rnd = random.Random(5)
    # One hot key with most rows, many bucket borders, NULLs inside.
    data = [(0 if rnd.random() < 0.7 else rnd.randrange(5), i, rnd.choice([None, rnd.randrange(9)])) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, i long, v long").repartition(7)
    outs = {
        "s": Running("sum", F.col("v")), "c": Running("count", F.col("v")), "m": Running("max", F.col("v"), True),
        "l": Running("last", F.col("v"), True), "n": Running("min", F.col("v")),
    }
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "k", "i", "v", F.sum("v").over(upto).alias("s"), F.count("v").over(upto).alias("c"), F.max("v").over(before).alias("m"),
        F.last("v", True).over(before).alias("l"), F.min("v").over(upto).alias("n"),
    )
    for bucket in (None, F.floor(F.col("i") / 100)):
        got = running(df, ["k"], [F.col("i")], outs, bucket)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    ranks = numbered(df, [], [F.col("i").desc()], "rn", None)
    assert {(r.i, r.rn) for r in ranks.collect()} == {(i, 3000 - i) for i in range(3000)}


def test_salted_join_equals_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 50).cast("long").alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.col("id").alias("rk"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        got = lookup_join(left, right, "k", "rk", how, hot_rows=100, fanout=8)
        want = left.join(right, F.col("k") == F.col("rk"), how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
