"""Versioned stores: changes in batches, replays, failed attempts, and what a change writes."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.model import TABLES
from thicket.operators import sync
from thicket.operators.object_index import build_index
from thicket.sources import versions as V
from thicket.sources.store import Store, align_schema, schema_of
from thicket.streaming import sync as ST

CHANGE = sync.CHANGE_DDL


def small_store(spark, n=400):
    ids = spark.range(1, n + 1).withColumnRenamed("id", "node_id")
    rows = {
        "node": ids.withColumns({"name": F.concat(F.lit("n"), "node_id"), "txt": F.concat(F.lit("text "), "node_id"), "syntax": F.lit("plain-text")}),
        "children": ids.withColumns({"father_id": F.floor(F.col("node_id") / 10).cast("long"), "sequence": F.col("node_id"), "master_id": F.lit(0)}),
        "codebox": ids.where("node_id % 2 = 0").withColumns({"offset": F.lit(1), "txt": F.concat(F.lit("box "), "node_id")}),
        "grid": ids.where("node_id % 5 = 0").withColumns({"offset": F.lit(2), "cells": F.array(F.array(F.lit("a"), F.lit("b")))}),
        "image": ids.where("node_id % 3 = 0").withColumns({"offset": F.lit(3), "anchor": F.concat(F.lit("x"), "node_id")}),
        "bookmark": ids.where("node_id % 7 = 0").withColumn("sequence", F.col("node_id")),
    }
    return Store(**{t: align_schema(df, schema_of(t)) for t, df in rows.items()})


def change(event_id, node_id, kind):
    """A change that writes its own number everywhere."""
    def record(table, leave=(), **given):
        return tuple(given.get(f.name) for f in schema_of(table).fields if f.name not in ("node_id", *leave))

    node = record("node", ("txt",), name=f"name {event_id}", syntax="sql", ts_lastsave=event_id)
    boxes = [record("codebox", offset=event_id, txt=f"box {event_id}")] * (event_id % 3)
    return (event_id, None, node_id, kind, node, f"text {event_id}", boxes, None, [record("image", offset=1, anchor=f"a{event_id}")], record("children", father_id=2, sequence=event_id, master_id=0))


def contents(store):
    return {t: sorted((r.asDict(True) for r in getattr(store, t).collect()), key=repr) for t in TABLES}


def by_hand(store, events):
    """The store after the events, one after the other."""
    held = {t: [r.asDict(True) for r in getattr(store, t).collect()] for t in TABLES}
    for e in sorted(events, key=lambda e: e[0]):
        _, _, node_id, kind, node, txt, boxes, grids, images, place = e
        drop = lambda t, n=node_id: held.__setitem__(t, [r for r in held[t] if r["node_id"] != n])
        names = lambda t, *leave: [f.name for f in schema_of(t).fields if f.name not in ("node_id", *leave)]
        exists = any(r["node_id"] == node_id for r in held["children"])
        if kind == "remove":
            for t in TABLES:
                drop(t)
        elif kind == "new" or exists:
            old = next((r for r in held["node"] if r["node_id"] == node_id), {"node_id": node_id} | dict.fromkeys(names("node")))
            if kind in ("new", "prop"):
                old = old | dict(zip(names("node", "txt"), node, strict=True))
            if kind in ("new", "buff"):
                old = old | {"txt": txt}
                for t, rows in (("codebox", boxes), ("grid", grids), ("image", images)):
                    drop(t)
                    held[t] += [{"node_id": node_id} | dict(zip(names(t), r, strict=True)) for r in rows or []]
            if kind in ("new", "prop", "buff"):
                drop("node")
                held["node"].append(old)
            if kind in ("new", "hier"):
                drop("children")
                held["children"].append({"node_id": node_id} | dict(zip(names("children"), place, strict=True)))
    return {t: sorted(rows, key=repr) for t, rows in held.items()}


def drawn(n_events, seed=3):
    rng = random.Random(seed)
    return [change(k, rng.randint(380, 430), rng.choice(["new", "prop", "prop", "buff", "hier", "remove", "visit"])) for k in range(1, n_events + 1)]


def test_batches_replays_and_one_batch_give_the_same_store(spark, tmp_path):
    store, events = small_store(spark), drawn(150)
    removed_then_new = [change(200, 390, "remove"), change(320, 390, "new"), change(210, 391, "remove"), change(330, 391, "prop")]
    batches = [events[:60], events[60:] + removed_then_new[:1] + removed_then_new[2:3], removed_then_new[1:2] + removed_then_new[3:]]
    want = by_hand(store, [e for b in batches for e in b])
    for root, parts in ((f"{tmp_path}/three", batches), (f"{tmp_path}/one", [[e for b in batches for e in b]])):
        V.create_versions(store, root, buckets=6)
        for k, part in enumerate(parts):
            changes = sync.fold_changes(spark.createDataFrame(part, CHANGE))
            made = V.write_changes(spark, root, *changes, feed="f", batch_id=k)
            again = V.write_changes(spark, root, *changes, feed="f", batch_id=k)
            assert again == made and made.number == k + 2
        read = V.read_version(spark, root)
        assert contents(read) == want
        assert contents(V.read_version(spark, root, 1)) == contents(store)
        kept, fresh = V.read_index(spark, root), build_index(read)
        for table in ("place", "step"):
            assert sorted(getattr(kept, table).collect(), key=repr) == sorted(getattr(fresh, table).collect(), key=repr)
    assert any(r["node_id"] == 390 for r in want["node"]) and not any(r["node_id"] == 391 for r in want["children"])


def test_a_stream_applies_its_changes(spark, tmp_path):
    store, events, root = small_store(spark, 390), drawn(90, 5), f"{tmp_path}/versions"
    V.create_versions(store, root, buckets=8)
    for part in (events[:30], events[30:70], events[70:]):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    start = lambda: ST.stream_to_store(ST.record_stream(spark, f"{tmp_path}/feed", 1), root, "feed", {"availableNow": True}, f"{tmp_path}/checkpoint").awaitTermination()
    start()
    assert V.version_numbers(spark, root) == [1, 2, 3, 4] and V.open_version(spark, root).batches == {"feed": 2}
    assert contents(V.read_version(spark, root)) == by_hand(store, events)
    more = change(500, 5, "buff")
    spark.createDataFrame([more], CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    start()
    assert contents(V.read_version(spark, root)) == by_hand(store, [*events, more])


def test_a_change_writes_the_buckets_of_its_nodes(spark, tmp_path):
    root = str(tmp_path)
    first = V.create_versions(small_store(spark, 900), root, buckets=60)
    pending = spark.range(500, 508).select(F.col("id").alias("node_id"), F.lit(True).alias("prop"), F.lit(True).alias("buff"), F.lit(True).alias("hier"), F.lit(True).alias("is_update"), F.lit(False).alias("removed"))
    changed = small_store(spark, 900)
    changed = changed.with_tables(node=changed.node.withColumn("txt", F.lit("new")))
    second = V.write_changes(spark, root, pending, changed)
    for table in [*TABLES, "place", "step"]:
        rewritten = {b for b, f in second.folders[table].items() if f != first.folders[table].get(b)}
        assert len(rewritten) <= (0 if table == "bookmark" else 8)
        files = [p for p in (tmp_path / "data" / table).glob("*/*/*.parquet") if not any(str(p.parent).endswith(f) for f in first.folders[table].values())]
        assert {int(p.parent.name.split("=")[1]) for p in files} == rewritten
    diff = V.version_diff(spark, root, 1, 2).groupBy("side", "table_name").count().collect()
    assert {(r.side, r.table_name): r["count"] for r in diff} == {("left", "node"): 8, ("right", "node"): 8}
    assert V.version_diff(spark, root, 2, 2).count() == 0
    got = V.read_version(spark, root)
    assert got.node.where("txt = 'new'").count() == 8 and got.node.count() == 900 and got.codebox.count() == 450


def test_failed_attempts_leave_no_trace(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path), small_store(spark, 50)
    V.create_versions(store, root, buckets=4)
    changes = sync.fold_changes(spark.createDataFrame([change(1, 7, "remove"), change(2, 8, "buff")], CHANGE))
    monkeypatch.setattr(V, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        V.write_changes(spark, root, *changes, feed="f", batch_id=0)
    monkeypatch.undo()
    assert contents(V.read_version(spark, root)) == contents(store)
    V.write_changes(spark, root, *changes, feed="f", batch_id=0)
    want = by_hand(store, [change(1, 7, "remove"), change(2, 8, "buff")])
    assert contents(V.read_version(spark, root)) == want
    with pytest.raises(Exception, match="exists"):
        V._commit(spark, root, V.Version(2, 4, {t: {} for t in TABLES}))
    assert V.forget_versions(spark, root)
    assert V.version_numbers(spark, root) == [2] and contents(V.read_version(spark, root)) == want
    assert V.forget_versions(spark, root) == []


def test_nothing_to_change(spark, tmp_path):
    root = str(tmp_path)
    none = small_store(spark, 0)
    V.create_versions(none, root, buckets=4)
    V.write_changes(spark, root, *sync.fold_changes(spark.createDataFrame([], CHANGE)))
    V.write_changes(spark, root, *sync.fold_changes(spark.createDataFrame([change(1, 3, "prop"), change(2, None, "new"), change(3, 4, "remove")], CHANGE)))
    assert contents(V.read_version(spark, root)) == contents(none)
    V.write_changes(spark, root, *sync.fold_changes(spark.createDataFrame([change(1, 3, "new")], CHANGE)))
    assert contents(V.read_version(spark, root)) == by_hand(none, [change(1, 3, "new")])
