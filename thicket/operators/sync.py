"""Pending changes: merging change flags and applying them to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DDL
from ..plans.joins import sized
from ..session import materialize
from ..sources.store import Store, schema_of


def coalesce_pending(changes: DataFrame) -> DataFrame:
    """One row per node with its merged flags.

    ``changes``: node_id, kind (new | prop | buff | hier | remove). *new* sets
    all flags and is no update; *remove* cancels all writes of the node. Flags
    merge with OR, so partial results combine before the shuffle and batches of
    a stream merge the same way.
    """
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    merged = changes.where(F.col("kind").isin("new", "prop", "buff", "hier", "remove")).groupBy("node_id").agg(
        has("new", "prop").alias("prop"), has("new", "buff").alias("buff"), has("new", "hier").alias("hier"),
        (~has("new")).alias("is_update"), has("remove").alias("removed"),
    )
    flag = lambda c: (F.col(c) & ~F.col("removed")).alias(c)
    return merged.select("node_id", flag("prop"), flag("buff"), flag("hier"), "is_update", "removed")


def _record(table: str, leave: tuple[str, ...] = ()) -> str:
    columns = [c.split(" ", 1) for c in DDL[table].split(", ")]
    return ",".join(f"{name}:{kind}" for name, kind in columns if name not in ("node_id", *leave))


#: A change and what it writes: ``node`` for new and prop, ``txt`` and the objects for new and buff, ``place`` for new and hier.
CHANGE_DDL = ", ".join([
    "event_id long, ts timestamp_ntz, node_id long, kind string", f"node struct<{_record('node', ('txt',))}>", "txt string",
    *[f"{t} array<struct<{_record(t)}>>" for t in ("codebox", "grid", "image")], f"place struct<{_record('children')}>",
])


def fold_changes(changes: DataFrame) -> tuple[DataFrame, Store]:
    """Changes in order of ``event_id`` as pending flags and the rows that they write.

    ``changes`` has the columns of ``CHANGE_DDL``; equal event ids are repeats of one change.
    What comes after a node's last removal counts: without a *new* among it the node is
    removed, and edits of a node that isn't there are no edits. Of several edits of a part
    the last one is written. ``dropped`` also tells of removals that a *new* came after. All
    is one aggregate per node that combines before the shuffle.
    """
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("event_id")))
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("event_id")))
    objects = ["codebox", "grid", "image"]
    known = changes.where(F.col("kind").isin("new", "prop", "buff", "hier", "remove") & F.col("node_id").isNotNull())
    folded = known.groupBy("node_id").agg(
        at("remove").alias("removed_at"), at("new").alias("new_at"), at("new", "prop").alias("prop_at"), at("new", "buff").alias("buff_at"), at("new", "hier").alias("hier_at"),
        last(F.col("node"), "new", "prop").alias("node"), last(F.struct("txt", *objects), "new", "buff").alias("body"), last(F.col("place"), "new", "hier").alias("place"),
    )
    after = lambda c: F.coalesce(F.col(c) > F.col("removed_at"), F.col(c).isNotNull())
    created = after("new_at")
    removed = F.col("removed_at").isNotNull() & ~created
    flag = lambda c: (after(f"{c}_at") & ~removed).alias(c)
    flags = [flag("prop"), flag("buff"), flag("hier"), (~created).alias("is_update"), removed.alias("removed"), F.col("removed_at").isNotNull().alias("dropped")]
    folded = materialize(folded.select("node_id", *flags, "node", "body", "place"), "folded")
    fields = [f.name for f in schema_of("node") if f.name not in ("node_id", "txt")]
    rows = {
        "node": folded.where("prop OR buff").select("node_id", *[F.col(f"node.{c}").alias(c) for c in fields], F.col("body.txt").alias("txt")),
        "children": folded.where("hier").select("node_id", "place.*"),
        "bookmark": folded.sparkSession.createDataFrame([], schema_of("bookmark")),
    }
    for name in objects:
        rows[name] = folded.where("buff").select("node_id", F.explode(f"body.{name}").alias("o")).select("node_id", "o.*")
    return folded.select("node_id", "prop", "buff", "hier", "is_update", "removed", "dropped"), Store(**rows)


_OWNED = ["node", "codebox", "grid", "image"]


def sync_store(store: Store, pending: DataFrame, changed: Store) -> Store:
    """``store`` after writing the pending nodes from ``changed``.

    prop writes the properties, buff the text and the objects, hier the place in
    the tree; removed nodes go from all six tables. Set operations only: rows
    that stay are never rewritten one by one.
    """
    live = pending.where(~F.col("removed"))
    gone = sized(pending.where("removed").select("node_id"), "removed")
    ids = lambda cond: live.where(cond).select("node_id")

    hier = sized(ids("hier"), "moved")
    children = store.children.join(gone, "node_id", "left_anti").join(hier, "node_id", "left_anti").unionByName(
        changed.children.join(hier, "node_id", "left_semi")
    )
    touched = sized(live.where("prop OR buff").select("node_id", F.col("prop").alias("__prop"), F.col("buff").alias("__buff")), "touched")
    ids_touched = touched.select("node_id")
    # Rows meet by node with the names of their texts; the texts stay where they are.
    rows, texts = store.split()
    new_rows, new_texts = changed.split_of(ids_touched)
    columns = [c for c in rows.columns if c != "node_id"]
    # Untouched rows pass by without a shuffle when the touched ids are few.
    same = rows.join(gone, "node_id", "left_anti").join(ids_touched, "node_id", "left_anti")
    new = new_rows.select("node_id", *[F.col(c).alias(f"__n_{c}") for c in columns])
    old = rows.join(ids_touched, "node_id", "left_semi").select("node_id", *[F.col(c).alias(f"__o_{c}") for c in columns])
    both = new.join(old, "node_id", "left").join(touched, "node_id")
    # A node without an old row is new and takes everything.
    pick = lambda c, flag: F.when(F.col(flag), F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c)
    node = same.unionByName(both.select("node_id", *[pick(c, "__buff" if c in ("text_id", "stored") else "__prop") for c in columns]))
    buff = sized(ids("buff"), "buff")
    out = {"children": children, "node": store.node, "bookmark": store.bookmark.join(gone, "node_id", "left_anti")}
    for name in _OWNED[1:]:
        old, fresh_objs = getattr(store, name), getattr(changed, name)
        out[name] = (
            old.join(gone, "node_id", "left_anti").join(buff, "node_id", "left_anti")
            .unionByName(fresh_objs.join(buff, "node_id", "left_semi"))
        )
    return Store(**out).with_parts(node, texts.unionByName(new_texts))
