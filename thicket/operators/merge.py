"""Changes to whole stores: ids, deletes, exports, merges, copies, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import format_link, parse_link
from ..plans.joins import lookup_join, sized
from ..plans.scan import numbered
from ..session import materialize
from ..sources.store import Store, plain_parts, text_id
from .forest import preorder, subtree
from .shared import holder_id

OBJECT_TABLES = ["codebox", "grid", "image"]


def next_id(*frames: DataFrame) -> DataFrame:
    """One row, ``next_id``: the largest ``node_id`` of all frames plus one."""
    tops = [f.agg(F.max("node_id").alias("m")) for f in frames]
    both = tops[0]
    for t in tops[1:]:
        both = both.unionByName(t)
    return both.agg((F.coalesce(F.max("m"), F.lit(0)) + 1).cast("long").alias("next_id"))


def _next_id_value(*frames: DataFrame) -> int:
    return next_id(*frames).head()[0]


def fix_duplicate_ids(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """Second and later rows of an id get fresh ids after the largest one.

    ``order`` is the document order. Rows that keep their id never leave their
    task order; only the duplicates are ranked over the whole frame.
    """
    # Ids should be unique, so groups are small; a scan guards the odd one.
    ranked = numbered(nodes, ["node_id"], [F.col(order)], "__occ")
    fresh = numbered(ranked.where("__occ > 1"), [], [F.col(order)], "__rank")
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0))).head()[0]
    renamed = fresh.withColumn("new_id", F.col("__rank") + top).drop("__rank", "__occ")
    kept = ranked.where("__occ = 1").withColumn("new_id", F.col("node_id")).drop("__occ")
    return kept.unionByName(renamed)


def _copy_objects(df: DataFrame, mapping: DataFrame, how: str = "inner") -> DataFrame:
    """Objects of ``mapping.old_id`` under ``mapping.new_id``."""
    cols = df.columns
    out = lookup_join(df, mapping.select("old_id", "new_id"), "node_id", "old_id", how)
    return out.withColumn("node_id", F.col("new_id")).select(*cols)


def _copied(store: Store, copy) -> tuple[dict[str, DataFrame], DataFrame]:
    """``copy(table)`` for node rows and object tables of a store, and the texts that the rows name."""
    rows, texts = store.split()
    return {name: copy(rows if name == "node" else getattr(store, name)) for name in ["node", *OBJECT_TABLES]}, texts


def _put_together(made: dict[str, DataFrame], texts: DataFrame, **tables: DataFrame) -> Store:
    return Store(**made, **tables).with_parts(made["node"], texts)


def delete_subtree(store: Store, paths: DataFrame, roots: list[int]) -> Store:
    """The store without the subtrees of ``roots``; cascades over all six tables.

    When a master goes and members stay, the smallest remaining member takes
    over its data and the other members point to it.
    """
    gone = paths.where(F.arrays_overlap("path", F.array(*[F.lit(r).cast("long") for r in roots]))).select("node_id")
    gone = sized(gone, "gone")
    left = store.children.join(gone, "node_id", "left_anti")
    gone_masters = gone.select(F.col("node_id").alias("gone_master"))
    heirs = (
        left.where(F.coalesce("master_id", F.lit(0)) > 0)
        .join(gone_masters, F.col("master_id") == F.col("gone_master"), "left_semi")
        .groupBy(F.col("master_id").alias("old_id")).agg(F.min("node_id").alias("new_id"))
    )
    heirs = sized(heirs, "heirs")
    children = lookup_join(left, heirs, "master_id", "old_id", "left").select(
        "node_id", "father_id", "sequence",
        F.when(F.col("new_id").isNull(), F.col("master_id"))
        .when(F.col("new_id") == F.col("node_id"), F.lit(0)).otherwise(F.col("new_id")).cast("long").alias("master_id"),
    )
    made, texts = _copied(store, lambda df: df.join(gone, "node_id", "left_anti").unionByName(_copy_objects(df, heirs)))
    return _put_together(made, texts, children=children, bookmark=store.bookmark.join(gone, "node_id", "left_anti"))


def export_subtree(store: Store, ordered: DataFrame, root: int, with_children: bool = True) -> Store:
    """A store of one subtree, or of one node when ``with_children`` is off.

    ``ordered`` has node_id, path and pos. A master outside the export is
    replaced by the first exported member in document order; a single node
    becomes its own master.
    """
    inside = subtree(ordered, root) if with_children else ordered.where(F.col("node_id") == root)
    kept = store.children.join(inside.select("node_id", "pos"), "node_id")
    holder = kept.withColumn("holder", holder_id())
    if with_children:
        ids = kept.select(F.col("node_id").alias("in_id"))
        outside = holder.where(F.col("holder") != F.col("node_id")).join(ids, F.col("holder") == F.col("in_id"), "left_anti")
    else:
        outside = holder.where(F.col("holder") != F.col("node_id"))
    heirs = outside.groupBy(F.col("holder").alias("old_id")).agg(F.min_by("node_id", "pos").alias("new_id"))
    children = lookup_join(holder, heirs, "holder", "old_id", "left").select(
        "node_id",
        F.when(F.col("node_id") == root, F.lit(0)).otherwise(F.col("father_id")).cast("long").alias("father_id"),
        "sequence",
        F.when(F.col("new_id").isNull(), F.col("master_id"))
        .when(F.col("new_id") == F.col("node_id"), F.lit(0)).otherwise(F.col("new_id")).cast("long").alias("master_id"),
    )
    own = holder.where(F.col("holder") == F.col("node_id")).select(F.col("node_id").alias("old_id"), F.col("node_id").alias("new_id"))
    mapping = sized(own.unionByName(heirs), "exported")
    made, texts = _copied(store, lambda df: _copy_objects(df, mapping))
    marks = store.bookmark.join(kept.select("node_id"), "node_id", "left_semi")
    return _put_together(made, texts, children=children, bookmark=marks)


def slice_node(store: Store, node_id: int, start: int, end: int) -> dict[str, DataFrame]:
    """A selection of one node: text ``start..end`` and its objects, offsets rebased."""
    out = {
        "node": store.node.where(F.col("node_id") == node_id).withColumn("txt", F.substring("txt", start + 1, end - start))
    }
    for name in OBJECT_TABLES:
        df = getattr(store, name)
        inside = df.where((F.col("node_id") == node_id) & F.col("offset").between(start, end))
        out[name] = inside.withColumn("offset", F.col("offset") - start)
    return out


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` up to ``end``."""
    return F.substring(text, start + 1, end - start)


def _remap_links(image: DataFrame, mapping: DataFrame) -> DataFrame:
    """Node links that point inside the mapped ids follow them."""
    parsed = image.withColumn("__l", parse_link("link")).withColumn("__t", F.col("__l.node_id"))
    joined = lookup_join(parsed, mapping.select(F.col("old_id").alias("__o"), F.col("new_id").alias("__n")), "__t", "__o", "left")
    moved = F.struct(
        F.col("__l.type").alias("type"), F.col("__n").alias("node_id"), F.col("__l.webs").alias("webs"),
        F.col("__l.file").alias("file"), F.col("__l.fold").alias("fold"), F.col("__l.anch").alias("anch"),
    )
    link = F.when((F.col("__l.type") == "node") & F.col("__n").isNotNull(), format_link(moved)).otherwise(F.col("link"))
    return joined.withColumn("link", link).select(*image.columns)


def merge_store(a: Store, b: Store, paths_b: DataFrame, parent: int = 0, remap_links: bool = False) -> Store:
    """Store ``b`` appended below ``parent`` of ``a`` with fresh ids.

    Ids are given in the document order of ``b`` from the next id of ``a`` on;
    fathers and masters follow the map, objects follow their node. Links by node
    id stay as they are, as in the reference, unless ``remap_links`` is set.
    Bookmarks of ``b`` are not taken over.
    """
    base = _next_id_value(a.children)
    ordered = preorder(paths_b)
    mapping = sized(ordered.select(F.col("node_id").alias("old_id"), (F.col("pos") + base - 1).alias("new_id")), "new-ids")
    last = a.children.where(F.col("father_id") == parent).agg(F.coalesce(F.max("sequence"), F.lit(0))).head()[0]
    moved = lookup_join(b.children, mapping, "node_id", "old_id", "inner", check=False).drop("old_id")
    fathers = mapping.select(F.col("old_id").alias("fo"), F.col("new_id").alias("father_new"))
    masters = mapping.select(F.col("old_id").alias("mo"), F.col("new_id").alias("master_new"))
    moved = lookup_join(moved, fathers, "father_id", "fo", "left")
    moved = lookup_join(moved, masters, "master_id", "mo", "left")
    children_b = moved.select(
        F.col("new_id").alias("node_id"),
        F.when(F.col("father_id") == 0, F.lit(parent)).otherwise(F.col("father_new")).cast("long").alias("father_id"),
        F.when(F.col("father_id") == 0, F.col("sequence") + last).otherwise(F.col("sequence")).cast("long").alias("sequence"),
        F.when(F.col("master_id") > 0, F.coalesce("master_new", "master_id")).otherwise(F.lit(0)).cast("long").alias("master_id"),
    )
    copied, texts_b = _copied(b, lambda df: _copy_objects(df, mapping))
    if remap_links:
        copied["image"] = _remap_links(copied["image"], mapping)
    own, texts = _copied(a, lambda df: df)
    made = {name: df.unionByName(copied[name]) for name, df in own.items()}
    return _put_together(made, texts if a is b else texts.unionByName(texts_b), children=a.children.unionByName(children_b), bookmark=a.bookmark)


def _at(rows: DataFrame, now: int) -> DataFrame:
    """Node rows with the time ``now``; objects have none."""
    times = [c for c in ("ts_creation", "ts_lastsave") if c in rows.columns]
    return rows.withColumns({c: F.lit(now).cast("long") for c in times})


def duplicate_subtree(store: Store, ordered: DataFrame, root: int, now: int, shared: bool = False) -> Store:
    """The store with a copy of ``root`` (and its subtree) after the original.

    A deep copy gets fresh ids in document order and the time ``now``; copies of
    shared members below the root stay shared. With ``shared`` only the root is
    repeated, as a further position of the same data.
    """
    base = _next_id_value(store.children)
    inside = ordered.where(F.col("node_id") == root) if shared else subtree(ordered, root)
    first = inside.agg(F.coalesce(F.min("pos"), F.lit(0))).head()[0]  # a subtree is a run of positions
    mapping = sized(inside.select(F.col("node_id").alias("old_id"), (F.col("pos") - first + base).alias("new_id")), "copies")
    rows = lookup_join(store.children, mapping, "node_id", "old_id", "inner", check=False).drop("old_id")
    rows = lookup_join(rows, mapping.select(F.col("old_id").alias("fo"), F.col("new_id").alias("fn")), "father_id", "fo", "left")
    top = F.col("node_id") == root
    master = F.when(top & F.lit(not shared), F.lit(0)).when(F.lit(shared), holder_id()).otherwise(F.col("master_id"))
    copies = rows.select(
        F.col("new_id").alias("node_id"),
        F.when(top, F.col("father_id")).otherwise(F.col("fn")).cast("long").alias("father_id"),
        "sequence", master.cast("long").alias("master_id"), F.when(top, 1).otherwise(0).alias("__after"),
    )
    # Siblings after the root move down by one to make room.
    at = store.children.where(F.col("node_id") == root).select("father_id", "sequence").head()
    if at is None:
        return store
    kept = store.children.select(
        "node_id", "father_id",
        F.when((F.col("father_id") == at.father_id) & (F.col("sequence") > at.sequence), F.col("sequence") + 1)
        .otherwise(F.col("sequence")).alias("sequence"),
        "master_id",
    )
    children = kept.unionByName(copies.withColumn("sequence", F.col("sequence") + F.col("__after")).drop("__after"))
    if shared:
        return store.with_tables(children=children)
    data = rows.select(
        F.when(top, holder_id()).otherwise(F.when(F.coalesce("master_id", F.lit(0)) > 0, F.lit(None)).otherwise(F.col("node_id"))).alias("old_id"),
        "new_id",
    ).where("old_id IS NOT NULL")
    made, texts = _copied(store, lambda df: df.unionByName(_at(_copy_objects(df, data), now)))
    return _put_together(made, texts, children=children, bookmark=store.bookmark)


def find_or_create_child(children: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (father_id, name): the first child of that name, or a new id.

    Returns father_id, name, node_id, sequence and ``created``. New children go
    to the end of their father.
    """
    named = children.join(names.select("node_id", "name"), "node_id")
    known = named.groupBy("father_id", "name").agg(F.min_by("node_id", F.struct("sequence", "node_id")).alias("found_id"))
    ask = wanted.select("father_id", "name").distinct()
    hits = ask.join(known, ["father_id", "name"], "left")
    old = hits.where("found_id IS NOT NULL").select(
        "father_id", "name", F.col("found_id").alias("node_id"), F.lit(False).alias("created")
    )
    new = hits.where("found_id IS NULL").select("father_id", "name")
    base = _next_id_value(children)
    ranked = numbered(new, [], [F.col("father_id"), F.col("name")], "__r")
    created = ranked.select("father_id", "name", (F.col("__r") + base - 1).alias("node_id"), F.lit(True).alias("created"))
    return old.unionByName(created)


def inherit_syntax(store: Store, paths: DataFrame, root: int) -> DataFrame:
    """Node rows below ``root`` that take its syntax: writable and different.

    Only changed rows come back. A shared node changes when any of its
    positions lies below the root.
    """
    below = paths.where(F.array_contains("path", F.lit(root)) & (F.col("node_id") != root))
    holders = sized(below.select(holder_id().alias("node_id")).distinct(), "below")
    root_holder = store.children.where(F.col("node_id") == root).select(holder_id()).head()
    wanted = root_holder and store.node.where(F.col("node_id") == root_holder[0]).select("syntax").head()
    if not wanted:
        return store.node.limit(0)
    nodes = store.node.join(holders, "node_id", "left_semi")
    open_nodes = nodes.where(F.col("is_ro").bitwiseAND(F.lit(1).cast("long")) == 0)
    return open_nodes.where(F.col("syntax") != wanted[0]).withColumn("syntax", F.lit(wanted[0]))


def clear_exclusions(node: DataFrame) -> DataFrame:
    """Rows whose search exclusions are taken away; all rows returned are changed."""
    return node.where(F.coalesce("level", F.lit(0)) != 0).withColumn("level", F.lit(0).cast("long"))


def resolve_broken_links(named_links: DataFrame, names: DataFrame, ordered: DataFrame) -> DataFrame:
    """Links by node name to ids; of equal names the last in document order wins.

    ``named_links`` has a ``target_name``; unknown names keep a NULL id.
    """
    placed = names.select("node_id", "name").join(ordered.select("node_id", "pos"), "node_id")
    last = placed.groupBy(F.col("name").alias("ln")).agg(F.max_by("node_id", "pos").alias("target_id"))
    return lookup_join(named_links, last, "target_name", "ln", "left").drop("ln")


def calendar_tree(days: DataFrame, seconds: str, parent: int = 0, first_id: int = 1) -> DataFrame:
    """Year, month and day nodes for all times, each once: node_id, father_id,
    level, name, sequence.

    Distinct days are few (365 a year), so numbering them is small work.
    """
    ts = F.timestamp_seconds(seconds)
    day = F.to_date(ts).alias("day")
    d = days.select(day).distinct()
    rows = d.select(F.explode(F.array(
        F.struct(F.lit(1).alias("level"), F.trunc("day", "year").alias("at"), F.date_format("day", "yyyy").alias("name")),
        F.struct(F.lit(2).alias("level"), F.trunc("day", "month").alias("at"), F.date_format("day", "MMMM").alias("name")),
        F.struct(F.lit(3).alias("level"), F.col("day").alias("at"), F.date_format("day", "dd EEE").alias("name")),
    )).alias("n")).select("n.*").distinct()
    ids = rows.withColumn("rank", F.row_number().over(Window.orderBy("at", "level")))
    up = ids.select(F.col("level").alias("ul"), F.col("at").alias("ua"), F.col("rank").alias("ur"))
    father_at = F.when(F.col("level") == 3, F.trunc("at", "month")).otherwise(F.trunc("at", "year"))
    joined = ids.withColumn("fa", father_at).join(up, (F.col("ul") == F.col("level") - 1) & (F.col("ua") == F.col("fa")), "left")
    father = F.when(F.col("level") == 1, F.lit(parent)).otherwise(F.col("ur") + first_id - 1).cast("long")
    out = joined.select(
        (F.col("rank") + first_id - 1).cast("long").alias("node_id"), father.alias("father_id"),
        F.col("level").cast("long").alias("level"), "name", "at",
    )
    seq = F.row_number().over(Window.partitionBy("father_id").orderBy("at"))
    return out.withColumn("sequence", seq.cast("long")).drop("at")


#: Parts of a table whose digests are compared before rows are.
DIFF_PARTS = 4096


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), "node_id"), F.lit(parts))


def differing_parts(left: DataFrame, right: DataFrame, parts: int = DIFF_PARTS) -> DataFrame:
    """(part): the parts of two tables whose rows differ, by their number and two sums of row digests.

    Rows are summed up where they lie; a row per part and task is all that moves.
    """
    def digests(df: DataFrame, names: list[str]) -> DataFrame:
        # a hash passes over nulls, so where they stand is hashed too
        nulls = F.concat(*[F.isnull(c).cast("string") for c in left.columns])
        row = lambda seed: F.sum(F.xxhash64(F.lit(seed), *left.columns, nulls).cast("decimal(38,0)"))
        return df.groupBy(_part(parts).alias("part")).agg(*[c.alias(n) for c, n in zip((F.count(F.lit(1)), row(1), row(2)), names, strict=True)])

    both = digests(left, ["n", "h", "g"]).join(digests(right, ["n2", "h2", "g2"]), "part", "full")
    return both.where("NOT (n <=> n2 AND h <=> h2 AND g <=> g2)").select("part")


def _named_rows(store: Store) -> DataFrame:
    """The node table with names of texts in their place; equal texts have equal names."""
    if store.parts is None:
        return store.node.withColumn("text_id", text_id("txt")).drop("txt")
    return plain_parts(store)[0].drop("stored")


def store_diff(a: Store, b: Store, parts: int = DIFF_PARTS) -> DataFrame:
    """Rows that only one store has, per table: side, table, node_id.

    Equal stores give no rows. Duplicates count, so this is a round-trip test. Tables are
    compared part by part through digests; only the rows of parts that differ are held
    against each other, by a digest of all their columns, and tables without any end there.
    """
    out = None
    by_name = a.parts is not None or b.parts is not None
    for name, left in a.tables().items():
        right = getattr(b, name)
        if name == "node" and by_name:
            left, right = _named_rows(a), _named_rows(b)
        cols = [c for c in left.columns if c in right.columns]
        left, right = left.select(*cols), right.select(*cols)
        differ = materialize(differing_parts(left, right, parts), "differ")
        if differ.isEmpty():
            continue
        row = F.unhex(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)).alias("row")
        x, y = (df.withColumn("__part", _part(parts)).join(F.broadcast(differ), F.col("__part") == F.col("part"), "left_semi").select("node_id", row) for df in (left, right))
        surplus = x.withColumn("n", F.lit(1)).unionByName(y.withColumn("n", F.lit(-1))).groupBy("node_id", "row").agg(F.sum("n").alias("n")).where("n <> 0")
        rows = surplus.select("node_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))))
        part = rows.select(F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.lit(name).alias("table_name"), "node_id")
        out = part if out is None else out.unionByName(part)
    return a.node.sparkSession.createDataFrame([], "side string, table_name string, node_id long") if out is None else out


def pending_minus_removed(pending: DataFrame, removed: DataFrame) -> DataFrame:
    """Pending writes without those of removed nodes."""
    return pending.join(removed.select("node_id").distinct(), "node_id", "left_anti")
