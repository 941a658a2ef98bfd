"""Summaries over a store: counts, tags, words, flags, blobs, bookmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_compress, unicode_trim, word_count
from ..plans.joins import lookup_join
from ..plans.scan import numbered
from ..sources.store import Store, image_kind, node_kind
from .shared import holder_id, resolve_shared


def summary(store: Store) -> DataFrame:
    """One row of counts: node kinds over all positions, shared nodes, objects."""
    kinds = resolve_shared(store, "syntax").select(node_kind("syntax").alias("k"), "master_id")
    count = lambda cond, name: F.count_if(cond).cast("long").alias(name)
    nodes = kinds.agg(
        count(F.col("k") == "rich", "nodes_rich"), count(F.col("k") == "plain", "nodes_plain"),
        count(F.col("k") == "code", "nodes_code"),
        F.countDistinct(F.when(F.col("master_id") > 0, F.col("master_id"))).cast("long").alias("shared_groups"),
        (F.count_if(F.col("master_id") > 0) + F.countDistinct(F.when(F.col("master_id") > 0, F.col("master_id"))))
        .cast("long").alias("shared_total"),
    )
    rich = store.children.where(F.coalesce("master_id", F.lit(0)) <= 0).join(
        store.node.where(node_kind("syntax") == "rich").select("node_id"), "node_id", "left_semi"
    ).select("node_id")
    image = store.image.join(rich, "node_id", "left_semi").select(image_kind().alias("k")).agg(
        count(F.col("k") == "png", "images"), count(F.col("k") == "latex", "latexes"),
        count(F.col("k") == "file", "files"), count(F.col("k") == "anchor", "anchors"),
    )
    grid = store.grid.join(rich, "node_id", "left_semi").agg(
        count(~F.coalesce("is_light", F.lit(False)), "heavy_grids"), count(F.coalesce("is_light", F.lit(False)), "light_grids")
    )
    code = store.codebox.join(rich, "node_id", "left_semi").agg(F.count(F.lit(1)).cast("long").alias("codeboxes"))
    # Four one-row frames put together: each column is set in one of them.
    parts = nodes
    for df in (image, grid, code):
        parts = parts.unionByName(df, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def used_tags(nodes: DataFrame) -> DataFrame:
    """Distinct trimmed tags."""
    return (
        nodes.select(F.explode(F.split("tags", " ")).alias("t")).select(unicode_trim("t").alias("tag"))
        .where("tag <> ''").distinct()
    )


def tag_counts(nodes: DataFrame) -> DataFrame:
    return (
        nodes.select("node_id", F.explode(split_compress("tags", " ")).alias("tag"))
        .groupBy("tag").agg(F.countDistinct("node_id").cast("long").alias("n_nodes"))
    )


def has_flags(store: Store) -> DataFrame:
    """``has_codebox``, ``has_table``, ``has_image`` recomputed from the objects."""
    def flags(df: DataFrame, name: str) -> DataFrame:
        return df.select("node_id").distinct().withColumn(name, F.lit(True))

    rich = node_kind("syntax") == "rich"
    out = store.node.select("node_id", "syntax")
    for df, name in [(store.codebox, "has_codebox"), (store.grid, "has_table"), (store.image, "has_image")]:
        out = out.join(flags(df, name), "node_id", "left").withColumn(name, rich & F.coalesce(name, F.lit(False)))
    return out.drop("syntax")


def words_per_node(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", word_count("txt").alias("n_words"))


def words_by_subtree(store: Store, paths: DataFrame) -> DataFrame:
    """Words in every subtree; a shared node counts at each of its positions.

    Words are counted once per holder; only numbers meet the paths.
    """
    per_holder = words_per_node(store.node).withColumnRenamed("node_id", "hid")
    located = lookup_join(paths.select("node_id", "path", holder_id().alias("holder")), per_holder, "holder", "hid", "left")
    return (
        located.select(F.explode("path").alias("node_id"), F.coalesce("n_words", F.lit(0)).alias("w"))
        .groupBy("node_id").agg(F.sum("w").cast("long").alias("n_words"))
    )


def dedup_blobs(image: DataFrame) -> DataFrame:
    """Distinct contents with their copies and the bytes that sharing saves."""
    return (
        image.where("png IS NOT NULL")
        .groupBy(F.sha2("png", 256).alias("sha"), F.octet_length("png").cast("long").alias("n_bytes"))
        .agg(F.count(F.lit(1)).cast("long").alias("n_copies"))
        .withColumn("bytes_saved", F.col("n_bytes") * (F.col("n_copies") - 1))
    )


def bookmarks_view(store: Store) -> DataFrame:
    """Bookmarks of existing nodes in order, each node once, with names."""
    once = store.bookmark.groupBy("node_id").agg(F.min("sequence").alias("sequence"))
    live = once.join(store.children.select("node_id", holder_id().alias("holder")), "node_id")
    named = lookup_join(live, store.node.select(F.col("node_id").alias("hid"), "name"), "holder", "hid", "left")
    ranked = numbered(named, [], [F.col("sequence"), F.col("node_id")], "rank")
    return ranked.select("rank", "node_id", F.coalesce("name", F.lit("")).alias("name"))


def bookmarks_add(bookmark: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bookmarks with more nodes at the end; a node already there stays put."""
    new = nodes.select("node_id").distinct().join(bookmark.select("node_id"), "node_id", "left_anti")
    top = bookmark.agg(F.coalesce(F.max("sequence"), F.lit(0))).head()[0]
    ranked = numbered(new, [], [F.col("node_id")], "r")
    return bookmark.select("node_id", "sequence").unionByName(ranked.select("node_id", (F.col("r") + top).alias("sequence")))


def bookmarks_remove(bookmark: DataFrame, nodes: DataFrame) -> DataFrame:
    return bookmark.join(nodes.select("node_id"), "node_id", "left_anti")
