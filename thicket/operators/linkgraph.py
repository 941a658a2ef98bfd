"""The link graph: audits, hrefs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import parse_link
from ..functions.text import hier_name
from ..plans.joins import lookup_join
from ..sources.store import Store, image_kind
from .shared import holder_id


def _parsed(links: DataFrame) -> DataFrame:
    return links.withColumn("l", parse_link("link")).withColumns(
        {"link_type": F.col("l.type"), "target_id": F.col("l.node_id"), "anchor": F.col("l.anch")}
    )


def anchors(store: Store) -> DataFrame:
    """Distinct (holder, anchor name) pairs."""
    return (
        store.image.where(image_kind() == "anchor")
        .select(F.col("node_id").alias("anchor_holder"), F.col("anchor").alias("anchor_name")).distinct()
    )


def audit_links(store: Store, links: DataFrame) -> DataFrame:
    """Links that lead nowhere: ``dead_node`` or ``missing_anchor``.

    The anchor is looked for in the data of the target's holder, so a shared
    target finds its master's anchors. Many links may point to one node; the
    lookups spread such a node.
    """
    node_links = _parsed(links).where("link_type = 'node'").drop("l")
    targets = store.children.select(F.col("node_id").alias("tid"), holder_id().alias("target_holder"))
    located = lookup_join(node_links, targets, "target_id", "tid", "left")
    dead = located.where("tid IS NULL").withColumn("problem", F.lit("dead_node"))
    alive = located.where("tid IS NOT NULL AND anchor <> ''")
    named = anchors(store)
    missing = alive.join(
        named, (F.col("target_holder") == F.col("anchor_holder")) & (F.col("anchor") == F.col("anchor_name")), "left_anti"
    ).withColumn("problem", F.lit("missing_anchor"))
    return dead.unionByName(missing).drop("tid", "target_holder")


def resolve_hrefs(links: DataFrame, named: DataFrame, single_file: bool = False) -> DataFrame:
    """Add ``href``: URL, ``file://`` path, or the page of the target node.

    ``named``: node_id and ``names`` (root to node). An unknown node gives ''.
    """
    pages = named.select(
        F.col("node_id").alias("pid"),
        hier_name(F.col("names"), "--", True, node_id=F.col("node_id"), trailer=".html", html=True).alias("page"),
    )
    parsed = _parsed(links)
    joined = lookup_join(parsed, pages, "target_id", "pid", "left")
    hash_anchor = F.concat(F.lit("#"), F.col("anchor"))
    if single_file:
        node = F.when(F.col("anchor") != "", hash_anchor).otherwise(F.concat(F.lit("#"), "page"))
    else:
        node = F.when(F.col("anchor") != "", F.concat("page", hash_anchor)).otherwise(F.col("page"))
    href = (
        F.when(F.col("link_type") == "webs", F.col("l.webs"))
        .when(F.col("link_type") == "file", F.concat(F.lit("file://"), F.col("l.file")))
        .when(F.col("link_type") == "fold", F.concat(F.lit("file://"), F.col("l.fold")))
        .when((F.col("link_type") == "node") & F.col("pid").isNotNull(), node).otherwise(F.lit(""))
    )
    return joined.withColumn("href", href).select(*links.columns, "href")


def link_labels(links: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``label``: the target's name (with ``#anchor``), path, or URL without ``amp;``."""
    parsed = _parsed(links)
    joined = lookup_join(parsed, names.select(F.col("node_id").alias("nid"), F.col("name").alias("target_name")), "target_id", "nid", "left")
    no_amp = lambda c: F.replace(c, F.lit("amp;"), F.lit(""))
    anchored: Column = F.concat(
        F.coalesce("target_name", F.lit("")), F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(F.lit(""))
    )
    label = (
        F.when(F.col("link_type") == "webs", no_amp(F.col("l.webs"))).when(F.col("link_type") == "file", F.col("l.file"))
        .when(F.col("link_type") == "fold", F.col("l.fold")).when(F.col("link_type") == "node", anchored)
        .otherwise(no_amp(F.col("link")))
    )
    return joined.withColumn("label", label).select(*links.columns, "label")
