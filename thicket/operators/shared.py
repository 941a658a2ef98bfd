"""Shared nodes: several tree positions that show one node's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..sources.store import Store


def holder_id() -> Column:
    """Id of the node that owns the data of a ``children`` row."""
    return F.when(F.coalesce("master_id", F.lit(0)) > 0, F.col("master_id")).otherwise(F.col("node_id"))


def resolve_shared(store: Store, *columns: str) -> DataFrame:
    """Every tree position with its holder's properties.

    A position whose master has no row falls back to its own row, if any, and is
    reported in ``missing_master``. Pass the columns needed: text is not read
    unless asked for.
    """
    names = list(columns) or [c for c in store.node.columns if c != "node_id"]
    props = store.node.select(F.col("node_id").alias("hid"), *names)
    pos = store.children.withColumn("want", holder_id())
    own = pos.where(F.col("want") == F.col("node_id"))
    shared = pos.where(F.col("want") != F.col("node_id"))
    first = own.unionByName(shared)
    joined = lookup_join(first, props, "want", "hid", "left")
    # Fall back only where a master is missing; usually there is no such row.
    ids = store.node.select(F.col("node_id").alias("own_id"), *[F.col(c).alias(f"own_{c}") for c in names])
    broken = joined.where(F.col("hid").isNull() & (F.col("want") != F.col("node_id"))).select(*store.children.columns)
    repaired = broken.join(ids, F.col("node_id") == F.col("own_id"), "left").select(
        *store.children.columns, F.col("own_id").alias("holder_id"),
        *[F.col(f"own_{c}").alias(c) for c in names], F.lit(True).alias("missing_master"),
    )
    good = joined.where(F.col("hid").isNotNull() | (F.col("want") == F.col("node_id"))).select(
        *store.children.columns, F.col("hid").alias("holder_id"), *names, F.lit(False).alias("missing_master")
    )
    return good.unionByName(repaired)


def shared_groups(children: DataFrame) -> DataFrame:
    """Members per master as counts and bounds; ids of a group stay rows.

    ``n_members`` counts positions besides the master.
    """
    return (
        children.where(F.coalesce("master_id", F.lit(0)) > 0).groupBy("master_id")
        .agg(
            F.countDistinct("node_id").cast("long").alias("n_members"),
            F.min("node_id").alias("first_member"), F.max("node_id").alias("last_member"),
        )
    )


def shared_members(children: DataFrame) -> DataFrame:
    """(master_id, member_id) rows, the master itself included."""
    members = children.where(F.coalesce("master_id", F.lit(0)) > 0)
    masters = members.select("master_id").distinct()
    return members.select("master_id", F.col("node_id").alias("member_id")).unionByName(
        masters.select("master_id", F.col("master_id").alias("member_id"))
    ).distinct()
