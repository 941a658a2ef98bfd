"""Groups of any size compared in pairs of blocks, so that each task holds two blocks at most."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import materialize


def paired(members: DataFrame, group: list[str], part: Column, block: int, key: str = "key") -> DataFrame:
    """The members with ``pair``, ``two`` and ``side``: groups by ``group`` and ``pair`` cover all pairs to compare.

    ``part`` is a text; members of one part other than '' needn't be compared, and no pair of
    blocks of such a part is made. Blocks hold about ``block`` members. Where ``two`` is true a
    group holds two blocks, told apart by ``side``, and only members of different sides are to
    be compared; else it holds one block, in which all are.
    """
    columns = [*members.columns, "pair", "two", "side"]
    members = members.withColumn("part", part)
    sizes = materialize(members.groupBy(*group, "part").agg(F.ceil(F.count("*") / block).alias("k")), "sizes")
    # a group whose parts make up one block needs no more than that
    large = sizes.groupBy(*group).agg(F.sum("k").alias("k"), F.count("*").alias("parts"), F.max("k").alias("most")).where("most > 1 OR parts > 8").select(*group)
    large = materialize(large, "large")
    alone = {"pair": F.lit(""), "two": F.lit(False), "side": F.lit(0)}
    if large.isEmpty():
        return members.withColumns(alone).select(*columns)
    out = members.join(large, group, "left_anti").withColumns(alone).select(*columns)
    sizes = sizes.join(large, group)
    sides = [sizes.select(*group, F.col("part").alias(f"part{s}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias(f"block{s}")) for s in (0, 1)]
    names = sizes.select(*group, F.col("part").alias("part0")).join(sizes.select(*group, F.col("part").alias("part1")), group).where("part0 < part1 OR part0 = part1 AND part0 = ''")
    pairs = names.join(sides[0], [*group, "part0"]).join(sides[1], [*group, "part1"]).where("part0 != part1 OR block0 <= block1")
    pairs = pairs.withColumn("pair", F.concat_ws(" / ", "part0", "block0", "part1", "block1")).withColumn("two", (F.col("part0") != F.col("part1")) | (F.col("block0") != F.col("block1")))
    pairs = materialize(pairs, "pairs")
    rows = members.join(sizes, [*group, "part"]).withColumn("block", F.pmod(F.xxhash64(key), "k"))
    for s in (0, 1):
        own = pairs.where("two" if s else "true").select(*group, F.col(f"part{s}").alias("part"), F.col(f"block{s}").alias("block"), "pair", "two", F.lit(s).alias("side"))
        out = out.union(rows.join(own, [*group, "part", "block"]).select(*columns))
    return out


def dealt_to_blocks(members: DataFrame, group: str, block: int, key: str = "key") -> DataFrame:
    """The members with ``pair``, ``two`` and ``side`` as of ``paired``, for members that know their component, ``root``.

    Members of one component needn't be compared, so a component that fills a quarter of a
    block in a group has blocks of its own. Only their numbers are written: a member goes to
    the pairs of its block with each other one.
    """
    sizes = members.groupBy(group, "root").agg(F.count("*").alias("m")).withColumn("part", F.when(F.col("m") > block / 4, F.col("root")))
    sizes = sizes.groupBy(group, "part").agg(F.ceil(F.sum("m") / block).alias("k"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"first": F.coalesce(F.sum("k").over(before), F.lit(0)), "all": F.sum("k").over(of_group), "most": F.max("k").over(of_group), "parts": F.count("*").over(of_group)})
    # a group whose parts make up one block needs no more than that
    one = (F.col("most") == 1) & (F.col("parts") <= 8)
    layout = materialize(sizes.select(group, "part", F.when(one, 1).otherwise(F.col("k")).alias("k"), F.when(one, 0).otherwise(F.col("first")).alias("first"), F.when(one, 1).otherwise(F.col("all")).alias("all"), one.alias("one")), "layout")
    rest = layout.where("part IS NULL").select(group, *[F.col(c).alias(f"{c}_rest") for c in ("k", "first", "all")])
    own = layout.where("part IS NOT NULL").withColumnRenamed("part", "root").withColumn("crowd", ~F.col("one")).drop("one")
    out = members.join(own, [group, "root"], "left").join(rest, group, "left")
    k, first, every = (F.coalesce(c, f"{c}_rest") for c in ("k", "first", "all"))
    placed = out.select(*members.columns, (first + F.pmod(F.xxhash64(key), k)).alias("block"), first.alias("from"), (first + k).alias("to"), F.coalesce("crowd", F.lit(False)).alias("crowd"), F.explode(F.sequence(F.lit(0).cast("long"), every - 1)).alias("other"))
    placed = placed.where(~(F.col("crowd") & (F.col("other") >= F.col("from")) & (F.col("other") < F.col("to"))))
    pair = F.concat_ws(" / ", F.least("block", "other"), F.greatest("block", "other"))
    return placed.select(*members.columns, pair.alias("pair"), (F.col("block") != F.col("other")).alias("two"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))


def same_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links (a, b) connect it to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
