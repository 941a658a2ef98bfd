"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.blocks import same_component
from thicket.session import materialize

#: Links, of 16 bytes each, that one task may hold.
IN_ONE_TASK = 500_000


def _of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links of a task."""
    held = list(batches)
    if held:
        u, v = (np.concatenate([np.asarray(b[c]) for b in held]) for c in ("u", "v"))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = same_component(len(nodes), place[: len(u)], place[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(links: DataFrame, written: bool = False) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node it reaches.

    Alternates two steps: each node points its larger neighbours to the smallest one it
    knows, then its smaller ones. Both keep the components; a fixed point is a star around
    each root. The rounds grow with the logarithm of the longest chain. Up to IN_ONE_TASK
    links, counted before, are followed within one task, with the same result. Links that are
    ``written`` can be read twice, so few are counted where they lie.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    if written and edges.count() <= IN_ONE_TASK:
        return edges.coalesce(1).mapInArrow(_of_all, "node long, root long")
    edges, before = _written(edges.distinct())
    if before[0] <= IN_ONE_TASK:
        return edges.coalesce(1).mapInArrow(_of_all, "node long, root long")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        pairs = larger.join(least, "u")
        edges = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges, after = _written(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a sum that changes when they do."""
    edges = materialize(edges, "edges")
    return edges, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
