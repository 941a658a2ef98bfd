"""Near duplicates among vectors, by a forest of random-projection trees.

Each tree splits the vectors along random directions; those within a margin of a split go
down both sides. Vectors are compared in the leaves they share. A pair counts in one leaf
alone, the smallest of all that its two vectors share, so that no pair leaves its leaf: a
leaf gives a count of links and a component for each of its vectors.

A dense crowd can't be split, as all of it lies within the margin. In such a leaf balls are
sought: vectors within half the angle of a link from one centre are all linked, so they are
counted as one group and never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.llm.blocks import paired, same_component
from thicket.llm.components import components
from thicket.session import materialize

LEAST_COSINE = 0.9
#: Trees, and how many of them are compared at a time, which bounds what is shuffled at once.
TREES, AT_ONCE = 12, 4
#: Vectors within this distance of a split go down both sides.
MARGIN = 0.02
#: Leaves are to hold LEAF vectors; those with more than LARGE are split again; more than BLOCK are compared in blocks.
LEAF, LARGE, BLOCK = 400, 1024, 1024
#: Levels of splits that are fitted at a time, on a sample of about so many vectors per node.
LEVELS, SAMPLE = 6, 4096
#: A split that leaves more than this share of the vectors on one side is none.
DENSE = 0.8
#: A ball holds this share of its leaf's sample at least; so a leaf has 50 of them at most.
BALL_SHARE = 0.02
#: Cosines closer to the limit than this are computed anew, row by row.
BAND = 1e-9
NODE = ["dim", "node"]


def directions(dim: int, tree: int, rnd: int) -> np.ndarray:
    """A tree's random unit vectors, one per level of this round."""
    r = np.random.default_rng([dim, tree, rnd]).standard_normal((LEVELS, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_value(*columns: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """The rows of each combination of values."""
    if len(columns[0]):
        order = np.lexsort(columns[::-1])
        change = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        for rows in np.split(order, np.flatnonzero(change) + 1):
            yield tuple(c[rows[0]].item() for c in columns), rows


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long binaries as rows of doubles."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(len(column), -1).astype(np.float64)


def fit_splits(p: np.ndarray, n: float, margin: float, leaf: int) -> np.ndarray | None:
    """Thresholds of a subtree as a heap, none (nan) where a node stays whole; None if the top can't be split.

    ``p`` holds a sample's projections per level, ``n`` the node's vectors. Of nine places
    around the median the one that fewest vectors lie close to becomes the threshold.
    """
    out = np.full((1 << LEVELS) - 1, np.nan, dtype=np.float32)
    todo = [(0, 0, np.arange(len(p)))]
    while todo:
        at, level, rows = todo.pop()
        if level == LEVELS or len(rows) < 8 or len(rows) * n / len(p) <= leaf:
            continue
        own = np.sort(p[rows, level])
        places = own[(len(own) * np.linspace(0.3, 0.7, 9)).astype(int)].astype(np.float32)
        close = np.searchsorted(own, places + margin) - np.searchsorted(own, places - margin)
        best = places[np.lexsort((np.abs(np.arange(9) - 4), close))[0]]
        sides = [rows[p[rows, level] < best + margin], rows[p[rows, level] >= best - margin]]
        if max(map(len, sides)) <= DENSE * len(rows):
            out[at] = best
            todo += [(2 * at + 1 + s, level + 1, side) for s, side in enumerate(sides)]
    return None if np.isnan(out[0]) else out


def routed(p: np.ndarray, splits: np.ndarray, margin: float) -> list[np.ndarray]:
    """For each heap place of a subtree's leaves, the rows that get there."""
    out, todo = [], [(0, 0, np.arange(len(p)))]
    while todo:
        at, level, rows = todo.pop()
        if at >= len(splits) or np.isnan(splits[at]):
            out.append((at, rows))
            continue
        x = p[rows, level]
        todo += [(2 * at + 1, level + 1, rows[x < splits[at] + margin]), (2 * at + 2, level + 1, rows[x >= splits[at] - margin])]
    return [(at, rows) for at, rows in out if len(rows)]


def _projected(trees: int, rnd: int, kind: str):
    """(key, dim, node, p): a row per leaf that a vector is in so far, with its projections for this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for (dim,), rows in by_value(dims):
                if dim not in known:
                    known[dim] = np.concatenate([directions(dim, t, rnd) for t in range(trees)]).T
                at = pa.array(rows)
                p = (units(matrix(batch["x"].take(at), kind)) @ known[dim]).astype(np.float32).reshape(len(rows), trees, LEVELS)
                leaves = batch["leaves"].take(at)
                lengths = np.diff(np.asarray(leaves.offsets)) if len(leaves) else np.zeros(0, dtype=int)
                node = np.asarray(leaves.flatten())
                of = np.repeat(np.arange(len(rows)), lengths)
                data = p[of, tree_of(node)].tobytes()
                size = 4 * LEVELS
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].take(at).take(pa.array(of)), pa.array(np.full(len(of), dim), pa.int32()), pa.array(node), pa.array([data[n * size : (n + 1) * size] for n in range(len(of))], pa.binary())],
                    names=["key", "dim", "node", "p"],
                )

    return run


#: Numbers of nodes have a digit of so many bits for each round, the first of them for the tree.
SHIFT = LEVELS + 1
TREE_SQL = f"shiftright(l, cast({SHIFT} * floor((length(bin(l)) - 1) / {SHIFT}) as int))"


def tree_of(node: np.ndarray) -> np.ndarray:
    """The tree of a node; roots are numbered from 1."""
    out = node
    while (out >> SHIFT).any():
        out = np.where(out >> SHIFT > 0, out >> SHIFT, out)
    return out - 1


def plant(vectors: DataFrame, trees: int, margin: float, leaf: int, large: int, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, dim, leaves) of each vector, and the leaves (dim, node, n) that can't be split further, if any.

    A round splits all leaves that are too large by up to LEVELS levels. Only projections
    are moved, not vectors; thresholds come from a sample of each leaf.
    """

    def fit(table: pa.Table) -> pa.Table:
        splits = fit_splits(matrix(table["p"], "<f4"), table["n"][0].as_py(), margin, leaf)
        return pa.table({"dim": table["dim"][:1], "node": table["node"][:1], "splits": pa.array([None if splits is None else splits.tobytes()], pa.binary())})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = np.asarray(batch["key"]), []
            for (_, node), rows in by_value(np.asarray(batch["dim"]), np.asarray(batch["node"])):
                splits = np.frombuffer(batch["splits"][int(rows[0])].as_py(), dtype=np.float32)
                for at, own in routed(matrix(batch["p"].take(pa.array(rows)), "<f4"), splits, margin):
                    out.append((keys[rows[own]], np.full(len(own), node), np.full(len(own), (node << SHIFT) + at + 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "node", "child"])

    roots = F.array(*[F.lit(t + 1).cast("long") for t in range(trees)])
    placed, dense, rnd = materialize(vectors.select("key", "dim", roots.alias("leaves")), "placed"), None, 0
    while True:
        sizes = placed.select("dim", F.explode("leaves").alias("node")).groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > large)
        if dense is not None:
            sizes = sizes.join(dense.select(*NODE), NODE, "left_anti")
        sizes = materialize(sizes, "large")
        if sizes.isEmpty():
            return placed, dense
        here = vectors.join(placed.select("key", "leaves"), "key").select("key", "dim", "x", "leaves").mapInArrow(_projected(trees, rnd, kind), "key long, dim int, node long, p binary")
        here = materialize(here.join(sizes, NODE), "projected")
        drawn = here.where(F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) < F.lit(SAMPLE * float(1 << 30)) / F.col("n"))
        subtrees = materialize(drawn.select(*NODE, "n", "p").groupBy(*NODE).applyInArrow(fit, "dim int, node long, splits binary"), "subtrees")
        whole = subtrees.where("splits IS NULL").join(sizes, NODE).select(*NODE, "n")
        dense = materialize(whole if dense is None else dense.union(whole), "dense")
        moved = here.join(subtrees.where("splits IS NOT NULL"), NODE).select("key", "dim", "node", "p", "splits").mapInArrow(route, "key long, node long, child long")
        moved = moved.groupBy("key").agg(F.collect_set("node").alias("old"), F.collect_list("child").alias("new"))
        placed = placed.join(moved, "key", "left").select("key", "dim", F.when(F.col("new").isNull(), F.col("leaves")).otherwise(F.concat(F.array_except("leaves", "old"), "new")).alias("leaves"))
        placed, rnd = materialize(placed, "placed"), rnd + 1


def centres(x: np.ndarray, least: float) -> list[np.ndarray]:
    """Centres of balls in a sample of unit vectors, the largest first, each with BALL_SHARE of it at least."""
    out, left = [], np.arange(len(x))
    while len(left) >= max(2, BALL_SHARE * len(x)):
        near = x[left] @ x[left].T >= least
        best = int(np.argmax(near.sum(axis=1)))
        centre = x[left][near[best]].mean(axis=0)
        centre /= np.linalg.norm(centre)
        inside = x[left] @ centre >= least
        if inside.sum() < max(2, BALL_SHARE * len(x)):
            break
        out.append(centre)
        left = left[~inside]
    return out


def balls(vectors: DataFrame, placed: DataFrame, dense: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(key, ball): for vectors of dense leaves the first ball that they lie in, if any; those of one ball are all linked."""
    least = math.cos(math.acos(cosine) / 2) + BAND

    def find(table: pa.Table) -> pa.Table:
        found = centres(units(matrix(table["x"], kind)), least)
        rows = [(table["dim"][0].as_py(), table["node"][0].as_py(), n, c.tobytes()) for n, c in enumerate(found)]
        return pa.Table.from_pylist([dict(zip(("dim", "node", "number", "centre"), r, strict=True)) for r in rows], pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("number", pa.int32()), ("centre", pa.binary())]))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in by_value(np.asarray(batch["dim"])):
                at = pa.array(rows)
                near = np.einsum("ij,ij->i", units(matrix(batch["x"].take(at), kind)), matrix(batch["centre"].take(at), "<f8")) >= least
                yield batch.select(["key", "node", "number"]).take(pa.array(rows[near]))

    here = placed.select("key", "dim", F.explode("leaves").alias("node")).join(dense, NODE).join(vectors.select("key", "x"), "key")
    drawn = here.where(F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) < F.lit(SAMPLE / 2 * (1 << 30)) / F.col("n"))
    found = materialize(drawn.select(*NODE, "x").groupBy(*NODE).applyInArrow(find, "dim int, node long, number int, centre binary"), "centres")
    held = here.join(found, NODE).select("key", "dim", "node", "number", "x", "centre").mapInArrow(inside, "key long, node long, number int")
    return materialize(held.groupBy("key").agg(F.min(F.struct("node", "number")).alias("ball")), "balls")


def compare(cosine: float, kind: str):
    """(key, n, root): for the linked vectors of a leaf, or of two of its blocks, the links that count here and a component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        raw, keys, side = matrix(table["x"], kind), np.asarray(table["key"]), np.asarray(table["side"])
        x = units(raw)
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if table["two"][0].as_py() else a
        cos = x[a] @ x[b].T
        i, j = np.nonzero(cos >= cosine - BAND)
        value = cos[i, j]
        i, j = a[i], b[j]
        ball = np.unique(np.array(["" if v is None else f"{v['node']} {v['number']}" for v in table["ball"].to_pylist()]), return_inverse=True)
        grouped = ball[0][ball[1]] != ""
        keep = (~grouped[i]) | (ball[1][i] != ball[1][j])
        if b is a:
            keep &= i < j
        i, j, value = i[keep], j[keep], value[keep]
        close = np.flatnonzero(np.abs(value - cosine) < BAND)
        value[close] = [np.dot(raw[p], raw[q]) / (math.sqrt(np.dot(raw[p], raw[p])) * math.sqrt(np.dot(raw[q], raw[q]))) for p, q in zip(i[close], j[close], strict=True)]
        i, j = i[value >= cosine], j[value >= cosine]
        if len(i):
            # only in the smallest leaf that both are in
            rows, leaf = np.unique(np.concatenate([i, j])), table["node"][0].as_py()
            lists = [[v for v in table["leaves"][int(r)].as_py() if v < leaf] for r in rows]
            names = {v: n for n, v in enumerate(sorted({v for held in lists for v in held}))}
            own = np.zeros((len(rows), len(names)), dtype=np.float32)
            for r, held in enumerate(lists):
                own[r, [names[v] for v in held]] = 1
            i, j = np.searchsorted(rows, i), np.searchsorted(rows, j)
            first = (own @ own.T)[i, j] == 0
            i, j = i[first], j[first]
            n = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            root = same_component(len(rows), i, j)
            keys = keys[rows]
            full = np.flatnonzero(n)
            return pa.table({"key": keys[full], "n": n[full], "root": keys[root[full]]})
        return pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})

    return run


def links_in(members: DataFrame, cosine: float, block: int, kind: str) -> DataFrame:
    """Compares the members (dim, node, key, x, leaves, ball) of each leaf; large leaves in pairs of blocks.

    Vectors of one ball share blocks, and such blocks are held against others only.
    """
    ball = F.when(F.col("ball").isNull(), "").otherwise(F.concat_ws(" ", "ball.node", "ball.number"))
    return paired(members, NODE, ball, block).groupBy(*NODE, "pair").applyInArrow(compare(cosine, kind), "key long, n long, root long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = LEAST_COSINE, trees: int = TREES, margin: float = MARGIN, leaf: int = LEAF, large: int = LARGE, block: int = BLOCK,
) -> DataFrame:
    """Links vectors whose cosine, in double precision, is at least ``cosine``.

    Returns a row per row of the input: the id, ``n_links`` (other rows linked directly),
    ``component_id`` (the smallest id reachable by links, the own included; null if no row of
    the group has an id) and ``kept`` (whether that is the row's id; false for a null id).
    Vectors that are null, empty or zero, or that hold null or non-finite components, link
    with nothing; nor do vectors of different lengths. Repeated rows are vectors of their own
    and link with each other. An empty table gives no rows; other columns aren't carried.

    No link below the limit is ever made. A pair is missed if every tree separates it; pairs
    of one ball are never missed.
    """
    floats = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if floats else "<f8"
    rows = materialize(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("key", F.monotonically_increasing_id()), "vectors")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            data, ends = np.asarray(lists.flatten(), dtype=np.float64), np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
            if kind == "<f8" and len(lists):  # a power of two, so that squares stay finite
                most = np.maximum.reduceat(np.abs(data), ends[:-1])
                data = np.ldexp(data, -np.repeat(np.frexp(most)[1], np.diff(ends)))
            data = data.astype(kind)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(np.diff(ends), pa.int32()), pa.array([data[ends[n] : ends[n + 1]].tobytes() for n in range(len(lists))], pa.binary())], names=["key", "dim", "x"])

    valid = materialize(rows.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))).select("key", "v").mapInArrow(bytes_of, "key long, dim int, x binary"), "valid")
    placed, dense = plant(valid, trees, margin, leaf, large, kind)
    ball = None if dense is None or dense.isEmpty() else balls(valid, placed, dense, cosine, kind)
    members = valid.join(placed.select("key", "leaves"), "key")
    members = members.withColumn("ball", F.lit(None).cast("struct<node:long,number:int>")) if ball is None else members.join(ball, "key", "left")
    members, found = materialize(members, "members"), None
    for first in range(0, trees, AT_ONCE):
        own = F.expr(f"filter(leaves, l -> {TREE_SQL} > {first} AND {TREE_SQL} <= {first + AT_ONCE})")
        part = links_in(members.select("dim", "key", "x", "leaves", "ball", F.explode(own).alias("node")), cosine, block, kind)
        part = materialize(part, "links")
        found = part if found is None else found.union(part)
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("key").alias("a"), F.col("root").alias("b"))
    if ball is not None:
        crowd = materialize(ball.groupBy("ball").agg(F.count("*").alias("m"), F.min("key").alias("least")), "crowds")
        grouped = ball.join(crowd, "ball")
        counts = counts.union(grouped.select("key", F.col("m") - 1)).groupBy("key").agg(F.sum("n").alias("n"))
        edges = edges.union(grouped.select(F.col("key").alias("a"), F.col("least").alias("b")))
    roots = components(edges)
    whole = rows.select("key", "id").join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = materialize(whole, "whole")
    ids = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    out = whole.join(ids, "root")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
