"""Centroid clustering in exact integers, with dot products counted over bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.session import materialize

#: Components of a vector: one bit of each makes a plane of 64 bits.
WIDTH = 64
CENTROIDS, ROUNDS, SCALE = 40, 5, 256
#: Larger integers count as this; a squared distance fits no long far below it.
LARGEST = 1 << 62
LONG = (1 << 63) - 1


def whole(col: str):
    """Whether an array has exactly 64 components, none null or non-finite."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(col).isNotNull() & (F.size(col) == WIDTH) & F.coalesce(fine, F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * SCALE)
    far = np.abs(scaled) >= LARGEST
    out = np.where(far, 0, scaled).astype(np.int64)
    out[far] = np.where(scaled[far] > 0, LARGEST - 1, -LARGEST)
    return out


def planes_of(ints: np.ndarray, n_planes: int) -> np.ndarray:
    """(row, plane): bit p of all 64 components as one uint64; the last plane is the sign, as in two's complement."""
    bits = (ints[:, None, :] >> np.arange(n_planes, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def trimmed(planes: np.ndarray) -> np.ndarray:
    """Without upper planes that only repeat the sign."""
    n = planes.shape[1]
    while n > 1 and np.array_equal(planes[:, n - 1], planes[:, n - 2]):
        n -= 1
    return planes[:, :n]


def weights(n_planes: int) -> list[int]:
    """What a bit of each plane is worth."""
    return [1 << p for p in range(n_planes - 1)] + [-(1 << (n_planes - 1))]


def components(planes: np.ndarray) -> np.ndarray:
    """The integers again."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), planes.shape[1], 8), axis=2, bitorder="little")
    return np.tensordot(bits.astype(np.int64), np.array(weights(planes.shape[1]), dtype=np.int64), axes=([1], [0]))


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of each row of x with each of c: the popcount of each AND of two planes, weighted.

    Sums that may not fit 64 bits are taken in Python's integers.
    """
    kind = np.int64 if x.shape[1] + c.shape[1] + 6 <= 62 else object
    out = np.zeros((len(x), len(c)), dtype=kind)
    for p, wp in enumerate(weights(x.shape[1])):
        for q, wq in enumerate(weights(c.shape[1])):
            out += np.bitwise_count(x[:, p, None] & c[None, :, q]).astype(kind) * (wp * wq)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """The dot product of each row with itself, over the same planes."""
    kind = np.int64 if 2 * x.shape[1] + 6 <= 62 else object
    out = np.zeros(len(x), dtype=kind)
    w = weights(x.shape[1])
    for p in range(x.shape[1]):
        for q in range(p, x.shape[1]):
            out += np.bitwise_count(x[:, p] & x[:, q]).astype(kind) * (w[p] * w[q] * (1 if p == q else 2))
    return out


def nearest(planes: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its nearest centroid, the smallest of equals, and the squared distance."""
    x, c = trimmed(planes), trimmed(planes_of(np.array(centroids, dtype=np.int64), WIDTH))
    xx, cc, xc = squares(x), squares(c), dots(x, c)
    kind = object if object in (xx.dtype, cc.dtype, xc.dtype) or x.shape[1] > 28 or c.shape[1] > 28 else np.int64
    d = xx.astype(kind)[:, None] + cc.astype(kind)[None, :] - 2 * xc.astype(kind)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(d)), at]


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, planes) of the whole vectors, written: 16, 32, 48 or 64 planes, as the largest component needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = integers(np.asarray(batch["v"].flatten(), dtype=np.float64).reshape(-1, WIDTH))
            most = np.maximum(ints, ~ints).max(axis=1, initial=0)
            width = np.select([most < 1 << 15, most < 1 << 31, most < 1 << 47], [16, 32, 48], 64)
            rows = [None] * len(ints)
            for n in np.unique(width):
                at = np.flatnonzero(width == n)
                data = planes_of(ints[at], int(n)).tobytes()
                for k, row in enumerate(at):
                    rows[row] = data[k * n * 8 : (k + 1) * n * 8]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, pa.binary())], names=["id", "planes"])

    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(whole("v"))
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("planes", T.BinaryType())])
    return materialize(kept.mapInArrow(run, schema), "planes")


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch with equally many planes, and those planes."""
    sizes = np.array([len(x) for x in batch["planes"].to_pylist()], dtype=np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        data = b"".join(batch["planes"].take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(data, dtype=np.uint64).reshape(len(at), n // 8)


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of its vectors' mean; those without vectors stay.

    A task sums up what it reads, so a row per task, centroid and component is shuffled; the
    driver gets one row per centroid and component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), WIDTH), dtype=object)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, planes in by_width(batch):
                at, _ = nearest(planes, centroids)
                ints = components(planes).astype(np.int64 if planes.shape[1] <= 32 else object)
                sums = np.zeros((len(centroids), WIDTH), dtype=ints.dtype)
                np.add.at(sums, at, ints)
                totals += sums.astype(object)
                counts += np.bincount(at, minlength=len(centroids))
        full = np.flatnonzero(counts)
        number, place = np.repeat(full, WIDTH), np.tile(np.arange(WIDTH), len(full))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(np.repeat(counts[full], WIDTH)), pa.array([str(x) for x in totals[full].ravel()], pa.string())],
            names=["cluster", "place", "n", "total"],
        )

    sums = table.mapInArrow(run, "cluster int, place int, n long, total string")
    out = [list(c) for c in centroids]
    for r in sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster][r.place] = int(r.total) // r.n
    return out


def first_centroids(table: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The components of the k vectors with the smallest digests of their ids; a null id comes last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = table.orderBy(digest.asc_nulls_last(), "planes").limit(k).collect()
    return [components(np.frombuffer(bytes(r.planes), dtype=np.uint64)[None, :])[0].tolist() for r in rows]


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2") -> DataFrame:
    """Clusters vectors of 64 components around ``k`` centroids, in integers floor(256 * x).

    Each of ``rounds`` rounds assigns every vector to its nearest centroid (squared distance;
    of equals the smaller number) and moves centroids to the floor of their vectors' mean;
    empty ones stay. Then vectors are assigned once more.

    Returns a row per vector: the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``
    and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256``
    (of its centroid's components, joined by commas). Vectors that are null, of another
    length, or hold null or non-finite components are left out; an empty table gives no rows.
    Repeated rows count once each; a null id starts no centroid while others are left, and
    of rows that share an id the smaller planes start first. Fewer vectors than ``k`` make as
    many centroids. Integers beyond +-2^62 count as that, and distances and their sums
    beyond a long as its largest value. Other columns are not carried.
    """
    table = packed(vectors, id_col, vector_col)
    centroids = first_centroids(table, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(table, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=np.int64)
            for at, planes in by_width(batch):
                cluster[at], d = nearest(planes, centroids)
                distance[at] = np.minimum(d, LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    schema = T.StructType([table.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    out = materialize(table.mapInArrow(run, schema) if centroids else table.sparkSession.createDataFrame([], schema), "clusters")
    sums = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = [(c, min(d, LONG), min(sum(sums.values()), LONG), digests[c]) for c, d in sorted(sums.items())]
    about = table.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
