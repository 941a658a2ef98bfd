"""Near duplicates and clusters of vectors against brute force."""

import math
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from thicket.llm import bitplanes, vector_forest

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, key long, node long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4, "x") for i, v in rows], SCHEMA).repartition(5)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def neighbours_by_hand(rows, least):
    """(id, links, component, kept) of each row."""
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    fine = [k for k, (_, v) in enumerate(rows) if usable(v)]
    for dim in {len(rows[k][1]) for k in fine}:
        at = [k for k in fine if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in at], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if a < b:
                n[at[a]] += 1
                n[at[b]] += 1
                p, q = find(at[a]), find(at[b])
                root[max(p, q)] = min(p, q)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least_id = {r: min((i for i in held if i is not None), default=None) for r, held in ids.items()}
    return [(i, n[k], least_id[find(k)], i is not None and i == least_id[find(k)]) for k, (i, _) in enumerate(rows)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:2], repr(r)))


def near_pair(rng, cosine):
    a = rng.standard_normal(64)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(64)
    b -= a * (a @ b)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b)


def test_pairs_crowds_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [list(v) for v in rng.standard_normal((400, 64))]
    for cosine in np.linspace(0.88, 0.95, 60):
        vectors += [list(v) for v in near_pair(rng, cosine)]
    for n, spread in ((500, 0.02), (60, 0.03)):  # a third of all in one crowd
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        vectors += [list(centre + spread * v) for v in rng.standard_normal((n, 64))]
        vectors.append(list(centre * 3 + rng.standard_normal(64) * 0.12))
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]]]
    rows = [(k * 2 + 1, v) for k, v in enumerate(vectors)]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    bad = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [(5000 + k, v) for k, v in enumerate(bad)]
    rows += [(6000, [1.0, 0.0]), (6001, [2.0, 0.1]), (6002, [0.0, 1.0]), (6000, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (6003, [1.0])]
    out = vector_forest.near_vectors(frame(spark, rows), leaf=30, large=60, block=25, margin=0.03)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = by_id(map(tuple, out.collect())), by_id(neighbours_by_hand(rows, 0.9))
    links = sum(r[1] for r in want)
    assert sum(r[1] for r in got) <= links
    # pairs just above the limit may be missed by all trees; 0.9 of the links is the least that is asked for
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert sum(r[1] for r in got) >= 0.999 * links


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_forest.near_vectors(none).count() == 0
    assert bitplanes.centroid_clusters(none).count() == 0
    bad = frame(spark, [(1, None), (None, None)])
    assert sorted(vector_forest.near_vectors(bad).collect(), key=str) == sorted([(1, 0, 1, True), (None, 0, None, False)], key=str)
    assert bitplanes.centroid_clusters(bad).count() == 0


def test_splits_keep_neighbours_together():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = (x @ vector_forest.directions(64, 3, 0).T).astype(np.float32)
    splits = vector_forest.fit_splits(p, 2000, 0.02, 100)
    leaves = vector_forest.routed(p, splits, 0.02)
    assert set(np.concatenate([rows for _, rows in leaves])) == set(range(2000))
    assert max(len(rows) for _, rows in leaves) < 400
    assert vector_forest.fit_splits(np.zeros((50, vector_forest.LEVELS), dtype=np.float32), 5000, 0.02, 100) is None


def test_number_of_a_node_names_its_tree():
    node = np.array([1, 12, (12 << vector_forest.SHIFT) + 5, (((3 << vector_forest.SHIFT) + 127) << vector_forest.SHIFT) + 1])
    assert vector_forest.tree_of(node).tolist() == [0, 11, 11, 2]


def test_members_of_a_ball_are_linked():
    rng = np.random.default_rng(2)
    crowd = np.ones(64) / 8 + 0.02 * rng.standard_normal((300, 64))
    x = vector_forest.units(np.concatenate([crowd, rng.standard_normal((100, 64))]))
    least = math.cos(math.acos(0.9) / 2)
    found = vector_forest.centres(x, least)
    assert len(found) == 1
    inside = x[x @ found[0] >= least]
    assert len(inside) >= 300 and (inside @ inside.T).min() >= 0.9


def clusters_by_hand(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if usable(v) or (v and not any(x is None or x for x in v)) if v is not None and len(v) == 64]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in set(at):
            own = [v for (_, v), m in zip(kept, at, strict=True) if m == n]
            centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in out if m == n) for n in range(len(centroids))}
    return [(i, n, d, inertia[n], sum(inertia.values()), sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in out]


def test_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 64))
    rows = [(k * 7, list(centres[k % 9] + 0.3 * rng.standard_normal(64))) for k in range(250)]
    rows += [(3000, [1000.0 * x for x in rows[0][1]]), (3001, [-40000.5] * 64), (3002, [0.0] * 64), rows[4], rows[5], rows[5], (None, rows[6][1])]
    rows += [(4000, None), (4001, []), (4002, [1.0] * 63), (4003, [None] * 64), (4004, [float("nan")] * 64), (4005, [float("inf")] * 64), (4006, [1.0] * 65)]
    out = bitplanes.centroid_clusters(frame(spark, rows), k=12, rounds=3)
    assert by_id(map(tuple, out.collect())) == by_id(clusters_by_hand(rows, 12, 3))
    few = rows[:3]
    assert by_id(map(tuple, bitplanes.centroid_clusters(frame(spark, few)).collect())) == by_id(clusters_by_hand(few, 40, 5))


def test_planes_hold_any_integer():
    rng = np.random.default_rng(4)
    for bits in (3, 9, 20, 27, 40, 61):
        a, b = rng.integers(-(1 << bits), 1 << bits, (5, 64)), rng.integers(-(1 << bits), 1 << bits, (4, 64))
        x, c = (bitplanes.trimmed(bitplanes.planes_of(v, 64)) for v in (a, b))
        assert x.shape[1] <= bits + 1 and (bitplanes.components(x) == a).all()
        want = [[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in b] for u in a]
        assert [[int(d) for d in row] for row in bitplanes.dots(x, c)] == want
        at, d = bitplanes.nearest(bitplanes.planes_of(a, 64), b.tolist())
        far = [[sum((int(p) - int(q)) ** 2 for p, q in zip(u, v, strict=True)) for v in b] for u in a]
        assert [(int(n), int(m)) for n, m in zip(at, d, strict=True)] == [(r.index(min(r)), min(r)) for r in far]


def test_huge_components_do_not_fail(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1e6] * 64)]
    got = {r.vec_id: r for r in bitplanes.centroid_clusters(frame(spark, rows), k=1, rounds=1).collect()}
    assert got[1].distance == got[2].distance == (1 << 63) - 1 and got[1].inertia == (1 << 63) - 1
    doubles = frame(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    wide = doubles.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(1e260)))
    assert {r.vec_id: r.n_links for r in vector_forest.near_vectors(wide).collect()} == {1: 1, 2: 0, 3: 1}
