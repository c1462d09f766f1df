"""Centroid clustering against plain integer rounds, with ties, repeats, odd vectors and few rows."""

import hashlib
import math

import numpy as np
import pytest

from chalkline.llm import centroids


def plain(rows, k=8, rounds=10, d=64):
    """rows of (vec_id, vector) -> {position: (cluster, distance)}, inertia of clusters, names."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for j in range(len(c)):
            members = [v for (_, v), (_, at) in zip(kept, own, strict=True) if at == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assigned()
    of = [sum(dist for dist, j in own if j == i) for i in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, dist, of[j], sum(of), names[j]) for (i, _), (dist, j) in zip(kept, own, strict=True)), key=str)


def vectors_of(n=300, d=64, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (12, d))
    rows = [(i, (middle[i % 12] + rng.normal(0, 0.3, d)).astype(np.float32).tolist()) for i in range(n)]
    odd = [None, [], [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [0.0] * (d - 1), [0.0] * d]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + rows[:30] + [(None, rows[0][1]), (7, [-1.0] * d), (7, [1.0] * d)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_match_plain_rounds(spark, kind):
    rows = vectors_of()
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS cluster", "'x' AS block", "2 AS distance").repartition(3)
    scanned = []
    got = centroids.cluster(table, scanned=scanned)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    n = len(plain(rows, rounds=0))
    assert scanned[0] == n and scanned[-1] < n / 2  # the bounds spare most scans


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])], [(i, [float(i % 2), 0.0]) for i in range(20)], [(i, [0.5, 0.5]) for i in range(20)]])
def test_few_equal_and_no_vectors(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster(table, dimensions=2, rounds=3)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, rounds=3, d=2)


def test_bounds_never_decide_against_the_integers():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (4000, 3))
    now = centroids.Round(x[:9].copy())
    cluster, upper, lower = now.scan(x)
    for _ in range(12):
        moved = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) for j in range(9)])
        now = centroids.Round(moved, now.centroids)
        cluster, upper, lower, n = now.assign(x, cluster, upper, lower)
        d = centroids.distances(x, moved)
        assert (cluster == d.argmin(1)).all()
        nearest = np.sqrt(d.min(1))
        d[np.arange(len(x)), cluster] = 1 << 60
        assert (upper >= nearest).all() and (lower <= np.sqrt(d.min(1))).all()
    assert n < len(x)


def test_distances_of_large_components_are_exact():
    x = np.array([[centroids.EXACT_INT - 1, -5], [centroids.EXACT_FLOAT, 3]])
    assert centroids.distances(x, -x).tolist() == [[int(((a + b) ** 2).sum()) for b in x] for a in x]
    with pytest.raises(ArithmeticError):
        centroids.quantised(np.array([[2.0**17]]))
    for rows in (np.array([[1, -(1 << 15)]]), np.array([[3, 4]]), np.zeros((0, 2), np.int64)):
        assert centroids.unpacked(centroids.packed(rows), 2).tolist() == rows.tolist()
