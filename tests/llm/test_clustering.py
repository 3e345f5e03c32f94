"""Centroid clustering against plain Python with whole integers."""

import hashlib
import math

import numpy as np

from rankfield.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, _v string, cluster string, distance string"


def plain(rows, k, rounds, dimensions, scale=256):
    """[(vec_id, cluster, distance)] and the last centroids, by the definition."""
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    raw = {(i, tuple(c)): v for (i, c), v in zip(kept, [v for _, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)], strict=True)}
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), raw[r[0], tuple(r[1])]))[:k]
    centroids = [c for _, c in first]

    def assign():
        out = []
        for i, v in kept:
            best = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
            out.append((i, best[1], best[0]))
        return out

    for _ in range(rounds):
        now = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c, _) in zip(kept, now, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), centroids


def vectors(n, dimensions, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dimensions).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(20)]  # copies, ties
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    odd = [None, [], [0.5] * (dimensions - 1), [0.5] * (dimensions + 1), [None] + [0.1] * (dimensions - 1), [float("nan")] + [0.1] * (dimensions - 1), [float("inf")] + [0.1] * (dimensions - 1)]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def compared(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(3)
    found = clustering.cluster_vectors(df, **options).collect()
    want, centroids = plain(rows, options["centroids"], options["rounds"], options["dimensions"])
    told = lambda d: d if d < 1 << 63 else None
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=key) == sorted(((i, c, told(d)) for i, c, d in want), key=key)
    for r in found:
        own = sum(d for _, c, d in want if c == r.cluster)
        assert (r.cluster_inertia, r.inertia, r.centroid) == (told(own), told(sum(d for *_, d in want)), [str(x) for x in centroids[r.cluster]])


def test_clusters_equal_plain_python_with_odd_rows_and_ties(spark):
    compared(spark, vectors(120, 8), centroids=7, rounds=4, dimensions=8)


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    compared(spark, [(1, [0.5] * 8), (2, [0.5] * 8), (3, [-1.0] * 8)], centroids=5, rounds=2, dimensions=8)
    empty = spark.createDataFrame([], SCHEMA)
    assert clustering.cluster_vectors(empty).count() == 0
    assert clustering.cluster_vectors(spark.createDataFrame([(1, None, "", "", "")], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_integers_of_any_size_are_exact(spark):
    rng = np.random.default_rng(2)
    large = [(i, (rng.normal(size=4) * 10.0 ** int(rng.integers(0, 20))).tolist()) for i in range(60)] + [(100, [1e307, -1e307, 5e-324, 1e16]), (101, [1.5e308, 0.0, 0.0, 0.0]), (102, [2.0**19, -(2.0**19), 0.0, 1.0])]
    compared(spark, large, centroids=9, rounds=3, dimensions=4)


def test_limbs_add_up():
    for x in (0, -1, 5, 1 << 62, -(1 << 62), -(1 << 62) - 1, 10**300, -(10**300)):
        assert sum(v << 30 * k for k, v in clustering.limbs(x)) == x and all(-(1 << 62) <= v < 1 << 62 for _, v in clustering.limbs(x))


def test_tables_give_the_distances_of_sparse_and_dense_values():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-300, 300, (50, 5)), rng.integers(-(1 << 26), 1 << 26, (50, 5))])
    c = rng.integers(-300, 300, (6, 5))
    best, distance = clustering.nearest(v, c)
    whole = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (distance == whole.min(axis=1)).all() and (best == whole.argmin(axis=1)).all()
