"""Centroid clustering of integer vectors by scalar lookup tables.

A vector is a row of integers, floor(scale * x). In every round each task tabulates,
for each dimension, the squared difference between every integer value that occurs
there and every centroid; a vector's distances are then gathers from these tables and
their sums, exact in 64-bit integers. A task returns sums and counts of its clusters
only: the shuffle has centroids x dimensions rows a task, the driver one centroid table.
A new centroid is the exact floor(sum / count) of each dimension; an empty one stays.

Integers of 2^27 and more either way take the same path with Python's integers, so that
every finite component is exact; sums travel in limbs of 30 bits where they need to.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component take no part. Rows are kept as often as they occur, those with a null id too
(its place in the first order is that of an empty id). Of rows that share an id the
first in array order come first. Fewer vectors than centroids: one centroid for each.
Ties go to the smaller centroid. A distance or an inertia beyond a long is null. An empty
table gives an empty result.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import stored

LIMB = 30
SMALL = 1 << 27
LONG = 1 << 63


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where squared distances fit them, else as Python's."""
    if not x.size or np.abs(x).max() < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**60 else int(v) * scale for v in x.ravel()]
    return np.array([*exact, None], object)[:-1].reshape(x.shape)


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and each value's place among them."""
    if values.dtype != object and (low := values.min()) + 65_536 > (high := values.max()):
        there = np.zeros(high - low + 1, bool)
        there[values - low] = True
        return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[values - low]
    return np.unique(values, return_inverse=True)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector."""
    kind = np.int64 if vectors.dtype != object and centroids.dtype != object else object
    total = np.zeros((len(vectors), len(centroids)), kind)
    for d in range(vectors.shape[1]):
        values, at = occurring(vectors[:, d])
        table = (values.astype(kind)[:, None] - centroids[:, d].astype(kind)) ** 2
        total += table[at]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def limbs(total: int) -> list[tuple[int, int]]:
    """(limb, value) with total = sum of value * 2^(30 * limb), each value in a long."""
    out = []
    while not -(1 << 62) <= total < 1 << 62:
        out.append((len(out), total & ((1 << LIMB) - 1)))
        total >>= LIMB
    return [*out, (len(out), total)]


def matrix(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)


def table_of(centroids: list[list[int]]) -> np.ndarray:
    """Centroids as an array, of Python's integers only if one is large."""
    large = any(abs(x) >= SMALL for c in centroids for x in c)
    return np.array(centroids, object if large else np.int64)


def _sums(kept: DataFrame, centroids: np.ndarray, dimensions: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """(count, sums) of every cluster that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), dimensions), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(0), dimensions, scale)
            cluster, _ = nearest(vectors, centroids)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(vectors[order], starts, axis=0).astype(object)
            counts += np.bincount(cluster, minlength=len(centroids))
        rows = [(c, d, limb, value) for c in np.flatnonzero(counts) for d, x in enumerate([*sums[c], counts[c]]) for limb, value in limbs(int(x))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(4)], names=["c", "d", "limb", "part"])

    # at most centroids x (dimensions + 1) x 36 rows reach the driver, whatever the input
    parts = kept.select("_v").mapInArrow(run, "c long, d long, limb long, part long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "d", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        out.setdefault(r.c, [0] * (dimensions + 1))[r.d] += int(r.part) << LIMB * r.limb
    return {c: (x[-1], x[:-1]) for c, x in out.items()}


def kept_vectors(vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(_id, _v) of the rows that take part, written once and read by every round."""
    whole = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[key].cast("long").alias("_id"), vectors[vector].cast("array<double>").alias("_v"))
    return stored(rows.where((F.size("_v") == dimensions) & whole), "kept-vectors")


def fit(kept: DataFrame, centroids: int, rounds: int, dimensions: int, scale: int, salt: str) -> list[list[int]]:
    """The centroids after ``rounds`` rounds."""
    place = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(place, "_v").limit(centroids).collect()  # a bound set by the parameter
    now = [[int(x) for x in scaled(np.array(r._v), scale)] for r in first]
    for _ in range(rounds if now else 0):
        for c, (count, sums) in _sums(kept, table_of(now), dimensions, scale).items():
            now[c] = [s // count for s in sums]
    return now


def cluster_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2:"
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid (array of decimal strings) of every vector that takes part."""
    spark, kept = vectors.sparkSession, kept_vectors(vectors, key, vector, dimensions)
    found = fit(kept, centroids, rounds, dimensions, scale, salt)
    if not found:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>")
    table = table_of(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(matrix(batch.column(1), dimensions, scale), table)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array([int(d) if d < LONG else None for d in distance], pa.int64())], names=["_id", "cluster", "distance"])

    assigned = stored(kept.mapInArrow(run, "_id long, cluster int, distance long"), "assigned-vectors")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count("*").alias("rows")).collect()
    inertia = {r.cluster: int(r.s) if r.n == r.rows else LONG for r in sums}  # a row for each centroid at most
    inside = lambda x: x if x < LONG else None
    info = [(c, inside(x), inside(sum(inertia.values())), [str(v) for v in found[c]]) for c, x in inertia.items()]
    told = spark.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return assigned.withColumnRenamed("_id", key).join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """The hash that names a centroid."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
