"""Connected components of an edge table: contraction inside tasks, then alternating stars.

Every round first gives each task a bounded number of edges (``task_edges``), which it
contracts on its own: a node points to the smallest node that the task's edges reach.
While all edges fit one task that is the whole answer. Beyond, the contracted edges of
all tasks go through a large and a small star, in which a hub's edges are dealt over
several tasks, until nothing changes. The number of tasks grows with the edges.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import cut, first_row, join_split

TASK_EDGES = 1_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of every node but the roots; a root is the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)  # hook the larger root below the smaller
        while (root != (up := root[root])).any():
            root = up
    held = root != np.arange(len(nodes))
    return nodes[root[held]], nodes[held]


def _inside_tasks(edges: DataFrame, tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting = []
        for batch in batches:
            waiting.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            if sum(len(x) for x, _ in waiting) > TASK_EDGES:  # tasks may be uneven: keep what is held small
                a, b = contracted(np.concatenate([a, *(x for x, _ in waiting)]), np.concatenate([b, *(y for _, y in waiting)]))
                waiting = []
        a, b = contracted(np.concatenate([a, *(x for x, _ in waiting)]), np.concatenate([b, *(y for _, y in waiting)]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def _nearest(pairs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each pair (u, v) with the smallest of u and all its v, as m; and (u, m) once.

    The minima of hubs are pre-aggregated, and the pairs of a hub are dealt over several
    tasks. There are at most ``rows`` pairs.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    return join_split(pairs, low, ["u"], "_n", ["v"], rows), low.select("u", "m")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    near, _ = _nearest(both, 2 * rows)
    return near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near, low = _nearest(down, rows)
    return near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low).where("a <> b")


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node of the ``a``, ``b`` edges: the smallest node reachable.

    A node without an edge to another is left out. Every round is checkpointed.
    """
    now = cut(edges.where("a <> b").select("a", "b").distinct())
    state = None
    while True:
        seen = first_row(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))))
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state, tasks = seen, max(1, -(-seen[0] // task_edges))
        stars = _inside_tasks(now, tasks)
        if tasks == 1:
            return cut(stars.select(F.col("b").alias("node"), F.col("a").alias("component")))
        # a large star has one row for each edge at most
        now = cut(_small_star(_large_star(stars.distinct(), seen[0]).distinct(), seen[0]).distinct())
