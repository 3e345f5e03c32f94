"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, floor(scale * x); a term is a component
with a weight other than zero. Candidate rows are dealt into shards; in a shard every
term has a posting list of (row, weight). The query rows are taken in blocks: term by
term, their weights times the term's postings are scattered into a dense array of
scores (queries x rows of the shard). A partition selection keeps each query's k best
of a shard, and these are merged over the shards. Every query meets every candidate.

Postings that cover most of the shard are kept as a dense row, so that adding them is
one pass over memory; the others are scattered to their rows.

Defined results: null vectors, and those that hold null or non-finite components, take
no part, nor do null ids. Of rows that share an id the vector that is first in array
order stands for the id. Vectors may differ in length: a missing component is zero.
Ties go to the smaller id. A query with fewer than k candidates returns all of them.
A scaled component beyond 2^52 either way counts as 2^52, a score beyond a long as the
largest or smallest long.
An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 2_048
CHUNK = 1_024
DENSE = 0.25
MOST = float(1 << 52)


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, term, weight) triples of the non-zero weights, and the number of terms."""
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    weights = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weights)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    used = weights != 0
    return row[used], term[used], weights[used], int(lengths.max(initial=0))


def _by_term(rows: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term to the (rows, weights) that hold it, rows ascending."""
    row, term, weight, _ = rows
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    return {int(t): (row[order[a:b]], weight[order[a:b]]) for t, a, b in zip(terms, starts, ends, strict=True)}


def accumulate(queries: pa.ChunkedArray, rows: pa.ChunkedArray) -> np.ndarray:
    """Scores (queries x rows): inner products of the sparse rows, exact integers."""
    q, d = _rows(queries), _rows(rows)
    bound = float(np.abs(q[2].astype(float)).max(initial=0)) * float(np.abs(d[2].astype(float)).max(initial=0)) * min(q[3], d[3])
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    n, by_query, postings = len(rows), _by_term(q), _by_term(d)
    scores = np.zeros((len(queries), n), kind)
    for term, (who, weight) in by_query.items():
        if term not in postings:
            continue
        at, value = postings[term]
        value, weight = value.astype(kind), weight.astype(kind)
        if len(at) >= DENSE * n:
            dense = np.zeros(n, kind)
            dense[at] = value
            for i, w in zip(who, weight, strict=True):
                scores[i] += w * dense
        else:
            for i, w in zip(who, weight, strict=True):
                scores[i, at] += w * value
    return scores


def best_k(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best; ``ids`` ascend, so do ties."""
    n = len(ids)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, own in enumerate(query_ids):
        allowed = np.flatnonzero(ids != own)
        row = scores[i, allowed]
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            above, equal = np.flatnonzero(row > floor), np.flatnonzero(row == floor)
            pick = np.concatenate([above, equal[: k - len(above)]])
        else:
            pick = np.arange(len(row))
        out.append((np.full(len(pick), own), ids[allowed[pick]], row[pick]))
    if not out or not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(_id, _v): floor(scale * x) of every usable vector, one for each id."""
    x = vectors[vector].cast("array<double>")
    usable = x.isNotNull() & vectors[key].isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    used = vectors.where(usable).select(vectors[key].cast("long").alias("_id"), x.alias("_x"))
    return used.groupBy("_id").agg(F.min("_x").alias("_x")).select("_id", F.transform("_x", lambda v: F.floor(F.least(F.greatest(F.lit(float(scale)) * v, F.lit(-MOST)), F.lit(MOST)))).alias("_v"))


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64, every: int = 20, shard_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates.

    Queries are the ids divisible by ``every``. The candidates of one task are at most
    about ``shard_rows``; queries come in blocks of ``QUERY_ROWS``.
    """
    ready = integer_vectors(vectors, key, vector, scale)
    asks = ready.where(F.col("_id") % every == 0)
    counted = ready.agg(F.count("*").alias("n"), F.count_if(F.col("_id") % every == 0).alias("q")).first()
    shards = max(-(-counted.n // shard_rows), min(48, -(-counted.n // 512)), 1)
    blocks = max(1, -(-counted.q // QUERY_ROWS))
    spread = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asks.select("_id", "_v", spread(blocks).alias("_block")).withColumn("_shard", each(shards))
    right = ready.select("_id", "_v", spread(shards).alias("_shard")).withColumn("_block", each(blocks))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        rows = rows.sort_by("_id")
        ids, own = rows["_id"].to_numpy(), queries["_id"].to_numpy()
        parts = []
        for q in range(0, len(own), CHUNK):
            for d in range(0, len(ids), 4 * CHUNK):
                scores = accumulate(queries["_v"].slice(q, CHUNK), rows["_v"].slice(d, 4 * CHUNK))
                parts.append(best_k(scores, own[q : q + CHUNK], ids[d : d + 4 * CHUNK], k))
        found = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": found[0].astype(np.int64), "vec_id": found[1].astype(np.int64), "score": np.clip(found[2], -(1 << 63), (1 << 63) - 1).astype(np.int64)})

    near = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
