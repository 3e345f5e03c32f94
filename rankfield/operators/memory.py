"""Correction memory: residuals filed by reviewers, and how they are read back."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.operators.ingest import append_once

MARGIN = 0.25
TAU = 0.75
SHRINK = 1.0


def target_score_for_rank(scores: Column, rank: Column) -> Column:
    """The score that lands at ``rank`` among descending ``scores``."""
    n = F.size(scores)
    at = lambda i: F.get(scores, i)
    return F.when(n == 0, MARGIN).when(rank <= 1, at(F.lit(0)) + MARGIN).when(rank > n, at(n - 1) - MARGIN).otherwise((at(rank - 2) + at(rank - 1)) / 2.0)


def write_residual(target: Column, predicted: Column, weight: Column) -> Column:
    """Residual that an exact re-query gives back in full after shrinkage."""
    return (target - predicted) * (weight + SHRINK) / weight


def _squared_gap(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def near_corrections(queries: DataFrame, residuals: DataFrame, least_weight: float = 1e-12) -> DataFrame:
    """(keyword, pkg, _id, _r, _w): the corrections that weigh at least ``least_weight`` for a row.

    A weight falls as exp(-(d / TAU)^2) times the reviewer's confidence, so those corrections lie
    within a radius that follows from the largest confidence. Distances to two pivots
    (the first correction, and the one farthest from it) place every vector in a cell of
    that width; by the triangle inequality the partners of a row are in its own and the
    eight cells around. Only they meet, by an equi-join on the cell.
    """
    spark = queries.sparkSession
    r = residuals.select(F.size("features").alias("_size"), F.col("features").alias("_x"), F.col("residual").alias("_r"), F.col("weight").alias("_cw"), F.col("id").alias("_id"))
    r = r.where("_size > 0 and _cw > 0")
    q = queries.select("keyword", "pkg", F.size("features").alias("_size"), F.col("features").alias("_q"))
    most = r.agg(F.max("_cw").alias("w")).first()["w"]
    if most is None:
        return spark.createDataFrame([], "keyword string, pkg string, _id long, _r double, _w double")
    radius = TAU * math.sqrt(max(math.log(most / least_weight), 0.0)) + 1e-6
    # one pivot pair for each length of vectors: as few rows as there have been shapes
    first = r.groupBy("_size").agg(F.min_by("_x", "_id").alias("_p"))
    far = r.join(F.broadcast(first), "_size").groupBy("_size").agg(F.first("_p").alias("_p"), F.max_by("_x", F.struct(_squared_gap("_x", "_p"), "_id")).alias("_f"))
    pivots = F.broadcast(spark.createDataFrame(far.collect(), far.schema))
    at = lambda v, p: F.floor(F.sqrt(_squared_gap(v, p)) / radius)
    around = lambda c: F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: c + i)
    held = r.join(pivots, "_size").select("_size", "_x", "_r", "_cw", "_id", at("_x", "_p").alias("_a"), at("_x", "_f").alias("_b"))
    asks = q.join(pivots, "_size").select("keyword", "pkg", "_size", "_q", F.explode(around(at("_q", "_p"))).alias("_a"), at("_q", "_f").alias("_b0"))
    asks = asks.select("keyword", "pkg", "_size", "_q", "_a", F.explode(around(F.col("_b0"))).alias("_b"))
    met = asks.join(held.hint("merge"), ["_size", "_a", "_b"])
    weighed = met.withColumn("_w", F.exp(-_squared_gap("_q", "_x") / (TAU * TAU)) * F.col("_cw"))
    return weighed.where(F.col("_w") >= least_weight).select("keyword", "pkg", "_id", "_r", "_w")


def read_residuals(queries: DataFrame, residuals: DataFrame, top_k: int = 16) -> DataFrame:
    """(keyword, pkg, residual): the last one filed for the row itself, else the kernel mean
    of the nearest. Weights that agree to nine digits are ties, which go by id.

    A row's own correction is an equi-join; the rest meets only the corrections near it
    (``near_corrections``). What is left out weighs under 1e-12 of the shrinkage each, so
    16 of them change no digit that a residual is read to.
    """
    own = residuals.groupBy("keyword", "pkg", F.size("features").alias("_size")).agg(F.max_by(F.col("residual") * F.col("weight") / (F.col("weight") + SHRINK), "id").alias("_own"), F.max("id").alias("_last"))
    asked = queries.select("keyword", "pkg", "features", F.size("features").alias("_size")).join(own.hint("merge"), ["keyword", "pkg", "_size"], "left")
    exact = asked.where("_own is not null").groupBy("keyword", "pkg").agg(F.max_by("_own", "_last").alias("residual"))
    rest = asked.where("_own is null").select("keyword", "pkg", "features")
    order = Window.partitionBy("keyword", "pkg").orderBy(F.desc(F.round("_w", 9)), "_id")
    near = near_corrections(rest, residuals).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_k)
    kernel = near.groupBy("keyword", "pkg").agg((F.sum(F.col("_w") * F.col("_r")) / (F.sum("_w") + SHRINK)).alias("residual"))
    found = exact.unionByName(kernel)
    return queries.select("keyword", "pkg").join(found.hint("merge"), ["keyword", "pkg"], "left").fillna({"residual": 0.0})


def drop_stale_shapes(residuals: DataFrame, n: int) -> DataFrame:
    return residuals.where(F.size("features") == n)


def retire_stale(residuals: DataFrame, n: int, at: str) -> DataFrame:
    stale = (F.size("features") != n) & F.col("retired_at").isNull()
    return residuals.withColumn("retired_at", F.when(stale, F.lit(at).cast("date")).otherwise(F.col("retired_at")))


def retire_learned(residuals: DataFrame, scores: DataFrame, at: str, slack: float = 0.5) -> DataFrame:
    """Retire corrections whose target the new scores reach, one-sided."""
    joined = residuals.join(scores.select("keyword", "pkg", F.col("score").alias("_new")), ["keyword", "pkg"], "left")
    learned = F.col("retired_at").isNull() & (F.col("_new") >= F.col("target") - slack)
    return joined.withColumn("retired_at", F.when(learned, F.lit(at).cast("date")).otherwise(F.col("retired_at"))).drop("_new")


def absorb_corrections(corrections: DataFrame, promoted: Column) -> DataFrame:
    return corrections.withColumn("status", F.when((F.col("status") == "queued") & promoted, "absorbed").otherwise(F.col("status")))


def rank_corrections(reviews: DataFrame, scored: DataFrame, weight: float = 5.0) -> DataFrame:
    """Reviewed (keyword, pkg, rank) with the score to aim at on the settled page and the
    residual to file; ``scored`` has (keyword, pkg, score) of that page."""
    asks = reviews.join(scored, ["keyword", "pkg"])
    rest = asks.select("keyword", "pkg", "rank", "score").join(scored.select("keyword", F.col("pkg").alias("_o"), F.col("score").alias("_s")), "keyword").where("_o <> pkg")
    lists = rest.groupBy("keyword", "pkg", "rank", "score").agg(F.sort_array(F.collect_list("_s"), asc=False).alias("_scores"))
    aimed = lists.withColumn("target", target_score_for_rank(F.col("_scores"), F.col("rank")))
    return aimed.select("keyword", "pkg", "rank", "score", "target", write_residual(F.col("target"), F.col("score"), F.lit(weight)).alias("residual"))


def apply_rank_corrections(reviews: DataFrame, observations: DataFrame, settle, score, as_of: str, weight: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(observations with the reviews, corrections filed): the whole path of a corrected rank.

    The reviewed rank is recorded first, as an observation of source ``review``; then the
    pages settle around it (``settle``: observations to slots) and are scored again
    (``score``: slots to keyword, pkg, score), and the residual aims at that page. A
    correction waits as ``queued``.
    """
    row = {"position": F.col("rank").cast("long"), "source": F.lit("review"), "featured": F.lit(0), "observed_at": F.lit(as_of).cast("date")}
    known = reviews.select("keyword", "pkg", *([] if "country" not in observations.columns else [F.lit("us").alias("country")]), "rank").withColumns(row)
    new = known.select(*[F.col(c) if c in known.columns else F.lit(None).alias(c) for c in observations.columns])
    seen = append_once(observations, new, [c for c in ("keyword", "country", "pkg", "observed_at") if c in observations.columns])
    filed = rank_corrections(reviews, score(settle(seen)), weight)
    return seen, filed.select("*", F.lit(weight).alias("weight"), F.lit("queued").alias("status"))
