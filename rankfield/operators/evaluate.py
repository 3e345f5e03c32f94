"""Evaluation on (label, prediction) rows, and the run registry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.sources.storage import kept


def auc(rows: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Area under the curve from mid-ranks; 0.5 if a class is missing.

    Scores are probabilities. Ranks come from counts of distinct scores, summed inside
    4,096 score ranges and moved on by the totals of the ranges below, so no task sees
    all of them.
    """
    by = rows.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")).withColumn("_g", F.floor(F.col("_s") * 4096))
    groups = by.groupBy("_g").agg(F.sum("n").alias("_n")).select("_g", F.expr("sum(_n) OVER (ORDER BY _g ROWS UNBOUNDED PRECEDING) - _n").alias("_before"))
    inside = by.withColumn("_in", F.expr("sum(n) OVER (PARTITION BY _g ORDER BY _s ROWS UNBOUNDED PRECEDING) - n"))
    ranged = inside.join(groups.hint("merge"), "_g").withColumn("_below", F.col("_before") + F.col("_in"))
    total = ranged.agg(F.sum(F.col("pos") * (F.col("_below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") == 0) | (F.col("p") == F.col("n")), 0.5).otherwise(F.expr("(r - p * (p + 1) / 2) / (p * (n - p))")).alias("auc"))


def calibration_error(rows: DataFrame, label: str = "y", score: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed.

    Bins compare with literal edges: p * bins would misplace edges such as 0.3.
    """
    place = F.lit(bins - 1)
    for i in range(bins - 1, 0, -1):
        place = F.when(F.col(score) < i / bins, i - 1).otherwise(place)
    stats = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("y"), F.avg(score).alias("p"))
    return stats.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def exact_percentiles(rows: DataFrame, column: Column, at: list[float]) -> DataFrame:
    """One row: ``values``, the interpolated percentiles of the non-null values (null if none).

    No task sees all of them: equal values are counted first, 256 approximate
    percentiles cut the line, counts run inside the pieces and are moved on by the
    pieces below, and only the values at the wanted ranks are kept.
    """
    x = rows.select(column.cast("double").alias("_x")).where("_x is not null")
    counted = kept(x.groupBy("_x").agg(F.count("*").alias("_n")), "counted-values")
    cuts = counted.agg(F.percentile_approx("_x", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 10_000).alias("_cuts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    # (percentile, its share of the value at the lower or the upper of its two ranks)
    ends = [F.struct(F.lit(i).alias("i"), r.cast("long").alias("r"), w.alias("w")) for i, q in enumerate(at) for r, w in ((F.floor(place(q)), F.ceil(place(q)) - place(q)), (F.ceil(place(q)), place(q) - F.floor(place(q))))]
    cuts = cuts.select("_cuts", F.array(*ends).alias("_ends"))
    by = counted.crossJoin(F.broadcast(cuts)).withColumn("_g", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    below = by.groupBy("_g").agg(F.sum("_n").alias("_m")).select("_g", F.expr("sum(_m) OVER (ORDER BY _g ROWS UNBOUNDED PRECEDING) - _m").alias("_before"))
    ranked = by.withColumn("_in", F.expr("sum(_n) OVER (PARTITION BY _g ORDER BY _x ROWS UNBOUNDED PRECEDING) - _n")).join(below.hint("merge"), "_g").withColumn("_low", F.col("_before") + F.col("_in"))
    hit = ranked.select("_x", F.explode(F.filter("_ends", lambda e: (e["r"] >= F.col("_low")) & (e["r"] < F.col("_low") + F.col("_n")))).alias("_e"))
    mean = F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.sum(F.col("_x") * F.col("_e.w")))
    found = hit.groupBy("_e.i").agg(mean.alias("v"))
    return found.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_v")).select(F.when(F.size("_v") > 0, F.transform("_v", lambda e: e["v"])).alias("values"))


def grouped_percentiles(rows: DataFrame, key: str, column: Column, at: list[float], broadcast_groups: int = 4_096) -> DataFrame:
    """(key, n, values): count and interpolated percentiles of the non-null values of each group.

    For few groups of any size: no task sees a whole group. Equal values are counted
    first; each group's own approximate percentiles cut its line into 256 pieces, counts
    run inside a piece and are moved on by the pieces below. Null keys have no group.
    """
    x = rows.select(F.col(key).alias("_k"), column.cast("double").alias("_x")).where("_x is not null and _k is not null")
    by = kept(x.groupBy("_k", "_x").agg(F.count("*").alias("_n")), "counted-values")
    cuts = by.groupBy("_k").agg(F.percentile_approx("_x", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 2_000).alias("_cuts"), F.sum("_n").alias("_all"))
    cuts = kept(cuts, "value-cuts")
    # 2 KB a group: broadcast while the groups are counted to be few, else met by key
    strategy = "broadcast" if cuts.count() <= broadcast_groups else "merge"
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    ends = [F.struct(F.lit(i).alias("i"), r.cast("long").alias("r"), w.alias("w")) for i, q in enumerate(at) for r, w in ((F.floor(place(q)), F.ceil(place(q)) - place(q)), (F.ceil(place(q)), place(q) - F.floor(place(q))))]
    cut = by.join(cuts.hint(strategy), "_k").withColumn("_g", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    below = cut.groupBy("_k", "_g").agg(F.sum("_n").alias("_m")).select("_k", "_g", F.expr("sum(_m) OVER (PARTITION BY _k ORDER BY _g ROWS UNBOUNDED PRECEDING) - _m").alias("_before"))
    inside = cut.withColumn("_in", F.expr("sum(_n) OVER (PARTITION BY _k, _g ORDER BY _x ROWS UNBOUNDED PRECEDING) - _n"))
    ranked = inside.join(below.hint("merge"), ["_k", "_g"]).withColumn("_low", F.col("_before") + F.col("_in")).withColumn("_ends", F.array(*ends))
    hit = ranked.select("_k", "_all", "_x", F.explode(F.filter("_ends", lambda e: (e["r"] >= F.col("_low")) & (e["r"] < F.col("_low") + F.col("_n")))).alias("_e"))
    mean = F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.sum(F.col("_x") * F.col("_e.w")))
    found = hit.groupBy("_k", "_all", "_e.i").agg(mean.alias("v")).groupBy("_k", "_all").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_v"))
    return found.select(F.col("_k").alias(key), F.col("_all").alias("n"), F.transform("_v", lambda e: e["v"]).alias("values"))


def error_factor(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """How many times off: median, p90, and mean absolute log error of log counts."""
    floor = lambda c: F.greatest(F.expm1(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(30.0))), F.lit(1.0))
    ratio = floor(predicted) / floor(actual)
    factor = F.greatest(ratio, 1 / ratio)
    means = rows.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae_log"))
    return means.crossJoin(exact_percentiles(rows, factor, [0.5, 0.9])).select("n", "mae_log", F.get("values", 0).alias("factor_p50"), F.get("values", 1).alias("factor_p90"))


def promotion_gate(run: DataFrame, registry: DataFrame, least_keywords: int = 25, least_auc: float = 0.55) -> DataFrame:
    """Blocked if it can be measured and falls behind the active run, or has no signal."""
    active = registry.where("active").agg(F.max("auc").alias("_prev"))
    gated = (F.col("n_keywords") >= least_keywords) & (F.coalesce(F.col("auc") < F.col("_prev") - 0.01, F.lit(False)) | (F.col("auc") < least_auc))
    return run.crossJoin(active).withColumn("promoted", ~gated).drop("_prev")


def register_run(registry: DataFrame, run: DataFrame) -> DataFrame:
    """Add a run as the next version; if promoted it becomes the one active."""
    top = registry.agg(F.coalesce(F.max(F.expr("try_cast(substr(version, 2) AS int)")), F.lit(0)).alias("_top"))
    new = run.crossJoin(top).select(F.concat(F.lit("v"), (F.col("_top") + 1).cast("string")).alias("version"), "auc", "n_keywords", F.col("promoted").alias("active"))
    won = new.agg(F.coalesce(F.bool_or("active"), F.lit(False)).alias("_won"))
    old = registry.crossJoin(won).select("version", "auc", "n_keywords", (F.col("active") & ~F.col("_won")).alias("active"))
    return old.unionByName(new)


def head_to_head(rows: DataFrame, least: int = 30) -> DataFrame:
    """Which of the estimates ``a`` and ``b`` of ``actual`` has the lower median factor."""
    both = rows.where("a is not null and b is not null and actual is not null")
    factor = lambda c: exact_percentiles(both, F.exp(F.abs(F.col(c) - F.col("actual"))), [0.5]).select(F.get("values", 0).alias(f"factor_{c}"))
    stats = both.agg(F.count("*").alias("n")).crossJoin(factor("a")).crossJoin(factor("b"))
    return stats.withColumn("better", F.when(F.col("n") < least, F.lit(None).cast("string")).when(F.col("factor_a") <= F.col("factor_b"), "a").otherwise("b"))


def run_history(registry: DataFrame, most: int = 20) -> DataFrame:
    return registry.orderBy(F.expr("try_cast(substr(version, 2) AS int)").desc()).limit(most)
