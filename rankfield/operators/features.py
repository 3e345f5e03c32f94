"""Feature tables: the registry, one wide row per (app, keyword), page rows, points."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.functions import text as tx

# Feature names by direction, each in the registry's order: fixed values.
INCREASING = """kw_in_title kw_title_pos kw_density_title kw_in_short kw_desc_tf kw_cosine log_installs rating log_reviews
app_velocity field_weakest_rank intent_reach field_newcomers""".split()
DECREASING = """field_installs_p50 field_installs_p90 field_rating_p50 field_exact_match field_relevance_p50 field_relevant_count
field_installs_relevant field_weakest_installs intent_rivals intent_median intent_weakest field_has_featured field_featured_relevant
field_age_p50 newest_entrant_age field_velocity_p50 field_measured_velocity intent_velocity intent_measured_velocity band_rate below_rate
unaided_recent_rate curve_here newest_rate""".split()
FREE = """field_no_intent intent_share field_installs_p10 field_spread field_newcomer_installs field_newcomer_velocity field_newcomer_evidence
field_measured_evidence intent_recent_velocity intent_evidence intent_cut intent_cut_share intent_relevance_drop intent_recent_best_rank
intent_recent_rate_at_best intent_neighbour_rate intent_neighbour_age intent_recent_neighbour_rate intent_recent_neighbour_gap leader_match
leader_relevance leader_lead first_match_rank match_starts_below band_recent_rate band_evidence unaided_recent_evidence curve_rank_slope
curve_age_slope curve_fit curve_points advantage_p90 advantage_p50 leader_advantage leader_breadth breadth_gap newest_rank field_staleness_p50
field_age_spread field_age_known sugg_returned sugg_self_listed sugg_self_rank sugg_is_canonical sugg_extends sugg_extra_words sugg_unrelated
hist_known hist_age_days hist_installs_delta hist_size_delta hist_match_delta hist_hardening hist_dated hist_renewal hist_velocity_delta
kw_tokens days_since_release days_since_update""".split()
MONOTONE = INCREASING + DECREASING
FEATURES = MONOTONE + FREE
LEAKS = ("app_velocity", "log_installs", "log_reviews")
CLIP = 12.0


def feature_registry(spark: SparkSession) -> DataFrame:
    rows = [(n, d) for names, d in ((INCREASING, "inc"), (DECREASING, "dec"), (FREE, "free")) for n in names]
    return spark.createDataFrame(rows, "name string, direction string")


# Feature to the statistic it is the log of, or equal to.
LOGS = {
    "field_installs_p50": "installs_p50", "field_installs_p90": "installs_p90", "field_installs_p10": "installs_p10", "field_velocity_p50": "page_all", "field_installs_relevant": "installs_p50_relevant",
    "intent_median": "intent_median", "intent_weakest": "intent_weakest", "field_weakest_installs": "weakest_installs", "field_newcomer_installs": "newcomer_installs", "field_newcomer_velocity": "page_recent",
    "field_measured_velocity": "page_measured", "intent_velocity": "intent_all", "intent_recent_velocity": "intent_recent", "intent_measured_velocity": "intent_measured", "intent_recent_rate_at_best": "recent_rate_at_best",
    "intent_neighbour_rate": "neighbour_rate", "intent_recent_neighbour_rate": "recent_neighbour_rate", "band_rate": "band_all", "band_recent_rate": "band_recent", "below_rate": "below_all",
    "unaided_recent_rate": "unaided_recent_rate", "curve_here": "curve_here", "leader_breadth": "leader_breadth", "newest_rate": "newest_rate",
}
SAME = {
    "field_rating_p50": "rating_p50", "field_exact_match": "exact_match_count", "field_age_p50": "age_p50", "field_newcomers": "newcomers", "newest_entrant_age": "newest_entrant_age",
    "field_relevance_p50": "relevance_p50", "field_relevant_count": "relevant_count", "field_no_intent": "no_intent", "field_has_featured": "has_featured", "field_featured_relevant": "featured_relevance",
    "field_newcomer_evidence": "newcomers", "field_measured_evidence": "page_measured_n", "intent_evidence": "relevant_count", "intent_relevance_drop": "relevance_drop", "intent_recent_best_rank": "recent_best_rank",
    "intent_neighbour_age": "neighbour_age", "intent_recent_neighbour_gap": "recent_neighbour_gap", "field_staleness_p50": "staleness_p50", "field_age_spread": "age_spread", "field_age_known": "age_known_frac",
    **{n: n for n in ("intent_rivals", "intent_reach", "intent_share", "intent_cut", "intent_cut_share", "leader_match", "leader_relevance", "leader_lead", "first_match_rank", "match_starts_below", "band_evidence",
                      "unaided_recent_evidence", "curve_rank_slope", "curve_age_slope", "curve_fit", "curve_points", "advantage_p90", "advantage_p50", "leader_advantage", "breadth_gap", "newest_rank")},
}


def extract_features(slots: DataFrame, fields: DataFrame, groups: DataFrame, suggestions: DataFrame, history: DataFrame) -> DataFrame:
    """keyword, pkg, slot, age, source and the 96 features of every ranked app."""
    f = fields.withColumnRenamed("own_pkg", "pkg").drop("own_slot").join(groups.withColumnRenamed("own_pkg", "pkg"), ["keyword", "pkg"], "left")
    own = slots.select("keyword", "pkg", "slot", "age", "days", "stale_days", "source", "rate", F.col("installs").alias("_i"), F.col("rating").alias("_rating"), *([F.col("cosine")] if "cosine" in slots.columns else []), F.col("reviews").alias("_r"), F.col("title").alias("_t"), F.col("short_desc").alias("_s"), F.col("description").alias("_d"))
    rows = own.join(f, ["keyword", "pkg"]).join(suggestions, "keyword", "left").join(history, "keyword", "left")
    known = set(rows.columns)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in known else F.lit(0.0)
    title = tx.title_position_features(F.col("_t"), F.col("_s"), F.col("_d"), F.col("keyword"))
    made: dict[str, Column] = title | {
        "kw_cosine": value("cosine"), "log_installs": F.log1p("_i"), "rating": F.col("_rating"), "log_reviews": F.log1p("_r"),
        "app_velocity": F.log1p(F.col("_i") / F.greatest("age", F.lit(0.25))), "field_weakest_rank": 1.0 - F.col("weakest_rank") / 100.0,
        "field_spread": F.log1p(value("installs_p90")) - F.log1p(value("installs_p10")), "kw_tokens": F.size(tx.tokens(F.col("keyword"))).cast("double"),
        "days_since_release": F.col("age"), "days_since_update": F.col("stale_days") / 365.0,
    }
    made |= {k: F.log1p(value(v)) for k, v in LOGS.items()} | {k: value(v) for k, v in SAME.items()}
    made |= {n: F.coalesce(F.col(n), F.lit(1.0 if n == "sugg_self_rank" else 0.0)) for n in FEATURES if n.startswith(("sugg_", "hist_"))}
    return rows.select("keyword", "pkg", "slot", "age", "source", "rate", *[made[n].cast("double").alias(n) for n in FEATURES])


def sign_align(features: DataFrame) -> DataFrame:
    """Decreasing columns negated, so that every monotone column reads higher is better."""
    return features.withColumns({n: -F.col(n) for n in DECREASING if n in features.columns})


def fit_scaler(features: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, std): population spread; a constant column keeps its own unit."""
    x = lambda c: F.col(c).cast("double")
    one = features.agg(*[f(x(c)).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = [F.struct(F.lit(c).alias("name"), F.col(f"mean_{c}").alias("mean"), F.when(F.col(f"std_{c}") < 1e-3, 1.0).otherwise(F.col(f"std_{c}")).alias("std")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def apply_scaler(features: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in standard deviations, clipped; the scaler has a row a column."""
    packed = scaler.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("mean", "std")))).alias("_s"))
    z = lambda c: F.least(F.greatest((F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"], F.lit(-CLIP)), F.lit(CLIP))
    return features.crossJoin(F.broadcast(packed)).withColumns({c: z(c) for c in columns}).drop("_s")


def page_rows(pairs: DataFrame, most: int = 12, rank_known: bool = True) -> DataFrame:
    """21 columns for each of the first other apps of a page; the own rank may be withheld."""
    top = pairs.where(F.col("idx") <= most)
    lead = Window.partitionBy("keyword", "own_pkg").orderBy("idx")
    gap = F.when(F.lit(rank_known), (F.col("slot") - F.col("own_slot")) / 10.0).otherwise(0.0)
    # the first row of the page without the own app is its second where the own leads
    to_top = F.when(F.col("own_slot") == 1, F.col("sim_second")).otherwise(F.col("sim_first")) if "sim_first" in pairs.columns else F.lit(0.0)
    return top.select(
        "keyword", "own_pkg", "idx", (F.col("slot") / 10.0).alias("rank"), gap.alias("rank_gap"), F.lit(1.0 if rank_known else 0.0).alias("gap_known"), F.log1p("installs").alias("log_installs"), F.log1p("rate").alias("log_rate"),
        F.log1p("days").alias("age"), (F.col("days") > 0).cast("double").alias("age_known"), F.log1p(F.coalesce("measured_per_day", F.lit(0.0)) * 365.0).alias("log_measured"),
        F.col("measured_per_day").isNotNull().cast("double").alias("measured_known"), "rating", F.log1p("reviews").alias("log_reviews"), "relevance", F.col("on_intent").cast("double").alias("on_intent"),
        to_top.alias("sim_to_top"), ((F.col("slot") - F.first("slot").over(lead)) / 10.0).alias("top_rank_gap"), "advantage", "rate_vs_age", F.log1p("breadth").alias("breadth"),
        tx.title_contains_phrase(F.col("title"), F.col("keyword")).cast("double").alias("title_exact"), F.least(F.col("stale_days") / 365.0, F.lit(10.0)).alias("staleness"), F.col("featured").cast("double").alias("featured"),
    )


def download_points(pairs: DataFrame, most: int = 16) -> DataFrame:
    """Dated apps of a page, those nearest to the own slot first."""
    near = Window.partitionBy("keyword", "own_pkg").orderBy(F.abs(F.col("slot") - F.col("own_slot")), "slot")
    dated = pairs.where("released_at is not null").withColumn("place", F.row_number().over(near))
    return dated.where(F.col("place") <= most).select("keyword", "own_pkg", "own_slot", "place", F.col("released_at").alias("released"), F.col("slot").alias("rank"), "rate")


def signed_log(days: Column) -> Column:
    return F.signum(days) * F.log1p(F.abs(days))


def describe_points(points: DataFrame, own_released: Column, as_of: Column) -> DataFrame:
    """Seven columns of each point relative to the asking app."""
    newer = signed_log(F.datediff("released", own_released).cast("double"))
    by_rank = (F.col("rank") - F.col("own_slot")) / 10.0
    return points.select(
        "keyword", "own_pkg", "place", newer.alias("newer"), by_rank.alias("by_rank"), F.log1p(F.greatest("rate", F.lit(0.0))).alias("log_rate"), F.abs(newer).alias("apart"), F.abs(by_rank).alias("ranks_apart"),
        (F.col("rank") < F.col("own_slot")).cast("double").alias("above"), signed_log(F.datediff(as_of, "released").cast("double")).alias("age"),
    )


def training_set(features: DataFrame, top_n: int = 10) -> DataFrame:
    """Features with the rank label, the rate label of young apps, and their weights."""
    young = (F.col("age") > 0) & (F.col("age") <= 1.5)
    fade = F.pow(F.lit(0.5), F.col("age"))
    weight = F.when(F.col("age") > 0, 1.0 + 3.0 * fade).otherwise(1.0)
    weight = F.when(F.col("source") == "review", F.greatest(weight, F.lit(5.0))).when(F.col("source") == "owned", F.greatest(weight, F.lit(3.0))).otherwise(weight)
    return features.withColumns({
        "label": (F.col("slot") <= top_n).cast("double"), "rate_label": F.when(young, F.log1p("rate")), "weight": weight,
        "rate_weight": F.when(F.col("age") > 0, F.greatest(fade, F.lit(0.05))).otherwise(1.0),
    })


def group_split(rows: DataFrame, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """``held_out`` by keyword, never by row: the first keywords in hashed order."""
    words = rows.select("keyword").distinct().withColumn("_h", F.md5(F.concat_ws("|", "keyword", F.lit(str(seed)))))
    n = words.count()
    take = max(1, int(n * fraction))
    chosen = words.orderBy("_h", "keyword").limit(take).select("keyword", F.lit(True).alias("_out"))
    return rows.join(chosen, "keyword", "left").withColumn("held_out", F.coalesce("_out", F.lit(False))).drop("_out")


def fixed_holdout(rows: DataFrame, stored: DataFrame, fraction: float = 0.25) -> DataFrame:
    """The stored holdout if there is one; keywords that came later always train."""
    if stored.isEmpty():
        return group_split(rows, fraction)
    kept = stored.select("keyword", F.lit(True).alias("_out")).distinct()
    return rows.join(kept, "keyword", "left").withColumn("held_out", F.coalesce("_out", F.lit(False))).drop("_out")


def preference_pairs(rows: DataFrame, per_keyword: int = 60, seed: int = 0) -> DataFrame:
    """(keyword, better, worse) of distinct slots, at most min(per_keyword, 3n) a page."""
    a = rows.select("keyword", F.col("pkg").alias("better"), F.col("slot").alias("_a"))
    b = rows.select("keyword", F.col("pkg").alias("worse"), F.col("slot").alias("_b"))
    sizes = rows.groupBy("keyword").agg(F.least(F.lit(per_keyword), 3 * F.count("*")).alias("_most"))
    order = Window.partitionBy("keyword").orderBy(F.md5(F.concat_ws("|", "better", "worse", F.lit(str(seed)))), "better", "worse")
    pairs = a.join(b, "keyword").where("_a < _b").withColumn("_n", F.row_number().over(order)).join(sizes, "keyword")
    return pairs.where("_n <= _most").select("keyword", "better", "worse")


POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def bootstrap_resamples(rows: DataFrame, k: int = 7, key: tuple[str, ...] = ("keyword", "pkg")) -> DataFrame:
    """``k`` resamples with replacement, numbered ``member``, in one pass.

    A row comes as often as a Poisson draw of mean 1 says, read from a hash of its key
    and the member: the same rows on every layout of the table.
    """
    name = F.concat_ws("|", *key, F.col("member").cast("string"))
    draw = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    each = rows.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    times = sum(((draw >= p).cast("int") for p in POISSON), F.lit(0))
    return each.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def drop_leaks(features: DataFrame) -> DataFrame:
    """Without the columns that hold the rate label's answer."""
    return features.drop(*LEAKS)
