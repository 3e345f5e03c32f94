"""Queries over intent groups, features, models, corrections, evaluation and streams."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankfield.operators import evaluate, field, intent, memory, models, scoring, suggest
from rankfield.operators import change as ch
from rankfield.operators import features as fx
from rankfield.plans.pages import app_vectors, apps, cards, context, keyword_vectors, observations, ready, rounded, slots, states
from rankfield.plans.registry import query
from rankfield.sources import tables
from rankfield.sources.storage import held, kept, once, scratch
from rankfield.sources.views import AS_OF, view
from rankfield.streaming import jobs

# Group cutoff of the test vectors, which are spread wider than a sentence encoder's.
CUTOFF = 0.15


def members(spark, sf_dir):
    """Whole pages with unit vectors."""
    rows = context(spark, sf_dir).join(app_vectors(spark, sf_dir), "pkg")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double") / norm))


def groups(spark, sf_dir):
    """(keyword, pkg, group) of whole pages, kept."""
    return once(spark, sf_dir, "page-groups", lambda: intent.cluster_pages(members(spark, sf_dir), CUTOFF))


def grouped(spark, sf_dir):
    return context(spark, sf_dir).join(groups(spark, sf_dir).hint("merge"), ["keyword", "pkg"])


def thirds(spark, sf_dir):
    """Pages split by slot, in place of a split by meaning: groups that SQL knows too."""
    return context(spark, sf_dir).withColumn("group", (F.col("slot") % 3).cast("int"))


def scored(spark, sf_dir):
    return slots(spark, sf_dir).withColumn("score", F.round(F.log1p("installs") + F.col("rating"), 6)).select("keyword", "pkg", "slot", "title", "score", "released_at")


UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


@query("""WITH n AS MATERIALIZED (SELECT pkg, v, sqrt(list_dot_product(v, v)) AS n FROM t_app_vectors), u AS MATERIALIZED (SELECT s.keyword, s.pkg, s.slot, list_transform(v, lambda x: x / n) AS u FROM t_slots s JOIN n ON n.pkg = s.pkg)
SELECT x.keyword, x.pkg AS a, y.pkg AS b, round(list_dot_product(x.u, y.u), 4) AS similarity FROM u x JOIN u y ON y.keyword = x.keyword AND x.slot < y.slot""")
def i1_page_similarity(spark, sf_dir):
    return rounded(intent.page_similarity(members(spark, sf_dir)), 4)


@query()
def i2_cluster_pages(spark, sf_dir):
    return grouped(spark, sf_dir).select("keyword", "pkg", "slot", "group")


@query()
def i3_describe_groups(spark, sf_dir):
    return intent.describe_groups(grouped(spark, sf_dir))


@query()
def i4_label_groups(spark, sf_dir):
    return intent.label_groups(grouped(spark, sf_dir))


@query()
def i5_group_affinity(spark, sf_dir):
    rows = members(spark, sf_dir).join(groups(spark, sf_dir).hint("merge"), ["keyword", "pkg"])
    return rounded(intent.group_affinity(rows, keyword_vectors(spark, sf_dir)))


@query()
def i6_group_for(spark, sf_dir):
    return intent.group_for(observations(spark, sf_dir).select("keyword", "pkg").distinct(), groups(spark, sf_dir))


@query("SELECT o.keyword, o.pkg, coalesce(slot % 3, 0) AS \"group\" FROM (SELECT DISTINCT keyword, pkg FROM fx_observations) o LEFT JOIN t_slots s ON s.keyword = o.keyword AND s.pkg = o.pkg")
def i6_group_for_fixed_groups(spark, sf_dir):
    return intent.group_for(observations(spark, sf_dir).select("keyword", "pkg").distinct(), thirds(spark, sf_dir).select("keyword", "pkg", "group"))


@query()
def i7_ambiguous_pages(spark, sf_dir):
    return intent.ambiguous_pages(groups(spark, sf_dir))


@query("SELECT keyword, count(DISTINCT length(title) % 3) AS groups FROM t_slots GROUP BY keyword HAVING count(DISTINCT length(title) % 3) > 1")
def i7_ambiguous_fixed_groups(spark, sf_dir):
    return intent.ambiguous_pages(slots(spark, sf_dir).withColumn("group", F.length("title") % 3))


@query()
def f19_intent_stats(spark, sf_dir):
    return rounded(intent.intent_stats(context(spark, sf_dir), groups(spark, sf_dir)))


GROUPED = "(SELECT s.*, slot % 3 AS grp FROM t_context s)"


@query(f"""WITH g AS (SELECT keyword, grp, count(*) AS size, min(slot) AS best, CAST(floor(quantile_cont(CAST(installs AS DOUBLE), 0.5)) AS BIGINT) AS med, min(installs) AS weak FROM {GROUPED} GROUP BY keyword, grp), n AS (SELECT keyword, greatest(least(count(*) - 1, 10), 1) AS n FROM t_slots GROUP BY keyword)
SELECT s.keyword, s.pkg AS own_pkg, size - 1 AS intent_rivals, med AS intent_median, weak AS intent_weakest, round(1 - (best - 1) / CAST(n AS DOUBLE), 6) AS intent_reach, round(size / CAST(n AS DOUBLE), 6) AS intent_share FROM {GROUPED} s JOIN g ON g.keyword = s.keyword AND g.grp = s.grp JOIN n ON n.keyword = s.keyword""")
def f19_stats_of_fixed_groups(spark, sf_dir):
    rows = thirds(spark, sf_dir)
    return rounded(intent.intent_stats(rows.drop("group"), rows.select("keyword", "pkg", "group")))


@query(f"""SELECT keyword, grp AS "group", count(*) AS size, min(slot) AS best_rank, CAST(floor(quantile_cont(CAST(installs AS DOUBLE), 0.5)) AS BIGINT) AS median_installs, min(installs) AS weakest_installs, count(*) FILTER (days > 0 AND age <= 1) AS newcomers, list(pkg ORDER BY slot) AS packages FROM {GROUPED} GROUP BY keyword, grp""")
def i3_describe_fixed_groups(spark, sf_dir):
    """The description of groups that are given, not found."""
    return intent.describe_groups(thirds(spark, sf_dir)).select("keyword", "group", "size", "best_rank", "median_installs", "weakest_installs", "newcomers", "packages")


@query(f"""WITH w AS (SELECT keyword, grp, unnest(list_distinct(tt)) AS w FROM {GROUPED}), c AS (SELECT keyword, grp, w, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'app', 'apps', 'free', 'pro', 'your', 'with', 'best', 'new', 'phone', 'mobile') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY keyword, grp ORDER BY n DESC, w) AS r FROM c), z AS (SELECT keyword, grp, count(*) AS size FROM {GROUPED} GROUP BY ALL)
SELECT z.keyword, z.grp AS "group", coalesce(string_agg(r.w, ' / ' ORDER BY r.r) FILTER (r.n >= CASE WHEN size <= 2 THEN 1 ELSE greatest(2, floor(size / 2)) END), 'mixed') AS label FROM z LEFT JOIN r ON r.keyword = z.keyword AND r.grp = z.grp AND r.r <= 3 GROUP BY z.keyword, z.grp""")
def i4_label_fixed_groups(spark, sf_dir):
    return intent.label_groups(thirds(spark, sf_dir))


@query(f"""SELECT s.keyword, s."group", round(list_dot_product(list(m ORDER BY i), list(k ORDER BY i)) / (sqrt(list_dot_product(list(m ORDER BY i), list(m ORDER BY i))) + 1e-9), 4) AS affinity
FROM (SELECT keyword, "group", i, avg(x) AS m FROM (SELECT s.keyword, s.slot % 3 AS "group", unnest({UNIT}) AS x, generate_subscripts(v, 1) AS i FROM t_slots s JOIN t_app_vectors a ON a.pkg = s.pkg) GROUP BY ALL) s
JOIN (SELECT keyword, unnest(v) AS k, generate_subscripts(v, 1) AS i FROM t_keyword_vectors) USING (keyword, i) GROUP BY s.keyword, s."group" """)
def i5_affinity_of_fixed_groups(spark, sf_dir):
    return rounded(intent.group_affinity(members(spark, sf_dir).withColumn("group", F.col("slot") % 3), keyword_vectors(spark, sf_dir)), 4)


def features_of(spark, sf_dir, split):
    """The 96 features of every ranked app, its page split by ``split`` (keyword, pkg, group)."""
    rows = kept(field.prepared(context(spark, sf_dir), split), "split-rows")
    fields = kept(field.field_table(rows, cards(spark, sf_dir)), "fields")
    stats = intent.intent_stats(rows.drop("group"), split)
    signals = suggest.suggestion_signals(view(spark, sf_dir, "fx_suggestions"), rows.select("keyword"))
    return fx.extract_features(rows, fields, stats, signals, ch.field_deltas(states(spark, sf_dir), rows, AS_OF))


def features(spark, sf_dir):
    """Features of pages split by meaning, kept."""
    return once(spark, sf_dir, "features", lambda: features_of(spark, sf_dir, groups(spark, sf_dir)))


@query()
def x1_feature_registry(spark, sf_dir):
    """The catalogue with each feature's spread over the tables."""
    return fx.feature_registry(spark).join(fx.fit_scaler(features(spark, sf_dir), fx.FEATURES).hint("merge"), "name")


@query()
def x2_extract_features(spark, sf_dir):
    return rounded(features(spark, sf_dir))


X2_COLUMNS = ["kw_in_title", "kw_title_pos", "kw_density_title", "kw_in_short", "kw_desc_tf", "kw_cosine", "log_installs", "rating", "log_reviews", "app_velocity", "field_weakest_rank", "field_installs_p50", "field_spread", "field_relevance_p50", "field_relevant_count", "intent_rivals", "intent_median", "intent_reach", "intent_velocity", "intent_neighbour_rate", "band_rate", "leader_lead", "breadth_gap", "advantage_p50", "kw_tokens", "days_since_release", "days_since_update"]
_TOP, _MINE = "FILTER (idx <= 10)", "FILTER (idx <= 10 AND own_slot % 3 = slot % 3)"


@query(f"""WITH f AS (SELECT keyword, own_pkg AS pkg, arg_min(slot, installs * 1000 + slot) {_TOP} AS wr, quantile_cont(CAST(installs AS DOUBLE), 0.1) {_TOP} AS p10, quantile_cont(CAST(installs AS DOUBLE), 0.5) {_TOP} AS p50, quantile_cont(CAST(installs AS DOUBLE), 0.9) {_TOP} AS p90, quantile_cont(relevance, 0.5) {_TOP} AS rel, count(*) {_MINE} AS mine,
  coalesce(quantile_cont(floor_rate, 0.5) {_MINE}, 0) AS iv, coalesce(arg_min(rate, gap * 1000 + slot) {_MINE}, 0) AS nr, coalesce(quantile_cont(floor_rate, 0.5) FILTER (gap > 0 AND gap <= 2), 0) AS band,
  ln(1 + arg_min(installs, idx) {_TOP}) - ln(1 + coalesce(quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (idx <= 10 AND idx > 1), quantile_cont(CAST(installs AS DOUBLE), 0.5) {_TOP})) AS lead,
  ln(1 + arg_min(breadth, idx) {_TOP}) - ln(1 + coalesce(quantile_cont(CAST(breadth AS DOUBLE), 0.5) FILTER (idx <= 10 AND idx > 1), quantile_cont(CAST(breadth AS DOUBLE), 0.5) {_TOP})) AS bg, quantile_cont(advantage, 0.5) {_TOP} AS adv FROM t_loo GROUP BY keyword, own_pkg),
g AS (SELECT keyword, grp, count(*) AS size, min(slot) AS best, floor(quantile_cont(CAST(installs AS DOUBLE), 0.5)) AS med FROM {GROUPED} GROUP BY keyword, grp), n AS (SELECT keyword, greatest(least(count(*) - 1, 10), 1) AS n FROM t_slots GROUP BY keyword)
SELECT s.keyword, s.pkg, s.slot, CASE WHEN list_has_all(tt, kt) THEN 1.0 ELSE 0.0 END::DOUBLE AS kw_in_title, round(coalesce(1 - (list_min(list_filter(list_transform(kt, lambda t: coalesce(list_position(tt, t), 0)), lambda x: x > 0)) - 1) / CAST(len(tt) AS DOUBLE), 0), 5) AS kw_title_pos,
round(len(list_filter(tt, lambda t: list_contains(kt, t))) / CAST(len(tt) AS DOUBLE), 5) AS kw_density_title, CASE WHEN list_has_all(st, kt) THEN 1.0 ELSE 0.0 END::DOUBLE AS kw_in_short, round(len(list_filter(dt, lambda t: list_contains(kt, t))) / (len(list_filter(dt, lambda t: list_contains(kt, t))) + 1.5::DOUBLE), 5) AS kw_desc_tf,
round(cosine, 5) AS kw_cosine, round(ln(1 + installs), 5) AS log_installs, round(rating, 5) AS rating, round(ln(1 + reviews), 5) AS log_reviews, round(ln(1 + installs / greatest(age, 0.25)), 5) AS app_velocity, round(1 - wr / 100.0::DOUBLE, 5) AS field_weakest_rank, round(ln(1 + p50), 5) AS field_installs_p50, round(ln(1 + p90) - ln(1 + p10), 5) AS field_spread,
round(rel, 5) AS field_relevance_p50, CAST(mine AS DOUBLE) AS field_relevant_count, CAST(size - 1 AS DOUBLE) AS intent_rivals, round(ln(1 + med), 5) AS intent_median, round(1 - (best - 1) / CAST(n AS DOUBLE), 5) AS intent_reach, round(ln(1 + iv), 5) AS intent_velocity, round(ln(1 + nr), 5) AS intent_neighbour_rate, round(ln(1 + band), 5) AS band_rate,
round(lead, 5) AS leader_lead, round(bg, 5) AS breadth_gap, round(adv, 5) AS advantage_p50, CAST(len(kt) AS DOUBLE) AS kw_tokens, round(age, 5) AS days_since_release, round(stale_days / 365.0::DOUBLE, 5) AS days_since_update
FROM {GROUPED} s JOIN f ON f.keyword = s.keyword AND f.pkg = s.pkg JOIN g ON g.keyword = s.keyword AND g.grp = s.grp JOIN n ON n.keyword = s.keyword""")
def x2_features_of_fixed_groups(spark, sf_dir):
    """The feature table over groups that SQL knows too; a third of its columns are compared."""
    table = features_of(spark, sf_dir, thirds(spark, sf_dir).select("keyword", "pkg", "group"))
    return rounded(table.select("keyword", "pkg", "slot", *X2_COLUMNS), 5)


@query("SELECT keyword, pkg, -round(ln(1 + installs), 6) AS field_installs_p50, round(rating, 6) AS rating FROM t_slots")
def x3_sign_align(spark, sf_dir):
    return rounded(fx.sign_align(slots(spark, sf_dir).select("keyword", "pkg", F.log1p("installs").alias("field_installs_p50"), "rating")))


BASIC = ["log_installs", "rating", "reviews"]


def basic(spark, sf_dir):
    return slots(spark, sf_dir).select("keyword", "pkg", "slot", F.log1p("installs").alias("log_installs"), "rating", F.col("reviews").cast("double").alias("reviews"))


@query(f"""WITH b AS (SELECT ln(1 + installs) AS log_installs, rating, CAST(reviews AS DOUBLE) AS reviews FROM t_slots) {' UNION ALL '.join(f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-3 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM b" for c in BASIC)}""")
def x4_fit_scaler(spark, sf_dir):
    return rounded(fx.fit_scaler(basic(spark, sf_dir), BASIC))


@query("SELECT keyword, pkg, slot, " + ", ".join(f"round(least(greatest(({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER (), -12), 12), 5) AS {c}" for c, e in zip(BASIC, ("ln(1 + installs)", "rating", "CAST(reviews AS DOUBLE)"), strict=True)) + " FROM t_slots")
def x5_apply_scaler(spark, sf_dir):
    rows = basic(spark, sf_dir)
    return rounded(fx.apply_scaler(rows, fx.fit_scaler(rows, BASIC), BASIC), 5)


@query("""SELECT keyword, own_pkg, idx, slot / 10.0::DOUBLE AS rank, (slot - own_slot) / 10.0::DOUBLE AS rank_gap, 1.0::DOUBLE AS gap_known, round(ln(1 + installs), 5) AS log_installs, round(ln(1 + rate), 5) AS log_rate, round(ln(1 + days), 5) AS age,
CASE WHEN days > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS age_known, round(ln(1 + coalesce(measured_per_day, 0) * 365.0::DOUBLE), 5) AS log_measured, CASE WHEN measured_per_day IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS measured_known, rating, round(ln(1 + reviews), 5) AS log_reviews,
round(relevance, 5) AS relevance, CAST(on_intent AS DOUBLE) AS on_intent, round(CASE WHEN own_slot = 1 THEN sim_second ELSE sim_first END, 5) AS sim_to_top, round((slot - first_value(slot) OVER (PARTITION BY keyword, own_pkg ORDER BY idx)) / 10.0::DOUBLE, 5) AS top_rank_gap, round(advantage, 5) AS advantage, round(rate_vs_age, 5) AS rate_vs_age, round(ln(1 + breadth), 5) AS breadth,
CAST(contains(lower(title), lower(trim(keyword))) AS DOUBLE) AS title_exact, round(least(stale_days / 365.0::DOUBLE, 10), 5) AS staleness, CAST(featured AS DOUBLE) AS featured FROM t_loo WHERE idx <= 12""")
def x6_page_rows(spark, sf_dir):
    return rounded(fx.page_rows(field.near_rows(ready(spark, sf_dir), 12)), 5)


def points(spark, sf_dir):
    rows = ready(spark, sf_dir)
    return fx.download_points(field.leave_one_out(rows, rows.where("released_at is not null").select("keyword", "pkg", "slot", "released_at", "rate")))


POINTS = "SELECT * FROM (SELECT keyword, own_pkg, own_slot, row_number() OVER (PARTITION BY keyword, own_pkg ORDER BY gap, slot) AS place, released_at AS released, slot AS rank, rate FROM t_loo WHERE released_at IS NOT NULL) WHERE place <= 16"


@query(f"SELECT keyword, own_pkg, place, released, rank, round(rate, 5) AS rate FROM ({POINTS})")
def x7_download_points(spark, sf_dir):
    return rounded(points(spark, sf_dir).drop("own_slot"), 5)


@query(f"""WITH d AS (SELECT *, date_diff('day', DATE '{AS_OF}', released) AS n, (rank - own_slot) / 10.0::DOUBLE AS br FROM ({POINTS}))
SELECT keyword, own_pkg, place, round(sign(n) * ln(1 + abs(n)), 5) AS newer, round(br, 5) AS by_rank, round(ln(1 + rate), 5) AS log_rate, round(ln(1 + abs(n)), 5) AS apart, round(abs(br), 5) AS ranks_apart, CASE WHEN rank < own_slot THEN 1.0 ELSE 0.0 END::DOUBLE AS above, round(sign(-n) * ln(1 + abs(n)), 5) AS age FROM d""")
def x8_describe_points(spark, sf_dir):
    day = F.lit(AS_OF).cast("date")
    return rounded(fx.describe_points(points(spark, sf_dir), day, day), 5)


@query("""SELECT keyword, pkg, CASE WHEN slot <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS label, round(CASE WHEN age > 0 AND age <= 1.5 THEN ln(1 + rate) END, 5) AS rate_label,
round(CASE WHEN source = 'review' THEN greatest(w, 5) WHEN source = 'owned' THEN greatest(w, 3) ELSE w END, 5) AS weight, round(CASE WHEN age > 0 THEN greatest(pow(0.5, age), 0.05) ELSE 1 END, 5) AS rate_weight FROM (SELECT *, CASE WHEN age > 0 THEN 1 + 3 * pow(0.5, age) ELSE 1 END AS w FROM t_context)""")
def x9_x12_training_labels(spark, sf_dir):
    rows = context(spark, sf_dir).select("keyword", "pkg", "slot", "age", "rate", "source")
    return rounded(fx.training_set(rows).select("keyword", "pkg", "label", "rate_label", "weight", "rate_weight"), 5)


@query("SELECT s.keyword, pkg, n <= greatest(1, floor(0.25 * m)) AS held_out FROM t_slots s JOIN (SELECT keyword, row_number() OVER (ORDER BY md5(keyword || '|0'), keyword) AS n, count(*) OVER () AS m FROM (SELECT DISTINCT keyword FROM t_slots)) k ON k.keyword = s.keyword")
def x10_group_split(spark, sf_dir):
    return fx.group_split(slots(spark, sf_dir).select("keyword", "pkg"))


@query("SELECT keyword, pkg, length(keyword) % 4 = 0 AS held_out FROM t_slots")
def x11_fixed_holdout(spark, sf_dir):
    rows = slots(spark, sf_dir).select("keyword", "pkg")
    return fx.fixed_holdout(rows, rows.where("length(keyword) % 4 = 0").select("keyword"))


@query("""WITH k AS (SELECT keyword, row_number() OVER (ORDER BY md5(keyword || '|0'), keyword) AS n, count(*) OVER () AS all_n FROM (SELECT DISTINCT keyword FROM t_slots WHERE keyword < 'n'))
SELECT s.keyword, s.pkg, coalesce(k.n <= greatest(1, floor(all_n * 0.25)), false) AS held_out FROM t_slots s LEFT JOIN k ON k.keyword = s.keyword""")
def x11_stored_holdout(spark, sf_dir):
    """Chosen among the keywords of a first run; those that a second run adds train."""
    rows = slots(spark, sf_dir).select("keyword", "pkg")
    path = scratch(spark, f"holdout-{uuid.uuid4().hex}")
    tables.stored_holdout(rows.where("keyword < 'n'"), path)
    return tables.stored_holdout(rows, path)


@query("SELECT keyword, better, worse FROM (SELECT a.keyword, a.pkg AS better, b.pkg AS worse, row_number() OVER (PARTITION BY a.keyword ORDER BY md5(a.pkg || '|' || b.pkg || '|0'), a.pkg, b.pkg) AS n FROM t_slots a JOIN t_slots b ON b.keyword = a.keyword AND a.slot < b.slot) p JOIN (SELECT keyword, least(60, 3 * count(*)) AS most FROM t_slots GROUP BY keyword) USING (keyword) WHERE n <= most")
def x13_preference_pairs(spark, sf_dir):
    return fx.preference_pairs(slots(spark, sf_dir).select("keyword", "pkg", "slot"))


@query(f"""WITH d AS (SELECT keyword, pkg, member, ('0x' || substr(md5(keyword || '|' || pkg || '|' || member), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t_slots, range(7) m(member))
SELECT keyword, pkg, CAST(member AS INT) AS member, CAST({' + '.join(f'CASE WHEN u >= {p} THEN 1 ELSE 0 END' for p in fx.POISSON)} AS BIGINT) AS n FROM d WHERE u >= {fx.POISSON[0]}""")
def x14_bootstrap_resamples(spark, sf_dir):
    return fx.bootstrap_resamples(slots(spark, sf_dir).select("keyword", "pkg"), 7).groupBy("keyword", "pkg", "member").agg(F.count("*").alias("n"))


@query("SELECT keyword, pkg, rating FROM t_slots")
def x15_drop_leaks(spark, sf_dir):
    return fx.drop_leaks(basic(spark, sf_dir).drop("slot", "reviews"))


def aligned(spark, sf_dir):
    """All features, aligned, in standard deviations, with the labels."""
    table = features(spark, sf_dir)
    scaled = fx.apply_scaler(table, fx.fit_scaler(table, fx.FEATURES), fx.FEATURES)
    # labels and weights read the unscaled age and rate
    own = table.select("keyword", "pkg", F.col("age").alias("_age"), F.col("rate").alias("_rate"))
    rows = scaled.drop("age", "rate").join(own, ["keyword", "pkg"]).withColumnsRenamed({"_age": "age", "_rate": "rate"})
    return once(spark, sf_dir, "aligned", lambda: fx.sign_align(fx.training_set(rows)))


@query()
def m1_monotone_ranker(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    return rounded(models.scores(models.fit_monotone_ranker(rows, fx.FEATURES), rows))


@query()
def m1_held_out_auc(spark, sf_dir):
    """Fitted on three quarters of the keywords, judged on the rest."""
    rows = fx.group_split(aligned(spark, sf_dir)).transform(kept, "split")
    found = models.scores(models.fit_monotone_ranker(rows.where("not held_out"), fx.FEATURES), rows.where("held_out"))
    judged = found.select((1 / (1 + F.exp(-F.col("logit")))).alias("p"), (F.col("slot") <= 10).cast("int").alias("y"))
    return rounded(evaluate.auc(judged).crossJoin(evaluate.calibration_error(judged)))


@query()
def m2_pairwise_ranker(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    return rounded(models.scores(models.fit_pairwise_ranker(rows, fx.preference_pairs(rows), fx.FEATURES), rows))


def rankers(spark, sf_dir):
    """The ensemble of seven on all features, fitted once a session."""
    return held(spark, sf_dir, "rankers", lambda: models.fit_members(aligned(spark, sf_dir), fx.FEATURES))


def member_logits(spark, sf_dir):
    """The logits of the ensemble, kept."""
    rows = aligned(spark, sf_dir)
    return once(spark, sf_dir, "member-logits", lambda: models.member_scores(rankers(spark, sf_dir), rows))


@query()
def m3_m5_ensemble(spark, sf_dir):
    """Mean logit, spread, agreement and confidence, and one member's draw, of each row."""
    return rounded(described_ensemble(member_logits(spark, sf_dir), 7))


def described_ensemble(each, k):
    n = each.agg(F.count_distinct("keyword").alias("_n"))
    mean = scoring.ensemble_scores(each).crossJoin(F.broadcast(n)).withColumn("agreement", scoring.agreement(F.col("spread"))).withColumn("confidence", scoring.confidence(F.col("spread"), F.col("_n"))).drop("_n")
    return mean.join(scoring.thompson_draw(each, k).select("keyword", "pkg", F.col("logit").alias("draw")).hint("merge"), ["keyword", "pkg"])


@query("""WITH e AS (SELECT keyword, pkg, m, rating - 3 + (m - 3) * (slot % 5) / 10.0::DOUBLE AS logit FROM t_slots, range(7) t(m)), a AS (SELECT keyword, pkg, avg(logit) AS logit, avg(1 / (1 + exp(-logit))) AS chance, stddev_samp(1 / (1 + exp(-logit))) AS spread FROM e GROUP BY ALL),
d AS (SELECT keyword, pkg, logit AS draw FROM e WHERE m = ('0x' || substr(md5(keyword || '|' || pkg || '|0'), 1, 8))::BIGINT % 7)
SELECT keyword, pkg, round(logit, 6) AS logit, round(chance, 6) AS chance, round(spread, 6) AS spread, round(1 - least(spread / 0.5, 1), 6) AS agreement, round((1 - least(spread / 0.5, 1)) * least((SELECT count(DISTINCT keyword) FROM e) / 25.0::DOUBLE, 1), 6) AS confidence, round(draw, 6) AS draw FROM a JOIN d USING (keyword, pkg)""")
def m3_m5_given_members(spark, sf_dir):
    """The ensemble's figures from members that are given, not fitted."""
    rows = slots(spark, sf_dir).withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(7)])))
    return rounded(described_ensemble(rows.select("keyword", "pkg", "member", (F.col("rating") - 3 + (F.col("member") - 3) * (F.col("slot") % 5) / 10.0).alias("logit")), 7))


@query("""WITH y AS (SELECT pkg, ln(1 + installs) AS m, least(rating / 2, 2) AS s FROM fx_apps)
SELECT pkg, round(exp(least(m, 17.7)) - 1, 3) AS per_year, round((exp(least(m, 17.7)) - 1) / 12, 3) AS per_month, round((exp(least(m, 17.7)) - 1) / 365, 3) AS per_day, round(exp(least(greatest(m - s, 0), 17.7)) - 1, 3) AS low_per_year, round(exp(least(m + s, 17.7)) - 1, 3) AS high_per_year FROM y""")
def m7_download_figures(spark, sf_dir):
    figures = scoring.download_figures(F.log1p("installs"), F.col("rating") / 2, 17.7)
    return rounded(apps(spark, sf_dir).select("pkg", *[c.alias(k) for k, c in figures.items()]), 3)


@query()
def m6_m7_page_relative_rates(spark, sf_dir):
    rows = ready(spark, sf_dir)
    day = F.lit(AS_OF).cast("date")
    kernel = models.kernel_features(fx.describe_points(points(spark, sf_dir), day, day))
    train = kernel.join(rows.select("keyword", F.col("pkg").alias("own_pkg"), F.log1p("rate").alias("log_rate"), "days"), ["keyword", "own_pkg"]).where("days > 0").drop("days").transform(kept, "kernel")
    found = models.predict_rates(models.fit_page_relative_rates(train), train)
    return rounded(found.select("keyword", "own_pkg", *[c.alias(k) for k, c in scoring.download_figures(F.col("log_rate_hat"), F.lit(0.5), 17.7).items()]), 3)


@query()
def m23_rate_head(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    model, _ = models.fit_rate_head(rows, fx.FEATURES)
    return rounded(model.transform(rows.withColumn("rank", (F.col("slot") - 1) / 10.0)).select("keyword", "pkg", "rate_hat"))


@query("""WITH e AS (SELECT keyword, 1 + length(keyword) % 12 AS r FROM t_slots GROUP BY keyword), p AS (SELECT s.keyword, bool_or(slot < r AND released_at IS NOT NULL) AS above, bool_or(exact) AS exact, count(*) AS n, count(released_at) AS dated FROM t_context s JOIN e ON e.keyword = s.keyword GROUP BY s.keyword)
SELECT keyword, list_filter([CASE WHEN dated > 0 AND NOT above THEN 'nothing ranks above this slot' END, CASE WHEN NOT exact THEN 'none of the ' || n || ' apps carry the phrase in their title' END], lambda x: x IS NOT NULL) AS caveats FROM p""")
def m8_download_caveats(spark, sf_dir):
    rows = scoring.exact_titles(slots(spark, sf_dir))
    return scoring.download_caveats(rows, rows.select("keyword", (1 + F.length("keyword") % 12).alias("entry_rank")).distinct())


S = "(SELECT keyword, pkg, slot, round(ln(1 + installs) + rating, 6) AS score FROM t_slots)"


@query(f"SELECT keyword, pkg, rank() OVER (PARTITION BY keyword ORDER BY score DESC) AS predicted_rank FROM {S}")
def m9_predicted_rank(spark, sf_dir):
    return scoring.predicted_ranks(scored(spark, sf_dir)).select("keyword", "pkg", "predicted_rank")


@query("SELECT keyword, '__hypothetical__' AS pkg, upper(substr(split_part(keyword, ' ', 1), 1, 1)) || substr(lower(split_part(keyword, ' ', 1)), 2) || ' ' || upper(substr(split_part(keyword, ' ', 2), 1, 1)) || substr(lower(split_part(keyword, ' ', 2)), 2) AS title, repeat(keyword || '. ', 8) AS description FROM (SELECT DISTINCT keyword FROM t_slots)")
def m10_hypothetical_entrants(spark, sf_dir):
    return scoring.hypothetical_entrants(slots(spark, sf_dir).select("keyword").distinct(), AS_OF).select("keyword", "pkg", "title", "description")


CARDS = "(SELECT keyword, count(DISTINCT pkg) AS c FROM fx_observations WHERE featured = 1 AND country = 'us' GROUP BY keyword)"


@query(f"SELECT s.keyword, count(*) FILTER (score > 10 + length(s.keyword) % 7) + 1 AS entry_rank, count(*) FILTER (score > 10 + length(s.keyword) % 7) + 1 + coalesce(max(c), 0) AS displayed_rank, count(*) + 1 + coalesce(max(c), 0) AS field_size FROM {S} s LEFT JOIN {CARDS} c ON c.keyword = s.keyword GROUP BY s.keyword")
def m11_entry_rank(spark, sf_dir):
    rows = scored(spark, sf_dir)
    entrants = rows.select("keyword", (10 + F.length("keyword") % 7).alias("score")).distinct()
    return scoring.entry_ranks(rows, entrants, cards(spark, sf_dir))


QUANTILES = f"(SELECT quantile_cont(score, [{', '.join(str(i / 100) for i in range(101))}]) AS qs FROM {S})"


@query(f"SELECT keyword, pkg, len(list_filter(qs, lambda q: q < score)) AS percentile FROM {S}, {QUANTILES}")
def m12_to_percentile(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.crossJoin(F.broadcast(scoring.score_quantiles(rows))).select("keyword", "pkg", scoring.to_percentile(F.col("quantiles"), F.col("score")).alias("percentile"))


@query(f"""WITH g AS (SELECT keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, pkg) AS r, count(*) OVER (PARTITION BY keyword) AS n FROM {S}) WHERE r = least(10, n))
SELECT keyword, CASE WHEN length(keyword) % 5 = 0 THEN 42.0 ELSE CAST(len(list_filter(qs, lambda q: q < score)) AS DOUBLE) END::DOUBLE AS crowding, length(keyword) % 5 = 0 AS overridden FROM g, {QUANTILES}""")
def m13_crowding(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return scoring.crowding(rows, rows.where("length(keyword) % 5 = 0").select("keyword", F.lit(42.0).alias("value")).distinct())


BANDS = "CASE WHEN slot <= 3 THEN 'strong' WHEN slot <= 10 THEN 'winnable' WHEN slot <= 30 THEN 'borderline' ELSE 'unlikely' END"
VERDICT = "CASE WHEN slot <= 3 THEN 'BUILD IT' WHEN slot <= 10 THEN 'WORTH A TRY' ELSE 'SKIP' END"


@query(f"SELECT keyword, pkg, {BANDS} AS band, {VERDICT} AS verdict, CASE WHEN rating * 20 >= 70 THEN 'more demand' WHEN rating * 20 >= 40 THEN 'moderate demand' WHEN rating >= 0 THEN 'less demand' END AS demand, CASE WHEN rating * 20 >= 80 THEN 'too crowded' WHEN rating * 20 >= 60 THEN 'crowded' WHEN rating * 20 >= 35 THEN 'moderately crowded' ELSE 'less crowded' END AS crowd FROM t_slots")
def m14_bands(spark, sf_dir):
    slot, score = F.col("slot"), F.col("rating") * 20
    return slots(spark, sf_dir).select("keyword", "pkg", scoring.rank_band(slot).alias("band"), scoring.rank_verdict(slot).alias("verdict"), scoring.demand_band(score).alias("demand"), scoring.crowding_band(score).alias("crowd"))


THRESHOLDS = {"min_chance": 40, "min_certainty": 0, "max_rank": 12, "min_downloads": 50_000}


@query(f"""WITH e AS (SELECT keyword, pkg, slot, CAST(round(rating / 5 * 100) AS INT) AS chance, CAST(round(reviews / 100.0::DOUBLE * 100) AS INT) AS certainty, CAST(installs AS DOUBLE) AS y FROM t_slots),
f AS (SELECT *, list_filter([CASE WHEN chance < 40 THEN 'chance' END, CASE WHEN slot > 12 THEN 'rank' END, CASE WHEN y < 50000 THEN 'downloads' END], lambda x: x IS NOT NULL) AS s FROM e)
SELECT keyword, slot AS rank, chance AS rank_chance, certainty, s AS shortfalls, len(s) = 0 AS meets_thresholds, {VERDICT} AS verdict FROM f""")
def m15_m16_recommend(spark, sf_dir):
    rows = slots(spark, sf_dir).select("keyword", F.col("slot").alias("entry_rank"), (F.col("rating") / 5).alias("chance"), (F.col("reviews") / 100.0).alias("confidence"), F.col("installs").cast("double").alias("per_year"))
    return scoring.recommend(rows, THRESHOLDS)


HUMAN = "CASE WHEN {0} >= 1e9 THEN regexp_replace(printf('%.1f', {0} / 1e9), '\\.0$', '') || 'B' WHEN {0} >= 1e6 THEN regexp_replace(printf('%.1f', {0} / 1e6), '\\.0$', '') || 'M' WHEN {0} >= 1e3 THEN regexp_replace(printf('%.1f', {0} / 1e3), '\\.0$', '') || 'K' ELSE CAST(CAST(floor({0}) AS BIGINT) AS VARCHAR) END"


@query("SELECT pkg, " + HUMAN.format("CAST(installs * 1000 + 17 AS DOUBLE)") + " AS shown FROM fx_apps")
def m18_human_number(spark, sf_dir):
    from rankfield.functions.parse import human_number

    return apps(spark, sf_dir).select("pkg", human_number(F.col("installs") * 1000 + 17).alias("shown"))


@query(f"""WITH f AS (SELECT keyword, 1 AS has, max(list_sum(per) / len(per) * (len(list_filter(per, lambda x: x > 0)) / len(per))) AS rel FROM (SELECT keyword, list_transform(kt, lambda t: CASE WHEN list_contains(tt, t) THEN 1.0::DOUBLE WHEN list_contains(st, t) THEN 0.6::DOUBLE WHEN list_contains(dt, t) THEN 0.35::DOUBLE ELSE 0::DOUBLE END) AS per
  FROM (SELECT o.keyword, regexp_extract_all(lower(o.keyword), '[a-z0-9]+') AS kt, regexp_extract_all(lower(a.title), '[a-z0-9]+') AS tt, regexp_extract_all(lower(a.short_desc), '[a-z0-9]+') AS st, regexp_extract_all(lower(a.description), '[a-z0-9]+') AS dt FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.featured = 1 AND o.country = 'us')) GROUP BY keyword),
p AS (SELECT keyword, count(*) AS n, count(*) FILTER (on_intent) AS rel_n, coalesce(quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (on_intent), 0) AS rel_p50, min(installs) AS weak, arg_min(slot, installs * 1000 + slot) AS weak_at, count(*) FILTER (days > 0 AND age <= 1) AS newc, count(*) FILTER (days > 0) AS dated FROM t_ready WHERE slot <= 10 GROUP BY keyword)
SELECT p.keyword, concat_ws(' ', CASE WHEN f.rel >= 0.40 THEN 'A promoted card that answers the phrase sits above the results.' WHEN f.has = 1 THEN 'A promoted card sits above the results.' END,
CASE WHEN rel_n = 0 THEN 'No app on the page is about the phrase.' WHEN rel_n <= greatest(floor(n / 3), 2) THEN rel_n || ' of ' || n || ' apps answer the phrase, around ' || {HUMAN.format('rel_p50')} || ' installs.' ELSE 'The phrase is well served: ' || rel_n || ' of ' || n || ' apps answer it.' END,
CASE WHEN weak < 10000 THEN 'An app with ' || {HUMAN.format('CAST(weak AS DOUBLE)')} || ' installs holds rank ' || weak_at || '.' END, CASE WHEN newc > 0 THEN newc || ' of them launched within a year.' WHEN dated > 0 THEN 'None of them launched within a year.' END) AS narrative FROM p LEFT JOIN f ON f.keyword = p.keyword""")
def m17_narrative(spark, sf_dir):
    return scoring.narrative(page_fields(spark, sf_dir)).select("keyword", "narrative")


@query(f"""WITH f AS (SELECT DISTINCT keyword, 1 AS has FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.featured = 1 AND o.country = 'us'),
p AS (SELECT keyword, least(count(*), 10) AS n, count(*) AS scraped, min(installs) FILTER (slot <= 10) AS weak, arg_min(slot, installs * 1000 + slot) FILTER (slot <= 10) AS weak_at, count(*) FILTER (slot <= 10 AND days > 0) / CAST(least(count(*), 10) AS DOUBLE) AS known, coalesce(min(age) FILTER (slot <= 10 AND days > 0), 0) AS newest, count(*) FILTER (slot <= 10 AND days > 0 AND age <= 1) AS fresh FROM t_context GROUP BY keyword),
g AS (SELECT keyword, count(*) AS size, min(slot) AS best, floor(quantile_cont(CAST(installs AS DOUBLE), 0.5)) AS med, min(installs) AS gweak, count(*) FILTER (days > 0 AND age <= 1) AS gfresh, coalesce(max(installs) FILTER (days > 0 AND age <= 1), 0) AS gtop FROM t_context WHERE slot % 3 = 1 GROUP BY keyword),
x AS (SELECT p.*, f.has, g.* EXCLUDE (keyword), length(p.keyword) * 7 AS demand, 1 + length(p.keyword) % 14 AS rank FROM p LEFT JOIN f ON f.keyword = p.keyword LEFT JOIN g ON g.keyword = p.keyword)
SELECT keyword, concat_ws(' ', CASE WHEN has = 1 THEN 'A promoted card above the results takes a share of the visits.' END,
CASE WHEN size IS NULL THEN 'The page does not split by meaning.' WHEN size = 1 THEN 'One app only answers this question: ' || {HUMAN.format('CAST(gweak AS DOUBLE)')} || ' installs at rank ' || best || '; the other ' || (scraped - 1) || ' answer another.'
WHEN size <= greatest(floor(scraped / 3), 2) THEN size || ' of ' || scraped || ' apps answer this question, at about ' || {HUMAN.format('med')} || ' installs; the rest are something else.' ELSE 'The question is well answered: ' || size || ' of ' || scraped || ' apps, at about ' || {HUMAN.format('med')} || ' installs.' END,
CASE WHEN weak_at <= n AND weak < 10000 AND (size IS NULL OR gweak <> weak) THEN 'Rank ' || weak_at || ' is held with ' || {HUMAN.format('CAST(weak AS DOUBLE)')} || ' installs, so the top is not defended.' END,
CASE WHEN known >= 0.5 THEN CASE WHEN gfresh > 0 AND size = 1 THEN 'It is under a year old, so there is a way in.' WHEN gfresh > 0 AND gtop >= 10000 THEN gfresh || ' of them are under a year old, the largest at ' || {HUMAN.format('CAST(gtop AS DOUBLE)')} || ' installs, so there is a way in.'
WHEN gfresh > 0 THEN gfresh || ' of them are under a year old, so there is a way in.' WHEN gfresh = 0 AND round(newest, 1) >= 4 THEN 'Nothing new has come in for ' || CAST(floor(round(newest, 1)) AS INT) || ' years.' WHEN fresh >= 2 THEN fresh || ' apps of the page are under a year old, though they answer another question.' END END,
CASE WHEN demand >= 70 THEN 'Many people search for it.' WHEN demand < 40 THEN 'Few people search for it, which limits what any rank brings.' END,
CASE WHEN rank <= 10 THEN 'A well-made newcomer would enter at about rank ' || rank || ', where the installs are.' ELSE 'A well-made newcomer would enter at about rank ' || rank || ', below where the installs are.' END) AS story FROM x""")
def m17_page_story(spark, sf_dir):
    """The whole story of a page, its group given: every third app from the first."""
    rows = thirds(spark, sf_dir)
    own = rows.where(F.col("group") == 1).groupBy("keyword").agg(
        F.count("*").alias("group_size"), F.min("slot").alias("group_best_rank"), F.floor(F.percentile("installs", 0.5)).cast("double").alias("group_median_installs"), F.min("installs").alias("group_weakest_installs"),
        F.count_if((F.col("days") > 0) & (F.col("age") <= 1)).alias("group_newcomers"), F.coalesce(F.max(F.when((F.col("days") > 0) & (F.col("age") <= 1), F.col("installs"))), F.lit(0)).alias("group_newcomer_installs"),
    )
    pages = page_fields(spark, sf_dir).drop("featured_relevance").withColumn("featured_relevance", F.lit(0.0))
    sizes = rows.groupBy("keyword").agg(F.count("*").alias("scraped"))
    told = pages.join(sizes.hint("merge"), "keyword").join(own.hint("merge"), "keyword", "left")
    return scoring.page_story(told.withColumns({"demand": (F.length("keyword") * 7).cast("double"), "entry_rank": 1 + F.length("keyword") % 14}))


def page_fields(spark, sf_dir):
    """Fields of whole pages, as an entrant sees them: nobody is left out."""
    rows = ready(spark, sf_dir)
    pairs = rows.withColumns({"own_pkg": F.lit("__hypothetical__"), "own_slot": F.lit(0), "idx": F.col("slot")})
    return field.summarise(pairs).join(field.featured_summary(cards(spark, sf_dir)), "keyword", "left").fillna({"has_featured": 0, "featured_relevance": 0.0})


@query("""SELECT keyword, count(*) FILTER (slot <= 10) AS n, round(quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (slot <= 10), 4) AS installs_p50, count(*) FILTER (slot <= 10 AND exact) AS exact_match_count, count(*) FILTER (slot <= 10 AND days > 0 AND age <= 1) AS newcomers, min(installs) FILTER (slot <= 10) AS weakest_installs,
count(*) FILTER (slot <= 10 AND exact) >= greatest(floor(count(*) FILTER (slot <= 10) / 2), 1) AS keyword_in_title, round(quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (slot <= 10), 4) AS bar_installs, round(quantile_cont(rating, 0.5) FILTER (slot <= 10), 4) AS bar_rating,
count(*) FILTER (slot <= 10 AND relevance >= 0.40) AS relevant_count, round(log10(quantile_cont(CAST(installs AS DOUBLE), 0.9) FILTER (slot <= 10) + 1) - log10(quantile_cont(CAST(installs AS DOUBLE), 0.1) FILTER (slot <= 10) + 1), 2) AS spread FROM t_context GROUP BY keyword""")
def m19_field_report(spark, sf_dir):
    return rounded(scoring.field_report(page_fields(spark, sf_dir)).select("keyword", "n", "installs_p50", "exact_match_count", "newcomers", "weakest_installs", "keyword_in_title", "bar_installs", "bar_rating", "relevant_count", "spread"), 4)


@query("""WITH c AS (SELECT keyword, pkg, slot, unnest(['log_installs', 'rating', 'reviews']) AS feature, unnest([ln(1 + installs), rating, CAST(reviews AS DOUBLE)]) AS x FROM t_slots), g AS (SELECT keyword, coalesce(min(slot) FILTER (slot >= 10), max(slot)) AS g FROM t_slots GROUP BY keyword),
d AS (SELECT c.keyword, c.pkg, c.feature, c.x AS yours, t.x AS theirs, CASE c.feature WHEN 'log_installs' THEN 0.5 WHEN 'rating' THEN 1.0 ELSE -0.25 END * (t.x - c.x) AS gain FROM c JOIN g ON g.keyword = c.keyword JOIN c t ON t.keyword = c.keyword AND t.slot = g.g AND t.feature = c.feature WHERE c.x <> t.x)
SELECT keyword, pkg, feature, round(gain, 5) AS gain, round(sum(greatest(gain, 0)) OVER (PARTITION BY keyword, pkg), 5) AS closable FROM d QUALIFY gain <> 0""")
def m20_counterfactual_why(spark, sf_dir):
    weights = spark.createDataFrame([("log_installs", 0.5), ("rating", 1.0), ("reviews", -0.25)], "feature string, coefficient double")
    return rounded(scoring.why(scoring.counterfactual(basic(spark, sf_dir), weights, BASIC)).select("keyword", "pkg", "feature", "gain", "closable"), 5)


# a ranker that is not linear: installs help up to a point, and only with a rating over 3
ODD = "least(log_installs, 9) * greatest(rating - 3, 0) - 0.1 * reviews"


@query(f"""WITH s AS (SELECT keyword, pkg, slot, ln(1 + installs) AS log_installs, rating, CAST(reviews AS DOUBLE) AS reviews FROM t_slots), g AS (SELECT keyword, coalesce(min(slot) FILTER (slot >= 10), max(slot)) AS g FROM t_slots GROUP BY keyword),
p AS (SELECT s.*, t.log_installs AS li, t.rating AS ra, t.reviews AS re FROM s JOIN g ON g.keyword = s.keyword JOIN s t ON t.keyword = s.keyword AND t.slot = g.g),
d AS (SELECT keyword, pkg, {ODD} AS base, least(li, 9) * greatest(rating - 3, 0) - 0.1 * reviews - ({ODD}) AS g1, least(log_installs, 9) * greatest(ra - 3, 0) - 0.1 * reviews - ({ODD}) AS g2, least(log_installs, 9) * greatest(rating - 3, 0) - 0.1 * re - ({ODD}) AS g3, log_installs, rating, reviews, li, ra, re FROM p),
c AS (SELECT *, least(CASE WHEN g1 > 0 THEN li ELSE log_installs END, 9) * greatest(CASE WHEN g2 > 0 THEN ra ELSE rating END - 3, 0) - 0.1 * CASE WHEN g3 > 0 THEN re ELSE reviews END - base AS closable FROM d),
u AS (SELECT keyword, pkg, unnest(['log_installs', 'rating', 'reviews']) AS feature, unnest([log_installs <> li, rating <> ra, reviews <> re]) AS apart, unnest([g1, g2, g3]) AS gain, closable FROM c)
SELECT keyword, pkg, feature, round(gain, 5) AS gain, round(closable, 5) AS closable FROM u WHERE apart AND gain <> 0""")
def m20_what_if_of_any_model(spark, sf_dir):
    """Gains by scoring again, of a ranker that is not linear."""
    found = scoring.what_if(basic(spark, sf_dir), BASIC, lambda rows: rows.withColumn("score", F.expr(ODD)))
    return rounded(scoring.why(found).select("keyword", "pkg", "feature", "gain", "closable"), 5)


@query()
def m20_what_if_of_the_ensemble(spark, sf_dir):
    """Gains of every ranked row by the mean logit of the seven fitted rankers, all 96 features."""
    rows = aligned(spark, sf_dir)
    fitted = rankers(spark, sf_dir)
    return rounded(scoring.why(scoring.what_if(rows.select("keyword", "pkg", "slot", *fx.FEATURES), fx.FEATURES, lambda x: models.mean_logit(fitted, x))))


@query()
def m21_feature_pull(spark, sf_dir):
    found = [(c, v) for m in rankers(spark, sf_dir) for c, v in models.coefficients(m, fx.FEATURES).items()]
    return rounded(scoring.feature_pull(spark.createDataFrame(found, "feature string, coefficient double")))


@query("SELECT count(DISTINCT keyword) AS keywords, (SELECT count(*) FROM t_slots) AS rows, count(DISTINCT keyword) >= 25 AS validated FROM fx_observations")
def m22_evidence_summary(spark, sf_dir):
    runs = slots(spark, sf_dir).agg(F.count("*").alias("n_rows")).withColumn("active", F.lit(True))
    return scoring.evidence_summary(observations(spark, sf_dir), runs)


REVIEWS = f"SELECT s.keyword, s.pkg, s.score, 1 + length(s.keyword) % 9 AS rank FROM {S} s WHERE s.slot = 5"  # a review of a page's fifth app


@query(f"""WITH r AS ({REVIEWS}), l AS (SELECT r.keyword, r.pkg, r.score, r.rank, list(o.score ORDER BY o.score DESC) AS s FROM r JOIN {S} o ON o.keyword = r.keyword AND o.pkg <> r.pkg GROUP BY ALL),
t AS (SELECT *, CASE WHEN rank <= 1 THEN s[1] + 0.25 WHEN rank > len(s) THEN s[len(s)] - 0.25 ELSE (s[rank - 1] + s[rank]) / 2 END AS target FROM l) SELECT keyword, pkg, rank, round(target, 9) AS target, round((target - score) * 6 / 5, 9) AS residual FROM t""")
def c1_c2_c7_rank_corrections(spark, sf_dir):
    rows = scored(spark, sf_dir)
    asks = rows.where("slot = 5").select("keyword", "pkg", (1 + F.length("keyword") % 9).alias("rank"))
    return rounded(memory.rank_corrections(asks, rows.select("keyword", "pkg", "score")).select("keyword", "pkg", "rank", "target", "residual"), 9)


def filed(spark, sf_dir):
    """A reviewer corrected the third app of each page."""
    rows = basic(spark, sf_dir).where("slot = 3")
    return rows.select(F.crc32("keyword").alias("id"), "keyword", "pkg", F.array(F.col("rating") / 5, F.col("slot") / 100.0).alias("features"), (F.col("rating") - 3).alias("residual"), F.lit(5.0).alias("weight"), F.col("rating").alias("target"), F.lit(None).cast("date").alias("retired_at"))


@query("""WITH f AS (SELECT keyword, pkg, rating / 5 AS a, slot / 100.0::DOUBLE AS b, rating - 3 AS r FROM t_slots WHERE slot = 3), q AS (SELECT keyword, pkg, rating / 5 AS a, slot / 100.0::DOUBLE AS b FROM t_slots),
p AS (SELECT q.keyword, q.pkg, f.r, 5 * exp(-((q.a - f.a) * (q.a - f.a) + (q.b - f.b) * (q.b - f.b)) / 0.5625) AS w, q.keyword = f.keyword AND q.pkg = f.pkg AS same, f.keyword AS fk FROM q, f), n AS (SELECT *, row_number() OVER (PARTITION BY keyword, pkg ORDER BY round(w, 9) DESC, fk) AS n FROM p)
SELECT keyword, pkg, round(coalesce(max(r * 5 / 6) FILTER (same), sum(w * r) FILTER (n <= 16) / (sum(w) FILTER (n <= 16) + 1)), 5) AS residual FROM n GROUP BY keyword, pkg""")
def c3_read_residuals(spark, sf_dir):
    """Every ranked row: its own correction, or the kernel mean of the nearest."""
    rows = basic(spark, sf_dir).select("keyword", "pkg", F.array(F.col("rating") / 5, F.col("slot") / 100.0).alias("features"))
    # ties go by id: numbered by the alphabet
    held = filed(spark, sf_dir).withColumn("id", F.row_number().over(Window.orderBy("keyword")).cast("long"))
    return rounded(memory.read_residuals(rows, held), 5)


@query()
def c3_read_near_residuals(spark, sf_dir):
    """The same over all 96 features, in which most corrections are too far to matter."""
    rows = aligned(spark, sf_dir).select("keyword", "pkg", "slot", F.array(*fx.FEATURES).alias("features"))
    filed_ = rows.where("slot <= 3").select(F.crc32(F.concat_ws("|", "keyword", "pkg")).alias("id"), "keyword", "pkg", "features", (F.col("slot") - 2.0).alias("residual"), F.lit(5.0).alias("weight"))
    return rounded(memory.read_residuals(rows.where("slot > 3"), filed_), 5)


@query("SELECT keyword, pkg, rating >= 3 AS retired FROM t_slots WHERE slot = 3")
def c4_c5_retire(spark, sf_dir):
    rows = filed(spark, sf_dir)
    kept = memory.drop_stale_shapes(memory.retire_stale(rows, 2, AS_OF), 2)
    new = rows.select("keyword", "pkg", F.lit(2.5).alias("score"))
    done = memory.retire_learned(kept.withColumn("target", F.lit(6.0) - F.col("target")), new, AS_OF)
    return done.select("keyword", "pkg", F.col("retired_at").isNotNull().alias("retired"))


@query("SELECT keyword, CASE WHEN length(keyword) % 2 = 0 THEN CASE WHEN length(keyword) % 3 = 0 THEN 'absorbed' ELSE 'queued' END ELSE 'rejected' END AS status FROM (SELECT DISTINCT keyword FROM t_slots)")
def c6_absorb_corrections(spark, sf_dir):
    rows = slots(spark, sf_dir).select("keyword").distinct().withColumn("status", F.when(F.length("keyword") % 2 == 0, "queued").otherwise("rejected"))
    return memory.absorb_corrections(rows, F.length("keyword") % 3 == 0)


def judged(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    most = rows.agg(F.max("o_totalprice").alias("m"))
    return rows.crossJoin(F.broadcast(most)).select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / (F.col("m") + 1)).alias("p"), "o_orderkey")


J = "(SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice / (max(o_totalprice) OVER () + 1) AS p, o_orderkey FROM orders)"


@query(f"SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM {J})")
def e1_auc(spark, sf_dir):
    return rounded(evaluate.auc(judged(spark, sf_dir)))


@query(f"SELECT round(sum(n * abs(y - p)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(y) AS y, avg(p) AS p FROM {J} GROUP BY CASE {' '.join(f'WHEN p < {i / 10} THEN {i}' for i in range(1, 10))} ELSE 10 END)")
def e2_calibration_error(spark, sf_dir):
    return rounded(evaluate.calibration_error(judged(spark, sf_dir)))


@query("""WITH f AS (SELECT a, b, greatest(r, 1 / r) AS f FROM (SELECT ln(1 + installs) AS a, ln(1 + reviews * 1000) AS b, greatest(reviews * 1000, 1) / CAST(greatest(installs, 1) AS DOUBLE) AS r FROM fx_apps))
SELECT count(*) AS n, round(avg(abs(a - b)), 5) AS mae_log, round(quantile_cont(f, 0.5), 4) AS factor_p50, round(quantile_cont(f, 0.9), 3) AS factor_p90 FROM f""")
def e3_error_factor(spark, sf_dir):
    rows = apps(spark, sf_dir).select(F.log1p("installs").alias("a"), F.log1p(F.col("reviews") * 1000).alias("b"))
    return evaluate.error_factor(rows, "a", "b").select("n", F.round("mae_log", 5).alias("mae_log"), F.round("factor_p50", 4).alias("factor_p50"), F.round("factor_p90", 3).alias("factor_p90"))


RUNS = "(SELECT 'v' || CAST(year(observed_at) - 1990 AS VARCHAR) AS version, 0.5 + count(DISTINCT pkg) / 20000.0::DOUBLE AS auc, count(DISTINCT keyword) AS n_keywords, year(observed_at) = 1996 AS active FROM fx_observations GROUP BY ALL)"


def runs(spark, sf_dir):
    """A run for each snapshot year, scored by how many apps it saw."""
    y = F.year("observed_at")
    return observations(spark, sf_dir).groupBy(y.alias("_y")).agg((F.count_distinct("pkg") / 20_000.0 + 0.5).alias("auc"), F.count_distinct("keyword").alias("n_keywords")).select(F.concat(F.lit("v"), (F.col("_y") - 1990).cast("string")).alias("version"), "auc", "n_keywords", (F.col("_y") == 1996).alias("active"))


def next_run(spark, sf_dir):
    return slots(spark, sf_dir).agg((F.count_distinct("pkg") / 20_000.0 + 0.56).alias("auc"), F.count_distinct("keyword").alias("n_keywords"))


NEXT = f"(SELECT auc, n_keywords, NOT (n_keywords >= 25 AND (auc < (SELECT max(auc) FROM {RUNS} WHERE active) - 0.01 OR auc < 0.55)) AS promoted FROM (SELECT 0.56 + count(DISTINCT pkg) / 20000.0::DOUBLE AS auc, count(DISTINCT keyword) AS n_keywords FROM t_slots))"


@query(f"SELECT round(auc, 6) AS auc, n_keywords, promoted FROM {NEXT}")
def e4_promotion_gate(spark, sf_dir):
    return rounded(evaluate.promotion_gate(next_run(spark, sf_dir), runs(spark, sf_dir)))


@query(f"SELECT version, round(auc, 6) AS auc, active AND NOT (SELECT promoted FROM {NEXT}) AS active FROM {RUNS} UNION ALL SELECT 'v' || (SELECT max(CAST(substr(version, 2) AS INT)) + 1 FROM {RUNS}), round(auc, 6), promoted FROM {NEXT}")
def e5_register_run(spark, sf_dir):
    registry = runs(spark, sf_dir)
    return rounded(evaluate.register_run(registry, evaluate.promotion_gate(next_run(spark, sf_dir), registry)).select("version", "auc", "active"))


@query()
def e5_register_fitted_run(spark, sf_dir):
    """The gate and the registry fed with the ranker's own held-out figure."""
    measured = m1_held_out_auc(spark, sf_dir).select("auc").crossJoin(slots(spark, sf_dir).agg(F.count_distinct("keyword").alias("n_keywords")))
    registry = runs(spark, sf_dir)
    return rounded(evaluate.register_run(registry, evaluate.promotion_gate(measured, registry)))


@query("""WITH r AS (SELECT ln(1 + installs) AS t, ln(1 + reviews * 1000) AS a, ln(1 + reviews * 20000) AS b FROM fx_apps WHERE p_partkey % 7 <> 0), s AS (SELECT count(*) AS n, quantile_cont(exp(abs(a - t)), 0.5) AS fa, quantile_cont(exp(abs(b - t)), 0.5) AS fb FROM r)
SELECT n, round(fa, 4) AS factor_a, round(fb, 4) AS factor_b, CASE WHEN n < 30 THEN NULL WHEN fa <= fb THEN 'a' ELSE 'b' END AS better FROM s""")
def e6_head_to_head(spark, sf_dir):
    rows = apps(spark, sf_dir).select(F.log1p("installs").alias("actual"), F.log1p(F.col("reviews") * 1000).alias("a"), F.when(F.col("p_partkey") % 7 != 0, F.log1p(F.col("reviews") * 20_000)).alias("b"))
    return rounded(evaluate.head_to_head(rows), 4)


@query(f"SELECT version, round(auc, 6) AS auc, n_keywords FROM {RUNS} ORDER BY CAST(substr(version, 2) AS INT) DESC LIMIT 20")
def e7_run_history(spark, sf_dir):
    return rounded(evaluate.run_history(runs(spark, sf_dir)).select("version", "auc", "n_keywords"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(sf_dir, pathGlobFilter="events.parquet")
    return jobs.as_stream_time(rows, "ts").select(F.col("user_id").cast("string").alias("pkg"), F.col("event_type").alias("keyword"), F.col("ts").alias("observed_at"), F.col("value").alias("installs"))


def _drained(spark, rows, mode: str = "append"):
    """Run a stream over all that is there, and read what it wrote."""
    path = scratch(spark, f"stream-{uuid.uuid4().hex}")
    if mode == "append":
        rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/out")
    rows.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS pkg, event_type AS keyword FROM events")
def st1_stream_observations(spark, sf_dir):
    rows = jobs.stream_observations(_events(spark, sf_dir), ["pkg", "keyword"], late="60 days")
    return _drained(spark, rows.select("pkg", "keyword"))


@query("SELECT CAST(user_id AS VARCHAR) AS pkg, max(ts) AS observed_at FROM events GROUP BY user_id")
def st2_stream_latest_apps(spark, sf_dir):
    path = scratch(spark, f"stream-{uuid.uuid4().hex}")
    query_ = jobs.stream_latest_apps(_events(spark, sf_dir).select("pkg", "observed_at", "installs"), f"{path}/out", f"{path}/log", ["pkg"], "observed_at").trigger(availableNow=True).start()
    query_.awaitTermination()
    return jobs.latest_table(spark, f"{path}/out").select("pkg", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


# windows up to the watermark: a day before the last event
WINDOWS = """SELECT CAST(w AS TIMESTAMP) AS start, CAST(w + INTERVAL 7 DAY AS TIMESTAMP) AS "end", event_type AS keyword, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS installs_p50, max(value) AS installs_max FROM ({0}) WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY w, event_type"""


def zoneless(df):
    """Times without a zone, as other engines have them."""
    return rounded(df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes]))


@query(WINDOWS.format("SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w FROM events"))
def st3_stream_field_state(spark, sf_dir):
    return zoneless(_drained(spark, jobs.stream_field_state(_events(spark, sf_dir))))


@query(WINDOWS.format("SELECT *, CAST(unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS TIMESTAMP) AS w FROM events"))
def st3_stream_field_state_sliding(spark, sf_dir):
    return zoneless(_drained(spark, jobs.stream_field_state(_events(spark, sf_dir), slide="1 day")))


@query("""WITH d AS (SELECT event_type AS keyword, CAST(user_id AS VARCHAR) AS pkg, date_trunc('week', ts) AS w FROM events GROUP BY ALL), p AS (SELECT *, CAST(('0x' || substr(md5(pkg || '|' || strftime(w, '%Y-%m-%d')), 1, 8))::BIGINT % 30 + 1 AS INT) AS position FROM d),
t AS (SELECT keyword, w AS older, lead(w) OVER (PARTITION BY keyword ORDER BY w) AS newer FROM (SELECT DISTINCT keyword, w FROM d)), b AS (SELECT keyword, older, newer, pkg, max(was) AS was, max(now) AS now FROM (SELECT t.*, p.pkg, p.position AS was, NULL::INT AS now FROM t JOIN p ON p.keyword = t.keyword AND p.w = t.older WHERE newer IS NOT NULL UNION ALL SELECT t.*, p.pkg, NULL, p.position FROM t JOIN p ON p.keyword = t.keyword AND p.w = t.newer) GROUP BY ALL)
SELECT keyword, pkg, CASE WHEN was IS NULL THEN 'entered' WHEN now IS NULL THEN 'left' ELSE 'moved' END AS event, was AS from_position, now AS to_position, CAST(date_diff('day', older, newer) AS INT) AS gap_days FROM b
WHERE newer < (SELECT max(w) FROM d d2 WHERE d2.keyword = b.keyword) AND (was IS NULL OR now IS NULL OR was <> now)""")
def st4_stream_transitions(spark, sf_dir):
    """Pages of a week; the last week is still being read, so it is not compared."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", "pkg", F.date_format("observed_at", "yyyy-MM-dd"))), 1, 8), 16, 10).cast("long") % 30 + 1
    rows = _events(spark, sf_dir).withColumn("observed_at", F.date_trunc("week", "observed_at")).select("keyword", "pkg", "observed_at", place.cast("int").alias("position"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)  # this stream's state needs it; put back when it is drained
    try:
        return _drained(spark, jobs.stream_transitions(rows))
    finally:
        spark.conf.set(provider, before)


@query("SELECT CAST(user_id AS VARCHAR) AS pkg, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n FROM events GROUP BY user_id")
def st5_stream_measured_growth(spark, sf_dir):
    return rounded(_drained(spark, jobs.stream_measured_growth(_events(spark, sf_dir)), "complete").select("pkg", "least", "most", "n"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events))
SELECT CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 10 MINUTE AS TIMESTAMP) AS "end", event_type AS keyword, count(*) AS n FROM g GROUP BY event_type, s HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def st6_stream_page_sessions(spark, sf_dir):
    return zoneless(_drained(spark, jobs.stream_page_sessions(_events(spark, sf_dir))))
