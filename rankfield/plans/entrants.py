"""Queries over new apps that are not on a page yet."""

from pyspark.sql import functions as F

from rankfield.operators import change as ch
from rankfield.operators import entry, field, intent, models, scoring, suggest
from rankfield.operators import features as fx
from rankfield.plans.models import CARDS, GROUPED, THRESHOLDS, aligned, features, groups, points, rankers, thirds
from rankfield.plans.pages import cards, context, ready, rounded, slots, states
from rankfield.plans.registry import query
from rankfield.sources.storage import kept, once
from rankfield.sources.views import AS_OF, view


def newcomers(spark, sf_dir):
    """A well-made app for every page. Its text is the phrase, so it means the same."""
    return scoring.hypothetical_entrants(slots(spark, sf_dir).select("keyword").distinct(), AS_OF).withColumn("cosine", F.lit(1.0))


def placed(spark, sf_dir):
    """The same, half of them with a given place."""
    given = slots(spark, sf_dir).select("keyword", F.when(F.length("keyword") % 2 == 0, 1 + F.length("keyword") % 12).alias("entry_rank")).distinct()
    return entry.entrant_rows(newcomers(spark, sf_dir), given)


ASK = "(SELECT keyword, CASE WHEN length(keyword) % 2 = 0 THEN 1 + length(keyword) % 12 END AS r FROM t_slots GROUP BY keyword)"
TOP, MINE = "FILTER (slot <= 10)", "FILTER (slot <= 10 AND slot % 3 = 0)"


@query(f"""SELECT s.keyword, count(*) {TOP} AS n, round(quantile_cont(CAST(installs AS DOUBLE), 0.1) {TOP}, 4) AS installs_p10, round(quantile_cont(CAST(installs AS DOUBLE), 0.9) {TOP}, 4) AS installs_p90, count(*) {MINE} AS relevant_count, coalesce(round(quantile_cont(CAST(installs AS DOUBLE), 0.5) {MINE}, 4), 0) AS installs_p50_relevant,
arg_min(slot, installs * 1000 + slot) {TOP} AS weakest_rank, count(*) FILTER (slot <= 10 AND days > 0 AND age <= 1) AS newcomers, coalesce(min(slot) FILTER (slot <= 10 AND exact), 0) AS first_match_rank, round(quantile_cont(advantage, 0.5) {TOP}, 4) AS advantage_p50, round(quantile_cont(relevance, 0.5) {TOP}, 4) AS relevance_p50,
coalesce(round(quantile_cont(floor_rate, 0.5) FILTER (abs(slot - r) BETWEEN 1 AND 2), 4), 0) AS band_all, count(*) FILTER (abs(slot - r) BETWEEN 1 AND 2) AS band_evidence, coalesce(round(quantile_cont(floor_rate, 0.5) FILTER (slot > r AND slot <= r + 5), 4), 0) AS below_all,
coalesce(round(arg_min(rate, abs(slot - r) * 1000 + slot) FILTER (slot <= 10 AND slot % 3 = 0 AND r IS NOT NULL), 4), 0) AS neighbour_rate, round(coalesce(sum(1 - advantage) FILTER (days > 0 AND age <= 1.5), 0), 4) AS unaided_recent_evidence
FROM t_ready s JOIN {ASK} e ON e.keyword = s.keyword GROUP BY s.keyword""")
def f2_fields_of_entrants(spark, sf_dir):
    """The field of apps that are not on the page, with and without a place, pages split by slot."""
    rows = field.prepared(context(spark, sf_dir), thirds(spark, sf_dir).select("keyword", "pkg", "group"))
    table = field.outside_table(rows, placed(spark, sf_dir), cards(spark, sf_dir))
    names = "n installs_p10 installs_p90 relevant_count installs_p50_relevant weakest_rank newcomers first_match_rank advantage_p50 relevance_p50 band_all band_evidence below_all neighbour_rate unaided_recent_evidence".split()
    return rounded(table.select("keyword", *names), 4)


@query(f"""WITH g AS (SELECT keyword, grp, count(*) AS size, min(slot) AS best, CAST(floor(quantile_cont(CAST(installs AS DOUBLE), 0.5)) AS BIGINT) AS med, min(installs) AS weak FROM {GROUPED} GROUP BY keyword, grp), n AS (SELECT keyword, least(count(*), 10) AS n FROM t_slots GROUP BY keyword)
SELECT g.keyword, size AS intent_rivals, med AS intent_median, weak AS intent_weakest, round(1 - (best - 1) / CAST(n AS DOUBLE), 6) AS intent_reach, round(size / CAST(n AS DOUBLE), 6) AS intent_share FROM g JOIN n ON n.keyword = g.keyword WHERE grp = 0""")
def f19_stats_of_entrants(spark, sf_dir):
    """The group that an entrant joins, pages split by slot."""
    rows = thirds(spark, sf_dir)
    return rounded(intent.outside_stats(rows.drop("group"), rows.select("keyword", "pkg", "group"), entry.entrant_rows(newcomers(spark, sf_dir))).drop("own_pkg"))


_M = "range(7) m(m)"
_SEEN = f"(SELECT keyword, pkg, avg(rating - 3 + (m - 3) * (slot % 5) / 10.0::DOUBLE) AS score FROM t_slots, {_M} GROUP BY keyword, pkg)"
_NEW = f"(SELECT keyword, avg(l) AS score, stddev_samp(1 / (1 + exp(-l))) AS spread FROM (SELECT DISTINCT keyword, m, (length(keyword) % 9) / 4.0::DOUBLE + (m - 3) / 7.0::DOUBLE AS l FROM t_slots, {_M}) GROUP BY keyword)"


@query(f"""WITH s AS MATERIALIZED (SELECT keyword, pkg, round(score, 9) AS score FROM {_SEEN}), q AS (SELECT quantile_cont(score, [{', '.join(str(i / 100) for i in range(101))}]) AS qs FROM s), w AS (SELECT keyword, round(score, 9) AS score, spread FROM {_NEW}),
g AS (SELECT keyword, score AS gate FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, pkg) AS r, count(*) OVER (PARTITION BY keyword) AS n FROM s) WHERE r = least(10, n)),
e AS (SELECT s.keyword, count(*) FILTER (s.score > w.score) + 1 AS entry_rank, count(*) + 1 + coalesce(max(c), 0) AS field_size, coalesce(max(c), 0) AS c, any_value(w.score) AS ws, any_value(w.spread) AS spread FROM s JOIN w ON w.keyword = s.keyword LEFT JOIN {CARDS} k ON k.keyword = s.keyword GROUP BY s.keyword)
SELECT e.keyword, entry_rank, entry_rank + c AS displayed_rank, field_size, round(1 / (1 + exp(-ws)), 5) AS chance, round(1 - least(spread / 0.5, 1), 5) AS agreement, 0.8::DOUBLE AS evidence, round((1 - least(spread / 0.5, 1)) * 0.8, 5) AS confidence,
CASE WHEN length(e.keyword) % 5 = 0 THEN 42.0 ELSE CAST(len(list_filter(qs, lambda x: x < gate)) AS DOUBLE) END::DOUBLE AS crowding, length(e.keyword) % 5 = 0 AS overridden FROM e JOIN g ON g.keyword = e.keyword, q""")
def m11_entries_of_given_rankers(spark, sf_dir):
    """Rank, chance, confidence and crowding by seven rankers that are given, not fitted."""
    rows = slots(spark, sf_dir)
    each = lambda df: df.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(7)])))
    page = each(rows).select("keyword", "pkg", "member", F.round(F.col("rating") - 3 + (F.col("member") - 3) * (F.col("slot") % 5) / 10.0, 9).alias("logit"))
    new = each(newcomers(spark, sf_dir)).select("keyword", "pkg", "member", (F.length("keyword") % 9 / 4.0 + (F.col("member") - 3) / 7.0).alias("logit"))
    overrides = rows.where("length(keyword) % 5 = 0").select("keyword", F.lit(42.0).alias("value")).distinct()
    return rounded(entry.entries(page, new, cards(spark, sf_dir), overrides, 20).drop("pkg", "score"), 5)


def fitted(spark, sf_dir):
    """Seven rankers on all features, seven page-relative download models, a rate head."""
    table, rows = features(spark, sf_dir), aligned(spark, sf_dir)
    day = F.lit(AS_OF).cast("date")
    kernel = models.kernel_features(fx.describe_points(points(spark, sf_dir), day, day))
    own = ready(spark, sf_dir).where("days > 0").select("keyword", F.col("pkg").alias("own_pkg"), F.log1p("rate").alias("log_rate"))
    rates = entry.fit_rates(once(spark, sf_dir, "rate-kernel", lambda: kernel.join(own.hint("merge"), ["keyword", "own_pkg"])))
    head, _ = models.fit_rate_head(rows, fx.FEATURES)
    seen = rows.agg(F.count_distinct("keyword").alias("n"), F.max("rate_label").alias("cap")).first()
    return entry.Fitted(rankers(spark, sf_dir), kept(fx.fit_scaler(table, fx.FEATURES), "scaler"), fx.FEATURES, seen.n, rates, [head], seen.cap or 17.7)


@query()
def m11_entrants_scored_whole(spark, sf_dir):
    """Every page's newcomer by the fitted models: rank, chance, crowding, downloads, caveats, verdict."""
    split = groups(spark, sf_dir)
    rows = kept(field.prepared(context(spark, sf_dir), split), "split-rows")
    signals = suggest.suggestion_signals(view(spark, sf_dir, "fx_suggestions"), rows.select("keyword"))
    history = ch.field_deltas(states(spark, sf_dir), rows, AS_OF)
    none = rows.limit(0).select("keyword", F.lit(0.0).alias("value"))
    return rounded(entry.score_entries(rows, split, aligned(spark, sf_dir), newcomers(spark, sf_dir), cards(spark, sf_dir), signals, history, none, fitted(spark, sf_dir), AS_OF, THRESHOLDS))
