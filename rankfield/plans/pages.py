"""Queries over page state, fields, suggestions and change."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.operators import change, field, ingest, state, suggest
from rankfield.plans.raw import COMPACT, sessions
from rankfield.plans.registry import query
from rankfield.sources import tables
from rankfield.sources.storage import kept, once, scratch
from rankfield.sources.views import AS_OF, view


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_observations")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_apps")


def app_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An app has the vector of its part's number."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = vectors.count()
    return apps(spark, sf_dir).withColumn("vec_id", F.col("p_partkey") % n).join(vectors.select("vec_id", "embedding"), "vec_id").select("pkg", F.col("embedding").alias("vector"))


def keyword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword has the vector of its place in the alphabet; a keyword list is numbered here."""
    words = observations(spark, sf_dir).select("keyword").distinct().withColumn("vec_id", F.row_number().over(Window.orderBy("keyword")) - 1)
    return words.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id").select("keyword", F.col("embedding").alias("keyword_vector"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "page-slots", lambda: state.ranked_fields(observations(spark, sf_dir), apps(spark, sf_dir)))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return state.attach_context(slots(spark, sf_dir), view(spark, sf_dir, "fx_app_snapshots"), observations(spark, sf_dir), apps(spark, sf_dir), AS_OF, keyword_vectors(spark, sf_dir), app_vectors(spark, sf_dir))

    return once(spark, sf_dir, "page-context", build)


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "page-rows", lambda: field.prepared(context(spark, sf_dir)))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.field_states(observations(spark, sf_dir), apps(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("SELECT keyword, pkg, position, source, observed_at, title, installs FROM t_latest JOIN fx_apps USING (pkg)")
def r1_latest_observations(spark, sf_dir):
    return state.latest_observations(observations(spark, sf_dir), apps(spark, sf_dir)).select("keyword", "pkg", "position", "source", "observed_at", "title", "installs")


@query("""SELECT keyword, pkg, observed_at, title, installs FROM (SELECT *, row_number() OVER (PARTITION BY keyword, country, pkg ORDER BY observed_at DESC) AS n FROM fx_observations WHERE featured = 1 AND country = 'us')
JOIN fx_apps USING (pkg) WHERE n = 1""")
def r2_featured_apps(spark, sf_dir):
    return state.featured_apps(observations(spark, sf_dir), apps(spark, sf_dir)).select("keyword", "pkg", "observed_at", "title", "installs")


@query("SELECT keyword, pkg, slot, position, installs FROM t_slots WHERE keyword = (SELECT min(p_name) FROM part)")
def r3_ranked_field(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min("p_name").alias("keyword"))
    return slots(spark, sf_dir).join(F.broadcast(first), "keyword").select("keyword", "pkg", "slot", "position", "installs")


@query("SELECT keyword, pkg, slot, position, installs FROM t_slots")
def r4_ranked_fields(spark, sf_dir):
    return slots(spark, sf_dir).select("keyword", "pkg", "slot", "position", "installs")


@query("""SELECT l.keyword, l.pkg, row_number() OVER (PARTITION BY l.keyword ORDER BY l.position, CASE WHEN l.source = 'review' THEN 0 ELSE 1 END, a.installs DESC, l.pkg) AS slot
FROM t_latest l JOIN fx_apps a ON a.pkg = l.pkg""")
def r4_ranked_fields_with_absent(spark, sf_dir):
    return state.ranked_fields(observations(spark, sf_dir), apps(spark, sf_dir), "reference").select("keyword", "pkg", "slot")


@query("SELECT pkg, round(measured_per_day, 6) AS measured_per_day FROM t_growth")
def r5_measured_growth(spark, sf_dir):
    return rounded(state.measured_growth(view(spark, sf_dir, "fx_app_snapshots")))


@query("SELECT bucket, round(rate, 6) AS rate, n FROM t_norms")
def r6_age_rate_norms(spark, sf_dir):
    return rounded(state.age_rate_norms(apps(spark, sf_dir), AS_OF))


@query("SELECT keyword, pkg, slot, breadth, round(measured_per_day, 6) AS measured_per_day, round(norm, 6) AS age_norm, round(rate, 6) AS rate, round(relevance, 6) AS relevance, exact FROM t_context")
def r7_r9_page_context(spark, sf_dir):
    """Age norms by nearest bucket and the joins that carry growth and breadth."""
    return rounded(context(spark, sf_dir).select("keyword", "pkg", "slot", "breadth", "measured_per_day", "age_norm", "rate", "relevance", "exact"))


@query("SELECT pkg, breadth FROM t_breadth")
def r8_keyword_breadth(spark, sf_dir):
    return state.keyword_breadth(observations(spark, sf_dir))


@query("SELECT pkg, count(DISTINCT keyword) AS breadth FROM fx_observations WHERE position IS NOT NULL GROUP BY pkg")
def r8_breadth_sketches(spark, sf_dir):
    """From a sketch of each day, kept and merged; sets as small as these are told exactly."""
    return state.sketched_breadth(kept(state.breadth_sketches(observations(spark, sf_dir)), "breadth-sketches"))


@query(f"SELECT keyword, date_diff('day', max(observed_at), DATE '{AS_OF}') AS age_days FROM fx_observations GROUP BY keyword")
def r10_page_age(spark, sf_dir):
    return state.page_age(observations(spark, sf_dir), AS_OF)


@query("SELECT keyword, max(observed_at) AS last_seen, count(DISTINCT pkg) AS n_apps FROM fx_observations GROUP BY keyword")
def r11_keyword_catalogue(spark, sf_dir):
    return state.keyword_catalogue(observations(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM fx_apps) AS apps, count(DISTINCT keyword) AS keywords, count(*) FILTER (position < 251) AS ranked_rows, count(*) FILTER (featured = 1) AS promoted_rows FROM fx_observations""")
def r12_status_counts(spark, sf_dir):
    return state.status_counts(apps(spark, sf_dir), observations(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM fx_apps) AS apps, count(DISTINCT keyword) AS keywords, count(*) FILTER (position < 251) AS ranked_rows, count(*) FILTER (featured = 1) AS promoted_rows,
(SELECT count(*) FROM t_slots WHERE slot = 5) AS corrections, (SELECT count(*) FROM t_slots WHERE slot = 5 AND length(keyword) % 2 = 0) AS queued_corrections, (SELECT count(*) FROM t_slots WHERE slot = 3 AND rating < 3) AS live_residuals, (SELECT count(DISTINCT keyword) FROM t_slots WHERE length(keyword) % 3 = 0) AS overrides FROM fx_observations""")
def r12_whole_status(spark, sf_dir):
    """With reviews of each page's fifth app, residuals of its third, and set values for some pages."""
    rows = slots(spark, sf_dir)
    corrections = rows.where("slot = 5").select("keyword", F.when(F.length("keyword") % 2 == 0, "queued").otherwise("absorbed").alias("status"))
    residuals = rows.where("slot = 3").select(F.when(F.col("rating") >= 3, F.lit(AS_OF).cast("date")).alias("retired_at"))
    overrides = rows.where("length(keyword) % 3 = 0").select("keyword").distinct()
    return state.status_counts(apps(spark, sf_dir), observations(spark, sf_dir), corrections, residuals, overrides)


# a keyword was last fetched as many days after its newest page as its name is long
FETCHED = "(SELECT keyword, CAST(observed_at + CAST(length(keyword) AS INT) AS DATE) AS observed_at FROM fx_observations)"
DUE = "DATE '2002-01-16'"


@query(f"SELECT keyword, date_diff('day', max(observed_at), {DUE}) AS age_days FROM {FETCHED} GROUP BY keyword HAVING date_diff('day', max(observed_at), {DUE}) >= 7")
def r13_due_keywords(spark, sf_dir):
    fetched = observations(spark, sf_dir).withColumn("observed_at", F.date_add("observed_at", F.length("keyword")))
    return state.due_keywords(fetched, "2002-01-16")


@query(f"""SELECT t.keyword, a.age_days FROM (SELECT DISTINCT lower(p_type) AS keyword FROM part UNION SELECT p_name FROM part) t
LEFT JOIN (SELECT keyword, date_diff('day', max(observed_at), DATE '{AS_OF}') AS age_days FROM fx_observations GROUP BY keyword) a ON a.keyword = t.keyword WHERE a.age_days IS NULL OR a.age_days >= 1""")
def r14_pending_targets(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    targets = part.select(F.lower("p_type").alias("keyword")).union(part.select("p_name")).distinct()
    return state.pending_targets(targets, observations(spark, sf_dir), AS_OF, 1)


@query("SELECT pkg, title, installs FROM fx_apps WHERE developer = 'Brand#11' AND trim(developer) <> ''")
def r15_publisher_catalogue(spark, sf_dir):
    return state.publisher_catalogue(apps(spark, sf_dir), "Brand#11")


@query("SELECT pkg, title, installs FROM fx_apps WHERE developer = 'Brand#23' AND trim(developer) <> ''")
def r15_publisher_table(spark, sf_dir):
    """The same from a table in buckets by publisher, of which a lookup reads one."""
    name = f"publishers_{uuid.uuid4().hex}"
    store = tables.publisher_table(apps(spark, sf_dir), name, scratch(spark, name))
    return state.publisher_catalogue(store, "Brand#23")


@query("SELECT DISTINCT keyword, observed_at FROM fx_observations")
def r16_snapshot_times(spark, sf_dir):
    return state.snapshot_times(observations(spark, sf_dir))


@query("SELECT o.keyword, o.pkg, o.position, a.title, a.installs FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.observed_at = DATE '1996-12-31' AND o.position IS NOT NULL")
def r17_page_at(spark, sf_dir):
    return state.page_at(observations(spark, sf_dir), apps(spark, sf_dir), "1996-12-31").select("keyword", "pkg", "position", "title", "installs")


@query("""WITH p AS (SELECT keyword, pkg, title, installs, CAST(NULL AS INT) AS organic_position, 1 AS promoted FROM (SELECT *, row_number() OVER (PARTITION BY keyword, country, pkg ORDER BY observed_at DESC) AS n FROM fx_observations WHERE featured = 1 AND country = 'us') JOIN fx_apps USING (pkg) WHERE n = 1
UNION ALL SELECT keyword, pkg, title, installs, slot, 0 FROM t_slots)
SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY promoted DESC, organic_position, pkg) AS position, list_has_all(regexp_extract_all(lower(title), '[a-z0-9]+'), regexp_extract_all(lower(keyword), '[a-z0-9]+')) AS exact FROM p""")
def r18_publish_page(spark, sf_dir):
    o, a = observations(spark, sf_dir), apps(spark, sf_dir)
    return state.publish_page(state.ranked_fields(o, a), state.featured_apps(o, a))


TARGETS = """SELECT keyword, pkg, title, share FROM (SELECT k.keyword, a.pkg, a.title, len(list_intersect(k.t, a.t)) / CAST(len(k.t) AS DOUBLE) AS share, row_number() OVER (PARTITION BY k.keyword ORDER BY len(list_intersect(k.t, a.t)) DESC, a.pkg) AS n
FROM (SELECT DISTINCT keyword, list_distinct(regexp_extract_all(lower(keyword), '[a-z0-9]+')) AS t FROM fx_observations) k,
(SELECT pkg, title, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM fx_apps WHERE developer = 'Brand#11') a) WHERE n = 1 AND share >= 0.6"""


def own_targets(spark, sf_dir):
    own = apps(spark, sf_dir).where("developer = 'Brand#11'")
    return state.match_targets(observations(spark, sf_dir).select("keyword").distinct(), own)


@query(TARGETS)
def r19_match_targets(spark, sf_dir):
    return own_targets(spark, sf_dir)


@query(f"""WITH m AS ({TARGETS}) SELECT keyword, 'us' AS country, pkg, CAST(251 AS BIGINT) AS position, 'owned' AS source, 0 AS featured, DATE '{AS_OF}' AS observed_at
FROM m WHERE NOT EXISTS (SELECT 1 FROM t_slots s WHERE s.keyword = m.keyword AND s.pkg = m.pkg)""")
def r20_record_absence(spark, sf_dir):
    return state.record_absence(own_targets(spark, sf_dir), slots(spark, sf_dir), AS_OF)


RESOLVED = """SELECT w.page, w.title, k.pkg FROM (SELECT page, CASE WHEN ordinal % 997 = 5 THEN 'lost ' || title ELSE title END AS title FROM fx_raw) w LEFT JOIN (SELECT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t, min(pkg) AS pkg FROM fx_apps GROUP BY 1) k
ON k.t = regexp_replace(lower(w.title), '[^a-z0-9]', '', 'g')"""


def titled_pages(spark, sf_dir):
    """All archived rows; a few have a title that no app bears."""
    title = F.when(F.col("ordinal") % 997 == 5, F.concat(F.lit("lost "), "title")).otherwise(F.col("title"))
    return view(spark, sf_dir, "fx_raw").select("page", title.alias("title")), apps(spark, sf_dir)


@query(f"SELECT page, count(*) AS n_rows, bool_and(pkg IS NOT NULL) AS ready, count(*) FILTER (pkg IS NULL) AS missing FROM ({RESOLVED}) GROUP BY page")
def r21_promotable_pages(spark, sf_dir):
    return state.promotable_pages(*titled_pages(spark, sf_dir))


@query(f"""WITH p AS (SELECT page, count(*) AS n_rows, bool_and(pkg IS NOT NULL) AS ready FROM ({RESOLVED}) GROUP BY page)
SELECT count(*) FILTER (ready) AS pages_ready, CAST(coalesce(sum(n_rows) FILTER (ready), 0) AS BIGINT) AS rows_ready, count(*) FILTER (NOT ready) AS pages_blocked, (SELECT count(DISTINCT title) FROM ({RESOLVED}) WHERE pkg IS NULL) AS missing_titles FROM p""")
def r22_promotion_survey(spark, sf_dir):
    return state.promotion_survey(*titled_pages(spark, sf_dir))


@query("""SELECT count(*) AS snapshots, count(DISTINCT keyword) AS keywords, (SELECT count(*) FROM (SELECT query FROM fx_suggestions INTERSECT SELECT keyword FROM t_slots)) AS with_page,
(SELECT count(*) FROM (SELECT query FROM fx_suggestions EXCEPT SELECT keyword FROM t_slots)) AS needed FROM (SELECT query AS keyword FROM fx_suggestions)""")
def r23_coverage_report(spark, sf_dir):
    return state.coverage_report(view(spark, sf_dir, "fx_suggestions").select(F.col("query").alias("keyword")), slots(spark, sf_dir))


@query("SELECT DISTINCT keyword FROM fx_observations WHERE featured = 1 AND keyword NOT IN (SELECT keyword FROM fx_observations WHERE source = 'review' AND position < 251)")
def r24_promoted_only_pages(spark, sf_dir):
    """Promoted keywords without a page that a reviewer has seen."""
    seen = observations(spark, sf_dir)
    return state.promoted_only_pages(seen, seen.where("source = 'review' and position < 251"))


TOP = "idx <= 10"
SUMMARY = {
    "f1_f8_field_quantiles": {
        "n": f"count(*) FILTER ({TOP})",
        **{f"installs_p{q}": f"quantile_cont(CAST(installs AS DOUBLE), 0.{q // 10}) FILTER ({TOP})" for q in (10, 50, 90)},
        "rating_p50": f"quantile_cont(rating, 0.5) FILTER ({TOP})", "reviews_p50": f"quantile_cont(CAST(reviews AS DOUBLE), 0.5) FILTER ({TOP})",
        "age_p50": f"coalesce(quantile_cont(age, 0.5) FILTER ({TOP} AND days > 0), 0)", "newest_entrant_age": f"coalesce(min(age) FILTER ({TOP} AND days > 0), 0)",
        "age_spread": f"coalesce(quantile_cont(age, 0.9) FILTER ({TOP} AND days > 0) - quantile_cont(age, 0.1) FILTER ({TOP} AND days > 0), 0)",
        "age_known_frac": f"count(*) FILTER ({TOP} AND days > 0) / CAST(greatest(count(*) FILTER ({TOP}), 1) AS DOUBLE)", "staleness_p50": f"quantile_cont(CAST(stale_days AS DOUBLE), 0.5) FILTER ({TOP})",
        "newcomers": f"count(*) FILTER ({TOP} AND days > 0 AND age <= 1)", "newcomer_installs": f"coalesce(max(installs) FILTER ({TOP} AND days > 0 AND age <= 1), 0)",
        "weakest_installs": f"min(installs) FILTER ({TOP})", "weakest_rank": f"arg_min(slot, installs * 1000 + slot) FILTER ({TOP})", "weakest_title": f"arg_min(title, installs * 1000 + slot) FILTER ({TOP})",
        "exact_match_count": f"count(*) FILTER ({TOP} AND exact)", "relevance_p50": f"quantile_cont(relevance, 0.5) FILTER ({TOP})", "relevance_drop": f"arg_min(relevance, idx) FILTER ({TOP}) - arg_max(relevance, idx) FILTER ({TOP})",
    },
    "f9_f16_intent": {
        "relevant_count": f"count(*) FILTER ({TOP} AND on_intent)", "installs_p50_relevant": f"coalesce(quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER ({TOP} AND on_intent), 0)", "no_intent": f"CASE WHEN count(*) FILTER ({TOP} AND on_intent) = 0 THEN 1 ELSE 0 END",
        "intent_cut": f"len(list_filter(list_sort(coalesce(list(slot) FILTER ({TOP} AND on_intent), [])), lambda x, i: x = i))",
        "recent_best_rank": f"coalesce(min(slot) FILTER ({TOP} AND on_intent AND days > 0 AND age <= 1), 0)", "recent_rate_at_best": f"coalesce(arg_min(rate, slot) FILTER ({TOP} AND on_intent AND days > 0 AND age <= 1), 0)",
        "neighbour_rate": f"coalesce(arg_min(rate, gap * 1000 + slot) FILTER ({TOP} AND on_intent), 0)", "neighbour_age": f"coalesce(arg_min(age, gap * 1000 + slot) FILTER ({TOP} AND on_intent), 0)",
        "recent_neighbour_rate": f"coalesce(arg_min(rate, gap * 1000 + slot) FILTER ({TOP} AND on_intent AND days > 0 AND age <= 1), 0)", "recent_neighbour_gap": f"coalesce(min(gap) FILTER ({TOP} AND on_intent AND days > 0 AND age <= 1), 0)",
    },
    "f21_f25_leader": {
        "leader_match": f"CAST(arg_min(exact, idx) FILTER ({TOP}) AS DOUBLE)", "leader_relevance": f"arg_min(relevance, idx) FILTER ({TOP})",
        "leader_lead": f"ln(1 + arg_min(installs, idx) FILTER ({TOP})) - ln(1 + coalesce(quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER ({TOP} AND idx > 1), quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER ({TOP})))",
        "first_match_rank": f"coalesce(min(idx) FILTER ({TOP} AND exact), 0)", "match_starts_below": f"greatest(coalesce(min(idx) FILTER ({TOP} AND exact), 0) - 1, 0)",
        "leader_breadth": f"arg_min(breadth, idx) FILTER ({TOP})", "breadth_gap": f"ln(1 + arg_min(breadth, idx) FILTER ({TOP})) - ln(1 + coalesce(quantile_cont(CAST(breadth AS DOUBLE), 0.5) FILTER ({TOP} AND idx > 1), quantile_cont(CAST(breadth AS DOUBLE), 0.5) FILTER ({TOP})))",
        "newest_rate": f"coalesce(arg_min(rate, days * 1000 + slot) FILTER ({TOP} AND days > 0), 0)", "newest_rank": f"coalesce(arg_min(slot, days * 1000 + slot) FILTER ({TOP} AND days > 0), 0)",
        "advantage_p90": f"quantile_cont(advantage, 0.9) FILTER ({TOP})", "advantage_p50": f"quantile_cont(advantage, 0.5) FILTER ({TOP})", "leader_advantage": f"arg_min(advantage, idx) FILTER ({TOP})",
    },
}
SETS = {"page": TOP, "intent": f"{TOP} AND on_intent", "band": "gap > 0 AND gap <= 2", "below": "slot > own_slot AND slot <= own_slot + 5"}
SUMMARY["f10_f18_rates"] = {"band_evidence": f"count(*) FILTER ({SETS['band']})"}
for _name, _set in SETS.items():
    SUMMARY["f10_f18_rates"] |= {
        f"{_name}_all": f"coalesce(quantile_cont(floor_rate, 0.5) FILTER ({_set}), 0)",
        f"{_name}_recent": f"coalesce(quantile_cont(floor_rate, 0.5) FILTER ({_set} AND days > 0 AND age <= 1), 0)",
        f"{_name}_recent_n": f"count(*) FILTER ({_set} AND days > 0 AND age <= 1)",
        f"{_name}_measured": f"coalesce(quantile_cont(measured_per_day * 365.0::DOUBLE, 0.5) FILTER ({_set}), 0)",
        f"{_name}_measured_n": f"count(measured_per_day) FILTER ({_set})",
    }


def _field_query(name: str, columns: dict[str, str]) -> None:
    def run(spark, sf_dir):
        return rounded(field.summarise(field.near_rows(ready(spark, sf_dir))).select("keyword", "own_pkg", *columns))

    run.__name__ = name
    whole = {"weakest_title", *[c for c in columns if c in ("n", "newcomers", "exact_match_count", "relevant_count", "intent_cut", "first_match_rank", "newest_rank", "leader_breadth", "weakest_rank", "weakest_installs", "newcomer_installs", "no_intent", "recent_best_rank", "recent_neighbour_gap", "match_starts_below", "band_evidence") or c.endswith("_n")]}
    query("SELECT keyword, own_pkg, " + ", ".join(f"{e} AS {c}" if c in whole else f"round({e}, 6) AS {c}" for c, e in columns.items()) + " FROM t_loo GROUP BY keyword, own_pkg")(run)


for _name, _columns in SUMMARY.items():
    _field_query(_name, _columns)


@query("SELECT keyword, pkg, slot, round(advantage, 6) AS advantage, round(rate_vs_age, 6) AS rate_vs_age FROM t_ready")
def f23_f24_advantage(spark, sf_dir):
    return rounded(ready(spark, sf_dir).select("keyword", "pkg", "slot", "advantage", "rate_vs_age"))


GROUP_COLUMNS = {**SUMMARY["f9_f16_intent"], **{k: v for k, v in SUMMARY["f10_f18_rates"].items() if k.startswith("intent_")}}
_WHOLE = ("relevant_count", "no_intent", "intent_cut", "recent_best_rank", "recent_neighbour_gap", "intent_recent_n", "intent_measured_n")
_IN_GROUPS = ", ".join((f"{e} AS {c}" if c in _WHOLE else f"round({e}, 6) AS {c}").replace("on_intent", "(own_slot % 3 = slot % 3)") for c, e in GROUP_COLUMNS.items())


@query(f"SELECT keyword, own_pkg, {_IN_GROUPS} FROM t_loo GROUP BY keyword, own_pkg")
def f9_f11_given_groups(spark, sf_dir):
    """Competition by given groups: what a page is split into decides, not relevance."""
    rows = context(spark, sf_dir)
    split = field.prepared(rows, rows.select("keyword", "pkg", (F.col("slot") % 3).alias("group")))
    return rounded(field.summarise(field.near_rows(split)).select("keyword", "own_pkg", *GROUP_COLUMNS))


@query("""WITH w AS (SELECT keyword, own_pkg, rate, 1 - advantage AS w, sum(1 - advantage) OVER (PARTITION BY keyword, own_pkg ORDER BY rate, 1 - advantage, slot ROWS UNBOUNDED PRECEDING) AS seen, sum(1 - advantage) OVER (PARTITION BY keyword, own_pkg) AS total
FROM t_loo WHERE days > 0 AND age <= 1.5)
SELECT keyword, own_pkg, round(CASE WHEN max(total) > 1e-6 THEN coalesce(min(rate) FILTER (round(seen, 9) >= round(total / 2, 9)), max(rate)) ELSE 0 END, 6) AS unaided_recent_rate, round(CASE WHEN max(total) > 1e-6 THEN max(total) ELSE 0 END, 6) AS unaided_recent_evidence FROM w GROUP BY keyword, own_pkg""")
def f26_unaided_recent(spark, sf_dir):
    return rounded(field.unaided_recent(ready(spark, sf_dir)).drop("own_slot"))


@query("""WITH p AS (SELECT keyword, own_pkg, own_slot, CAST(slot AS DOUBLE) AS x, ln(1 + days) AS z, ln(1 + rate) AS y FROM t_loo WHERE days > 0 AND installs > 0),
s AS (SELECT keyword, own_pkg, own_slot, count(*) AS m, min(z) AS young, var_pop(x) AS vx, var_pop(z) AS vz, var_pop(y) AS vy, covar_pop(x, z) AS cxz, covar_pop(x, y) AS cxy, covar_pop(z, y) AS czy, avg(x) AS ax, avg(z) AS az, avg(y) AS ay FROM p GROUP BY ALL),
b AS (SELECT *, vx * vz - cxz * cxz AS det, (cxy * vz - czy * cxz) / nullif(vx * vz - cxz * cxz, 0) AS b1, (czy * vx - cxy * cxz) / nullif(vx * vz - cxz * cxz, 0) AS b2 FROM s),
c AS (SELECT *, m >= 6 AND det > 1e-9 AS ok FROM b)
SELECT keyword, own_pkg, round(CASE WHEN ok THEN b1 ELSE 0 END, 5) AS curve_rank_slope, round(CASE WHEN ok THEN b2 ELSE 0 END, 5) AS curve_age_slope, round(CASE WHEN ok AND vy * m > 1e-9 THEN least(greatest((b1 * cxy + b2 * czy) / vy, -1), 1) ELSE 0 END, 5) AS curve_fit,
CASE WHEN ok THEN m ELSE 0 END AS curve_points FROM c""")
def f27_page_curve(spark, sf_dir):
    return rounded(field.page_curve(ready(spark, sf_dir)).drop("own_slot", "curve_here"), 5)


@query("""WITH c AS (SELECT o.keyword, a.installs, regexp_extract_all(lower(o.keyword), '[a-z0-9]+') AS kt, regexp_extract_all(lower(a.title), '[a-z0-9]+') AS tt, regexp_extract_all(lower(a.short_desc), '[a-z0-9]+') AS st, regexp_extract_all(lower(a.description), '[a-z0-9]+') AS dt
FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.featured = 1 AND o.country = 'us'),
p AS (SELECT *, list_transform(kt, lambda t: CASE WHEN list_contains(tt, t) THEN 1.0::DOUBLE WHEN list_contains(st, t) THEN 0.6::DOUBLE WHEN list_contains(dt, t) THEN 0.35::DOUBLE ELSE 0::DOUBLE END) AS per FROM c)
SELECT keyword, 1 AS has_featured, round(max(list_sum(per) / len(per) * (len(list_filter(per, lambda x: x > 0)) / len(per))), 6) AS featured_relevance, max(installs) AS featured_installs FROM p GROUP BY keyword""")
def f20_featured_summary(spark, sf_dir):
    return rounded(field.featured_summary(cards(spark, sf_dir)))


def cards(spark, sf_dir):
    from rankfield.functions.text import lexical_relevance

    rows = state.featured_apps(observations(spark, sf_dir), apps(spark, sf_dir))
    return rows.withColumn("relevance", lexical_relevance(F.col("title"), F.col("short_desc"), F.col("description"), F.col("keyword")))


@query("SELECT s.keyword, s.pkg AS own_pkg, coalesce(n, 0) AS n, coalesce(w, 99) AS weakest_rank FROM t_slots s LEFT JOIN (SELECT keyword, own_pkg, count(*) FILTER (idx <= 10) AS n, arg_min(slot, installs * 1000 + slot) FILTER (idx <= 10) AS w FROM t_loo GROUP BY keyword, own_pkg) l ON l.keyword = s.keyword AND l.own_pkg = s.pkg")
def f28_field_with_defaults(spark, sf_dir):
    return field.field_table(ready(spark, sf_dir), cards(spark, sf_dir)).select("keyword", "own_pkg", "n", "weakest_rank")


@query("SELECT query, list(suggestion ORDER BY position) AS suggestions FROM fx_suggestions GROUP BY query")
def g1_suggestion_list(spark, sf_dir):
    return suggest.suggestion_list(view(spark, sf_dir, "fx_suggestions"))


@query(f"SELECT query, date_diff('day', max(fetched_at), DATE '{AS_OF}') * 24.0::DOUBLE AS age_hours, date_diff('day', max(fetched_at), DATE '{AS_OF}') * 24 < 48 AS is_fresh FROM fx_suggestions GROUP BY query")
def g2_suggestion_age(spark, sf_dir):
    return suggest.suggestion_age(view(spark, sf_dir, "fx_suggestions"), AS_OF, 48.0)


@query("""WITH n AS (SELECT query, position, suggestion FROM fx_suggestions WHERE length(query) % 2 = 0)
SELECT query, position, suggestion, 'fetched' AS origin FROM n UNION ALL SELECT query, position, suggestion, 'stored' FROM fx_suggestions WHERE query NOT IN (SELECT query FROM n)""")
def g3_fresh_or_stale(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_suggestions").select("query", "position", "suggestion", "fetched_at")
    return suggest.fresh_or_stale(rows, rows.where("length(query) % 2 = 0"), AS_OF).drop("fetched_at")


@query("""SELECT query AS keyword, count(*) / 10.0::DOUBLE AS sugg_returned, CASE WHEN min(position) FILTER (suggestion = query) IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS sugg_self_listed,
round(coalesce(min(position) FILTER (suggestion = query) / CAST(count(*) AS DOUBLE), 1), 6) AS sugg_self_rank, CASE WHEN min(position) FILTER (suggestion = query) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sugg_is_canonical,
round(count(*) FILTER (suggestion <> query AND contains(suggestion, query)) / CAST(count(*) AS DOUBLE), 6) AS sugg_extends,
round(coalesce(avg(len(string_split(suggestion, ' ')) - len(string_split(query, ' '))) FILTER (suggestion <> query AND contains(suggestion, query)), 0), 6) AS sugg_extra_words,
round(count(*) FILTER (NOT contains(suggestion, query)) / CAST(count(*) AS DOUBLE), 6) AS sugg_unrelated FROM fx_suggestions GROUP BY query""")
def g4_suggestion_signals(spark, sf_dir):
    keywords = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("keyword"))
    return rounded(suggest.suggestion_signals(view(spark, sf_dir, "fx_suggestions"), keywords))


@query("""SELECT query, min(position) FILTER (suggestion = query) AS self_rank, coalesce(list(suggestion ORDER BY position) FILTER (suggestion <> query AND contains(suggestion, query)), []) AS extends,
coalesce(list(suggestion ORDER BY position) FILTER (NOT contains(suggestion, query)), []) AS unrelated FROM fx_suggestions GROUP BY query""")
def g5_suggestion_detail(spark, sf_dir):
    return suggest.suggestion_detail(view(spark, sf_dir, "fx_suggestions"))


SEEDS = """SELECT keyword, h || t AS seed FROM (SELECT keyword, unnest([keyword, split_part(keyword, ' ', 1)]) AS h FROM (SELECT DISTINCT p_name AS keyword FROM part)), (SELECT unnest(list_concat([''], list_transform(range(97, 123), lambda i: ' ' || chr(i::INT)))) AS t)"""
FAMILY = f"SELECT DISTINCT s.keyword, g.suggestion AS phrase FROM ({SEEDS}) s JOIN fx_suggestions g ON g.query = s.seed WHERE g.suggestion <> s.keyword"


@query(SEEDS)
def g6_expansion_seeds(spark, sf_dir):
    return suggest.expansion_seeds(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("keyword")).distinct())


def family(spark, sf_dir):
    keywords = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("keyword")).distinct()
    return suggest.harvest_family(view(spark, sf_dir, "fx_suggestions"), keywords)


@query(FAMILY)
def g7_harvest_family(spark, sf_dir):
    return family(spark, sf_dir)


@query(f"""WITH f AS ({FAMILY}) SELECT keyword, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, word) AS place FROM (SELECT keyword, split_part(phrase, ' ', 3) AS word, count(*) AS n FROM f WHERE phrase LIKE keyword || ' %' GROUP BY ALL)) WHERE place <= 12""")
def g8_next_words(spark, sf_dir):
    return suggest.next_words(family(spark, sf_dir))


@query(f"""WITH f AS ({FAMILY}) SELECT keyword, phrase, CASE WHEN starts_with(phrase, keyword || ' ') THEN 'longer' WHEN contains(phrase, keyword) THEN 'contains' WHEN starts_with(phrase, split_part(keyword, ' ', 1) || ' ') OR phrase = split_part(keyword, ' ', 1) THEN 'siblings' ELSE 'other' END AS kind FROM f""")
def g9_partition_family(spark, sf_dir):
    return suggest.partition_family(family(spark, sf_dir))


@query("SELECT keyword, country, observed_at, n_apps, round(installs_p50, 6) AS installs_p50, round(installs_p90, 6) AS installs_p90, round(rating_p50, 6) AS rating_p50, exact_match, newcomers, round(age_p50, 6) AS age_p50, round(velocity_p50, 6) AS velocity_p50, round(age_known_frac, 6) AS age_known_frac FROM t_states")
def h1_field_states(spark, sf_dir):
    return rounded(states(spark, sf_dir))


@query("SELECT keyword, country, observed_at, n_apps FROM t_states")
def h2_field_series(spark, sf_dir):
    return change.field_series(states(spark, sf_dir)).select("keyword", "country", "observed_at", "n_apps")


@query(f"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY observed_at) AS r FROM t_states WHERE installs_p50 IS NOT NULL AND country = 'us') WHERE r = 1),
d AS (SELECT o.keyword, count(*) FILTER (slot <= n) AS n, quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (slot <= n) AS p50, coalesce(quantile_cont(age, 0.5) FILTER (slot <= n AND days > 0), 0) AS age_p50, coalesce(quantile_cont(floor_rate, 0.5) FILTER (slot <= n AND days > 0), 0) AS v,
  count(*) FILTER (slot <= n AND days > 0) / CAST(count(*) FILTER (slot <= n) AS DOUBLE) AS k, count(*) FILTER (slot <= 10 AND exact) AS m
  FROM (SELECT keyword, CASE WHEN n_apps > 0 AND n_apps < 10 THEN n_apps ELSE 10 END AS n FROM o) o JOIN t_context c ON c.keyword = o.keyword GROUP BY o.keyword),
j AS (SELECT d.*, o.n_apps, o.installs_p50, o.exact_match, o.age_p50 AS oage, o.velocity_p50 AS ov, o.age_known_frac AS ok, date_diff('day', o.observed_at, DATE '{AS_OF}') AS days, date_diff('day', o.observed_at, DATE '{AS_OF}') / 365.0::DOUBLE AS y, log10(p50 + 1) - log10(o.installs_p50 + 1) AS i,
  oage IS NOT NULL AND ok >= 0.5 AND k >= 0.5 AS dated FROM d JOIN o ON o.keyword = d.keyword)
SELECT keyword, CASE WHEN days >= 60 THEN 1.0 ELSE 0.0 END::DOUBLE AS hist_known, round(CASE WHEN days >= 60 THEN least(y, 3) ELSE 0 END, 6) AS hist_age_days, round(CASE WHEN days >= 60 THEN i ELSE 0 END, 6) AS hist_installs_delta,
round(CASE WHEN days >= 60 THEN (n - n_apps) / CAST(greatest(n_apps, 1) AS DOUBLE) ELSE 0 END, 6) AS hist_size_delta, round(CASE WHEN days >= 60 THEN (m - exact_match) / CAST(greatest(exact_match, 1) AS DOUBLE) ELSE 0 END, 6) AS hist_match_delta,
round(CASE WHEN days >= 60 THEN i / greatest(y, 0.08) ELSE 0 END, 6) AS hist_hardening, CASE WHEN days >= 60 AND dated THEN 1.0 ELSE 0.0 END::DOUBLE AS hist_dated, round(CASE WHEN days >= 60 AND dated THEN (y - (age_p50 - oage)) / greatest(y, 0.08) ELSE 0 END, 6) AS hist_renewal,
round(CASE WHEN days >= 60 AND dated AND ov > 0 AND v > 0 THEN log10(v + 1) - log10(ov + 1) ELSE 0 END, 6) AS hist_velocity_delta FROM j""")
def h3_h5_field_deltas(spark, sf_dir):
    return rounded(change.field_deltas(states(spark, sf_dir), context(spark, sf_dir), AS_OF))


@query("SELECT keyword, country, observed_at, round(age_p50, 6) AS age_p50, newcomers, round(age_known_frac, 6) AS age_known_frac FROM (SELECT o.keyword, o.country, o.observed_at, quantile_cont(d / 365.0::DOUBLE, 0.5) AS age_p50, count(*) FILTER (d / 365.0 <= 1) AS newcomers, count(d) / CAST(count(*) AS DOUBLE) AS age_known_frac FROM (SELECT o.keyword, o.country, o.observed_at, CASE WHEN a.released_at < o.observed_at THEN date_diff('day', a.released_at, o.observed_at) END AS d FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg) o GROUP BY ALL) WHERE age_p50 IS NOT NULL")
def h6_backfill_ages(spark, sf_dir):
    """States of which the ages were lost, filled again from the observations."""
    blank = observations(spark, sf_dir).groupBy("keyword", "country", "observed_at").agg(F.lit(None).cast("double").alias("age_p50"), F.lit(None).cast("double").alias("velocity_p50"), F.lit(None).cast("long").alias("newcomers"), F.lit(None).cast("double").alias("age_known_frac"))
    filled = change.backfill_ages(blank, observations(spark, sf_dir), apps(spark, sf_dir)).where("age_p50 is not null")
    return rounded(filled.select("keyword", "country", "observed_at", "age_p50", "newcomers", "age_known_frac"))


@query("SELECT keyword, country, observed_at, round(quantile_cont(d / 365.0::DOUBLE, 0.5), 6) AS age_p50, count(*) FILTER (d / 365.0 <= 1) AS newcomers, round(count(d) / CAST(count(*) AS DOUBLE), 6) AS age_known_frac FROM (SELECT o.keyword, o.country, o.observed_at, CASE WHEN a.released_at < o.observed_at THEN date_diff('day', a.released_at, o.observed_at) END AS d FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.position < 251) GROUP BY ALL")
def h7_archive_age_stats(spark, sf_dir):
    rows = observations(spark, sf_dir).where("position < 251").join(apps(spark, sf_dir).select("pkg", "released_at"), "pkg")
    return rounded(change.archive_age_stats(rows, ["keyword", "country", "observed_at"]))


@query(f"""WITH s AS (SELECT lower(page) AS keyword, pkg, coalesce({COMPACT.format('installs_text')}, 0) AS n FROM fx_raw), j AS (SELECT s.keyword, s.n, CASE WHEN a.released_at < DATE '{AS_OF}' THEN date_diff('day', a.released_at, DATE '{AS_OF}') END AS d FROM s LEFT JOIN fx_apps a ON a.pkg = s.pkg),
c AS (SELECT keyword, count(*) AS n_apps, quantile_cont(CAST(n AS DOUBLE), 0.5) AS installs_p50, quantile_cont(CAST(n AS DOUBLE), 0.9) AS installs_p90, quantile_cont(d / 365.0::DOUBLE, 0.5) AS age_p50, count(*) FILTER (d / 365.0 <= 1) AS newcomers, count(d) / CAST(count(*) AS DOUBLE) AS age_known_frac FROM j GROUP BY keyword)
SELECT keyword, 'us' AS country, DATE '{AS_OF}' AS observed_at, 'research' AS source, n_apps, round(installs_p50, 6) AS installs_p50, round(installs_p90, 6) AS installs_p90, round(age_p50, 6) AS age_p50, newcomers, round(age_known_frac, 6) AS age_known_frac FROM c
UNION ALL SELECT keyword, country, observed_at, 'scrape', n_apps, round(installs_p50, 6), round(installs_p90, 6), round(age_p50, 6), newcomers, round(age_known_frac, 6) FROM t_states""")
def h8_load_sessions(spark, sf_dir):
    """Session documents to field history, beside the states that it holds."""
    pages = ingest.extract_session_pages(spark, sessions(spark, sf_dir)).withColumns({"country": F.lit("us"), "observed_at": F.lit(AS_OF).cast("date")})
    dated = pages.hint("merge").join(apps(spark, sf_dir).select("pkg", "released_at"), "pkg", "left")
    columns = ["keyword", "country", "observed_at", "source", "n_apps", "installs_p50", "installs_p90", "age_p50", "newcomers", "age_known_frac"]
    old = states(spark, sf_dir).withColumn("source", F.lit("scrape")).select(*columns).withColumn("version", F.lit(0))
    new = change.session_states(dated).select(*columns).withColumn("version", F.lit(1))
    return rounded(ingest.upsert(old, new, ["keyword", "country", "observed_at"], "version").drop("version"))


@query("SELECT * FROM t_events")
def h9_h10_transitions(spark, sf_dir):
    return change.transitions(observations(spark, sf_dir), apps(spark, sf_dir))


@query("SELECT count(*) AS transitions, count(*) FILTER (event = 'entered') AS entered, count(*) FILTER (event = 'left') AS left_page, count(*) FILTER (event = 'moved') AS moved, count(*) FILTER (is_new) AS new_app_entries, count(*) FILTER (is_new AND to_position <= 10) AS new_app_reached_top10, (SELECT coalesce(string_agg(keyword || ' ' || strftime(observed_at, '%Y-%m-%d') || ' ' || pkg || ' ' || to_position, ', ' ORDER BY keyword, observed_at, pkg), '') FROM (SELECT * FROM t_events WHERE is_new ORDER BY keyword, observed_at, pkg LIMIT 6)) AS examples FROM t_events")
def h11_transition_summary(spark, sf_dir):
    found = change.transition_summary(change.transitions(observations(spark, sf_dir), apps(spark, sf_dir)))
    return found.withColumn("examples", F.array_join("examples", ", "))


OUTCOMES = "SELECT keyword, CASE WHEN min(position) < 251 THEN min(position) END AS position FROM fx_observations WHERE country = 'us' AND (source IN ('owned', 'review') OR pkg IN (SELECT pkg FROM fx_apps WHERE developer LIKE 'Brand#1%' OR developer LIKE 'Brand#22%')) GROUP BY keyword"


@query(OUTCOMES)
def h12_outcomes(spark, sf_dir):
    return change.outcomes(observations(spark, sf_dir), apps(spark, sf_dir), ("Brand#1%", "Brand#22%"))


@query("SELECT keyword, count(DISTINCT observed_at) AS days, min(observed_at) AS first, max(observed_at) AS last, date_diff('day', min(observed_at), max(observed_at)) AS gap_days FROM fx_observations GROUP BY keyword HAVING count(DISTINCT observed_at) > 1 AND date_diff('day', min(observed_at), max(observed_at)) >= 7")
def h13_snapshot_pairs(spark, sf_dir):
    return change.snapshot_pairs(observations(spark, sf_dir))


def research(spark, sf_dir):
    rows = slots(spark, sf_dir).groupBy("keyword").agg(F.to_json(F.collect_list(F.struct(F.format_number("installs", 0).alias("installs")))).alias("sample"), F.concat(F.count_if(F.col("slot") % 3 == 0).cast("string"), F.lit("/"), F.count("*").cast("string")).alias("hits"))
    return change.research_before(rows)


@query("SELECT keyword, count(*) AS n_apps, round(count(*) FILTER (slot % 3 = 0) / CAST(count(*) AS DOUBLE), 6) AS title_hit_rate, quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (installs > 0) AS installs_median FROM t_slots GROUP BY keyword")
def h14_research_before(spark, sf_dir):
    return rounded(research(spark, sf_dir))


@query(f"""WITH b AS (SELECT keyword, quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (installs > 0) AS m FROM t_slots GROUP BY keyword), o AS ({OUTCOMES}), j AS (SELECT b.*, coalesce(o.position <= 10, false) AS hit FROM b JOIN o ON o.keyword = b.keyword)
SELECT count(*) AS pairs, count(*) FILTER (hit) AS ranked, count(*) FILTER (NOT hit) AS missed, round(quantile_cont(m, 0.5) FILTER (hit), 6) AS median_when_ranked, round(quantile_cont(m, 0.5) FILTER (NOT hit), 6) AS median_when_missed, coalesce(array_to_string(list_sort(list(keyword) FILTER (hit))[1:6], ','), '') AS examples_ranked, coalesce(array_to_string(list_sort(list(keyword) FILTER (NOT hit))[1:6], ','), '') AS examples_missed FROM j""")
def h15_backtest(spark, sf_dir):
    after = change.outcomes(observations(spark, sf_dir), apps(spark, sf_dir), ("Brand#1%", "Brand#22%"))
    found = rounded(change.backtest(research(spark, sf_dir), after))
    return found.withColumns({c: F.array_join(c, ",") for c in ("examples_ranked", "examples_missed")})


def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field statistic of every (keyword, own app), with the page's change counts."""
    moved = change.transitions(observations(spark, sf_dir), apps(spark, sf_dir)).groupBy("keyword").agg(F.count_if(F.col("event") == "entered").alias("entered"), F.count_if(F.col("event") == "left").alias("left_page"), F.count_if(F.col("event") == "moved").alias("moved"))
    return field.field_table(ready(spark, sf_dir), cards(spark, sf_dir)).join(moved, "keyword", "left")
