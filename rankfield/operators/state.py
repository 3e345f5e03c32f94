"""Relational state: latest pages, dense slots and what hangs on them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions import text as tx
from rankfield.operators.evaluate import grouped_percentiles

ABSENT = 251
YEAR_S = 31_557_600


def days_since(date: Column, ref: Column) -> Column:
    """Whole days from ``date`` to ``ref``, at least 0; unknown is 0."""
    return F.coalesce(F.greatest(F.datediff(ref, date), F.lit(0)), F.lit(0))


def of_country(observations: DataFrame, country: str | None) -> DataFrame:
    """The rows of ``country``; a table without that column is one country's."""
    return observations if country is None or "country" not in observations.columns else observations.where(F.col("country") == country)


def newest_first(observations: DataFrame) -> list[Column]:
    """Later rows first: of one time the last one written (``id``) where that is known,
    else a reviewer's row, then a fetched page's, then a check of an own app."""
    if "id" in observations.columns:
        return [F.desc("observed_at"), F.desc("id")]
    rank = F.when(F.col("source") == "review", 0).when(F.col("source") == "serp", 1).when(F.col("source") == "owned", 2).otherwise(3)
    return [F.desc("observed_at"), rank, F.col("source")]


def latest_observations(observations: DataFrame, apps: DataFrame, country: str | None = "us") -> DataFrame:
    """Newest ranked row of each (keyword, country, app), joined to the app.

    ``country`` None keeps all countries, each with pages of its own.
    """
    observations = of_country(observations, country)
    newest = Window.partitionBy("keyword", "country", "pkg").orderBy(*newest_first(observations))
    seen = observations.where("position is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return seen.join(apps, "pkg")


def featured_apps(observations: DataFrame, apps: DataFrame, country: str | None = "us") -> DataFrame:
    """Newest promoted row of each (keyword, country, app)."""
    observations = of_country(observations, country)
    newest = Window.partitionBy("keyword", "country", "pkg").orderBy(*newest_first(observations))
    cards = observations.where("featured = 1").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "position")
    return cards.join(apps, "pkg")


def ranked_fields(observations: DataFrame, apps: DataFrame, mode: str = "default", country: str | None = "us") -> DataFrame:
    """Every page of a country with dense slots 1..n in place of the stored position.

    A page is a (keyword, country). What is built on slots reads one country's pages.

    ``default`` leaves out rows that were checked and found absent; ``reference`` gives
    them slots at the end.
    """
    rows = latest_observations(observations, apps, country)
    if mode == "default":
        rows = rows.where(F.col("position") < ABSENT)
    order = Window.partitionBy("keyword", "country").orderBy("position", (F.col("source") != "review").cast("int"), F.desc("installs"), "pkg")
    return rows.withColumn("slot", F.row_number().over(order))


def measured_growth(snapshots: DataFrame, min_days: int = 7) -> DataFrame:
    """Installs gained a day between the least and the most seen; needs two dated rows."""
    span = snapshots.where("installs is not null").groupBy("pkg").agg(F.min("installs").alias("_lo"), F.max("installs").alias("_hi"), F.count("*").alias("_n"), F.datediff(F.max("observed_at"), F.min("observed_at")).alias("_days"))
    return span.where((F.col("_n") > 1) & (F.col("_days") >= min_days)).select("pkg", ((F.col("_hi") - F.col("_lo")) / F.col("_days")).alias("measured_per_day"))


def age_rate_norms(apps: DataFrame, as_of: str, min_apps: int = 20) -> DataFrame:
    """Median installs a year for each year of age, over the whole corpus.

    There are at most 22 ages, however many apps: their medians are exact and no task
    sees the apps of a whole age.
    """
    years = F.datediff(F.lit(as_of).cast("date"), "released_at") * F.lit(86400.0) / F.lit(float(YEAR_S))
    aged = apps.where("installs > 0 and released_at is not null").withColumn("_age", years).where("_age > 0")
    rates = aged.select(F.expr("width_bucket(_age, 0, 20, 20)").alias("bucket"), (F.col("installs") / F.greatest("_age", F.lit(0.25))).alias("_rate"))
    return grouped_percentiles(rates, "bucket", F.col("_rate"), [0.5]).where(F.col("n") >= min_apps).select("bucket", F.get("values", 0).alias("rate"), "n")


def norm_for_age(rows: DataFrame, norms: DataFrame, age: str = "age", key: str = "pkg") -> DataFrame:
    """The norm of the nearest age bucket (lower on ties) as ``age_norm``; 0 without an age.

    ``norms`` has one row for each of at most 22 buckets, so it is broadcast.
    """
    packed = norms.agg(F.sort_array(F.collect_list(F.struct("bucket", "rate"))).alias("_norms"))
    wanted = F.least(F.greatest(F.floor(age).cast("int") + 1, F.lit(1)), F.lit(20))
    near = F.array_min(F.transform("_norms", lambda x: F.struct(F.abs(x["bucket"] - wanted).alias("gap"), x["bucket"].alias("bucket"), x["rate"].alias("rate"))))
    return rows.crossJoin(F.broadcast(packed)).withColumn("age_norm", F.when(F.col(age) > 0, F.coalesce(near["rate"], F.lit(0.0))).otherwise(0.0)).drop("_norms")


def keyword_breadth(observations: DataFrame) -> DataFrame:
    """Distinct keywords an app is seen under, in any country."""
    return observations.where("position is not null").groupBy("pkg").agg(F.count_distinct("keyword").alias("breadth"))


def breadth_sketches(observations: DataFrame, log_registers: int = 12) -> DataFrame:
    """(pkg, observed_at, sketch): a HyperLogLog sketch of each app's keywords, day by day.

    A day's sketches are written once; any span of days is a union of theirs.
    """
    return observations.where("position is not null").groupBy("pkg", "observed_at").agg(F.hll_sketch_agg("keyword", log_registers).alias("sketch"))


def sketched_breadth(sketches: DataFrame) -> DataFrame:
    """Breadth of each app from sketches of any days, merged; relative error about 1.04 / sqrt(2^log_registers)."""
    return sketches.groupBy("pkg").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("breadth"))


def attach_meaning(rows: DataFrame, keyword_vectors: DataFrame, app_vectors: DataFrame) -> DataFrame:
    """Slots with ``cosine`` to the keyword, ``relevance`` blended with the meaning, and
    the cosines to the first and second app of the page."""
    known = rows.join(app_vectors.select("pkg", "vector"), "pkg", "left").join(keyword_vectors.select("keyword", "keyword_vector"), "keyword", "left")
    lead = known.groupBy("keyword").agg(*[F.first(F.when(F.col("slot") == n, F.col("vector")), ignorenulls=True).alias(f"_lead{n}") for n in (1, 2)])
    out = known.join(lead, "keyword")
    to = lambda n: tx.cosine(F.col("vector"), F.col(f"_lead{n}"))
    blended = tx.blended_relevance(F.col("lexical"), F.col("keyword_vector"), F.col("vector"))
    return out.withColumns({"relevance": blended, "cosine": tx.cosine(F.col("keyword_vector"), F.col("vector")), "sim_first": to(1), "sim_second": to(2)}).drop("vector", "keyword_vector", "_lead1", "_lead2")


def attach_context(
    fields: DataFrame, snapshots: DataFrame, observations: DataFrame, apps: DataFrame, as_of: str, keyword_vectors: DataFrame | None = None, app_vectors: DataFrame | None = None
) -> DataFrame:
    """Slots with growth, breadth, ages, rates, relevance and the age norm."""
    ref = F.lit(as_of).cast("date")
    rows = fields.join(measured_growth(snapshots), "pkg", "left").join(keyword_breadth(observations), "pkg", "left")
    rows = rows.withColumn("breadth", F.coalesce("breadth", F.lit(0).cast("long"))).withColumn("days", days_since(F.col("released_at"), ref)).withColumn("stale_days", days_since(F.col("updated_at"), ref))
    rows = rows.withColumn("age", F.col("days") / 365.0)
    rows = rows.withColumn("rate", F.when(F.col("days") > 0, F.col("installs") / F.greatest("age", F.lit(1 / 365.0))).otherwise(0.0))
    rows = rows.withColumn("floor_rate", F.when(F.col("days") > 0, F.col("installs") / F.greatest("age", F.lit(0.25))))
    rows = rows.withColumn("lexical", tx.lexical_relevance(F.col("title"), F.col("short_desc"), F.col("description"), F.col("keyword")))
    rows = rows.withColumn("relevance", F.col("lexical")) if keyword_vectors is None or app_vectors is None else attach_meaning(rows, keyword_vectors, app_vectors)
    rows = rows.withColumn("exact", tx.exact_match(F.col("title"), F.col("keyword")))
    return norm_for_age(rows, age_rate_norms(apps, as_of))


def page_age(observations: DataFrame, as_of: str) -> DataFrame:
    return observations.groupBy("keyword").agg(F.datediff(F.lit(as_of).cast("date"), F.max("observed_at")).alias("age_days"))


def keyword_catalogue(observations: DataFrame) -> DataFrame:
    return observations.groupBy("keyword").agg(F.max("observed_at").alias("last_seen"), F.count_distinct("pkg").alias("n_apps")).orderBy("last_seen", "keyword")


def status_counts(apps: DataFrame, observations: DataFrame, corrections: DataFrame | None = None, residuals: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One row of counts; corrections, live residuals and overrides of the tables that are given."""
    seen = observations.agg(F.count_distinct("keyword").alias("keywords"), F.count_if(F.col("position") < ABSENT).alias("ranked_rows"), F.count_if(F.col("featured") == 1).alias("promoted_rows"))
    out = apps.agg(F.count("*").alias("apps")).crossJoin(seen)
    if corrections is not None:
        out = out.crossJoin(corrections.agg(F.count("*").alias("corrections"), F.count_if(F.col("status") == "queued").alias("queued_corrections")))
    if residuals is not None:
        out = out.crossJoin(residuals.agg(F.count_if(F.col("retired_at").isNull()).alias("live_residuals")))
    return out if overrides is None else out.crossJoin(overrides.agg(F.count("*").alias("overrides")))


def due_keywords(observations: DataFrame, as_of: str, every_days: int = 7) -> DataFrame:
    return page_age(observations, as_of).where(F.col("age_days") >= every_days)


def pending_targets(targets: DataFrame, observations: DataFrame, as_of: str, fresh_days: int) -> DataFrame:
    """Targets never seen, or last seen at least ``fresh_days`` ago."""
    joined = targets.join(page_age(observations, as_of), "keyword", "left")
    return joined.where(F.col("age_days").isNull() | (F.col("age_days") >= fresh_days))


def publisher_catalogue(apps: DataFrame, developer: str) -> DataFrame:
    return apps.where((F.trim("developer") != "") & (F.col("developer") == developer)).select("pkg", "title", "installs")


def snapshot_times(observations: DataFrame) -> DataFrame:
    return observations.select("keyword", "observed_at").distinct().orderBy("keyword", "observed_at")


def page_at(observations: DataFrame, apps: DataFrame, observed_at: str) -> DataFrame:
    rows = observations.where((F.col("observed_at") == F.lit(observed_at).cast("date")) & F.col("position").isNotNull())
    return rows.join(apps.select("pkg", "title", "installs"), "pkg")


def publish_page(fields: DataFrame, cards: DataFrame) -> DataFrame:
    """Promoted cards first, then the organic page, with a running position."""
    columns = ["keyword", "pkg", "title", "installs"]
    top = cards.select(*columns, F.lit(None).cast("int").alias("organic_position"), F.lit(1).alias("promoted"))
    page = top.unionByName(fields.select(*columns, F.col("slot").alias("organic_position"), F.lit(0).alias("promoted")))
    order = Window.partitionBy("keyword").orderBy(F.desc("promoted"), "organic_position", "pkg")
    return page.withColumn("position", F.row_number().over(order)).withColumn("exact", tx.exact_match(F.col("title"), F.col("keyword")))


def match_targets(keywords: DataFrame, own: DataFrame, least: float = 0.6) -> DataFrame:
    """Best own app for each keyword by the share of its tokens in the title."""
    wanted = keywords.select("keyword", F.size(F.array_distinct(tx.tokens(F.col("keyword")))).alias("_n"), F.explode(F.array_distinct(tx.tokens(F.col("keyword")))).alias("_t"))
    held = own.select("pkg", "title", F.explode(F.array_distinct(tx.tokens(F.col("title")))).alias("_t"))
    shares = wanted.join(held.hint("merge"), "_t").groupBy("keyword", "_n", "pkg", "title").agg(F.count("*").alias("_hits")).withColumn("share", F.col("_hits") / F.col("_n"))
    order = Window.partitionBy("keyword").orderBy(F.desc("share"), "pkg")
    return shares.where(F.col("share") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("keyword", "pkg", "title", "share")


def record_absence(targets: DataFrame, fields: DataFrame, as_of: str) -> DataFrame:
    """Targets whose app is not on its page, as observations that it is absent."""
    missing = targets.select("keyword", "pkg").join(fields.select("keyword", "pkg"), ["keyword", "pkg"], "left_anti")
    return missing.select("keyword", F.lit("us").alias("country"), "pkg", F.lit(ABSENT).cast("long").alias("position"), F.lit("owned").alias("source"), F.lit(0).alias("featured"), F.lit(as_of).cast("date").alias("observed_at"))


def resolve_titles(pages: DataFrame, apps: DataFrame) -> DataFrame:
    """Page rows (page, title) with the lowest package of the same normalised title."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    known = apps.groupBy(plain(F.col("title")).alias("_t")).agg(F.min("pkg").alias("pkg"))
    return pages.withColumn("_t", plain(F.col("title"))).join(known, "_t", "left").drop("_t")


def promotable_pages(pages: DataFrame, apps: DataFrame) -> DataFrame:
    """Per page: rows, whether every title resolves, titles that do not."""
    return resolve_titles(pages, apps).groupBy("page").agg(F.count("*").alias("n_rows"), F.bool_and(F.col("pkg").isNotNull()).alias("ready"), F.count_if(F.col("pkg").isNull()).alias("missing"))


def promotion_survey(pages: DataFrame, apps: DataFrame) -> DataFrame:
    rows = promotable_pages(pages, apps)
    missing = resolve_titles(pages, apps).where("pkg is null").agg(F.count_distinct("title").alias("missing_titles"))
    return rows.agg(F.count_if("ready").alias("pages_ready"), F.coalesce(F.sum(F.when(F.col("ready"), F.col("n_rows"))), F.lit(0)).alias("rows_ready"), F.count_if(~F.col("ready")).alias("pages_blocked")).crossJoin(missing)


def coverage_report(archived: DataFrame, current: DataFrame) -> DataFrame:
    """Archived keywords, those with a current page, those still needed."""
    had, now = archived.select("keyword").distinct(), current.select("keyword").distinct()
    counts = archived.agg(F.count("*").alias("snapshots"), F.count_distinct("keyword").alias("keywords"))
    return counts.crossJoin(had.intersect(now).agg(F.count("*").alias("with_page"))).crossJoin(had.exceptAll(now).agg(F.count("*").alias("needed")))


def promoted_only_pages(observations: DataFrame, fields: DataFrame) -> DataFrame:
    cards = observations.where("featured = 1").select("keyword").distinct()
    return cards.join(fields.select("keyword").distinct(), "keyword", "left_anti")
