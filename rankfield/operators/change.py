"""Pages over time: states, deltas, transitions and outcomes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions import text as tx
from rankfield.operators.evaluate import exact_percentiles
from rankfield.operators.state import ABSENT, days_since, of_country

NEW_APP_YEARS = 1.5


def field_states(observations: DataFrame, apps: DataFrame) -> DataFrame:
    """Page state at each observation date, ages measured at that date."""
    rows = observations.where(F.col("position").isNotNull() & (F.col("position") < ABSENT)).join(apps, "pkg")
    rows = rows.withColumn("_days", days_since(F.col("released_at"), F.col("observed_at"))).withColumn("_age", F.col("_days") / 365.0)
    top = F.col("position") <= 10
    known = top & (F.col("_days") > 0)
    q = lambda c, where, x: F.percentile(F.when(where, c), F.lit(x))
    return rows.groupBy("keyword", "country", "observed_at").agg(
        F.count_if(top).alias("n_apps"), q(F.col("installs").cast("double"), top, 0.5).alias("installs_p50"), q(F.col("installs").cast("double"), top, 0.9).alias("installs_p90"),
        q(F.col("rating"), top, 0.5).alias("rating_p50"), F.count_if(top & tx.exact_match(F.col("title"), F.col("keyword"))).alias("exact_match"),
        F.count_if(known & (F.col("_age") <= 1.0)).alias("newcomers"), q(F.col("_age"), known, 0.5).alias("age_p50"),
        F.coalesce(q(F.col("installs") / F.greatest(F.col("_age"), F.lit(0.25)), known, 0.5), F.lit(0.0)).alias("velocity_p50"),
        (F.count_if(known) / F.greatest(F.count_if(top), F.lit(1))).alias("age_known_frac"),
    )


def field_series(states: DataFrame) -> DataFrame:
    return states.orderBy("keyword", "observed_at")


def depth_match(slots: DataFrame, depths: DataFrame, top_n: int = 10) -> DataFrame:
    """Today's page re-measured over its top n slots, n from ``depths`` (keyword, n);
    ``matches_in_full`` counts exact titles over ``top_n`` slots whatever n."""
    rows = slots.select("keyword", "slot", "installs", "age", "days", "floor_rate", "exact").join(depths, "keyword").where((F.col("slot") <= F.col("n")) | (F.col("slot") <= top_n))
    yes = F.col("slot") <= F.col("n")
    known = yes & (F.col("days") > 0)
    q = lambda c, where, x: F.percentile(F.when(where, c), F.lit(x))
    return rows.groupBy("keyword").agg(
        F.count_if(yes).alias("n"), q(F.col("installs").cast("double"), yes, 0.5).alias("installs_p50"), q(F.col("installs").cast("double"), yes, 0.9).alias("installs_p90"),
        F.coalesce(q(F.col("age"), known, 0.5), F.lit(0.0)).alias("age_p50"), F.coalesce(q(F.col("floor_rate"), known, 0.5), F.lit(0.0)).alias("velocity_p50"),
        (F.count_if(known) / F.count_if(yes)).alias("age_known_frac"), F.count_if(known & (F.col("age") <= 1.0)).alias("newcomers"), F.count_if(yes & F.col("exact")).alias("exact_match_count"),
        F.count_if((F.col("slot") <= top_n) & F.col("exact")).alias("matches_in_full"),
    )


def field_deltas(states: DataFrame, slots: DataFrame, as_of: str, min_days: int = 60, top_n: int = 10, country: str | None = "us") -> DataFrame:
    """Oldest state with installs against today, today cut to the older page's depth."""
    first = Window.partitionBy("keyword").orderBy("observed_at")
    old = of_country(states, country).where("installs_p50 is not null").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    depth = F.when((F.col("n_apps") > 0) & (F.col("n_apps") < top_n), F.col("n_apps")).otherwise(top_n)
    today = depth_match(slots, old.select("keyword", depth.alias("n")), top_n)
    o = old.select("keyword", *[F.col(c).alias(f"o_{c}") for c in old.columns if c not in ("keyword", "country")])
    days = F.datediff(F.lit(as_of).cast("date"), "o_observed_at")
    j = today.join(o, "keyword").withColumn("_days", days).withColumn("_years", F.col("_days") / 365.0)
    lg = lambda c: F.log10(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + 1)
    one = lambda c: F.greatest(F.coalesce(F.nullif(c, F.lit(0).cast("long")), F.lit(1)), F.lit(1))
    dated = F.col("o_age_p50").isNotNull() & F.col("age_p50").isNotNull() & (F.col("o_age_known_frac") >= 0.5) & (F.col("age_known_frac") >= 0.5)
    old_enough = F.col("_days") >= min_days
    installs = lg("installs_p50") - lg("o_installs_p50")
    values = {
        "hist_known": F.lit(1.0),
        "hist_age_days": F.least(F.col("_years"), F.lit(3.0)),
        "hist_installs_delta": installs,
        "hist_size_delta": (F.col("n") - F.col("o_n_apps")) / one(F.col("o_n_apps")),
        "hist_match_delta": (F.col("matches_in_full") - F.col("o_exact_match")) / one(F.col("o_exact_match")),
        "hist_hardening": installs / F.greatest("_years", F.lit(0.08)),
        "hist_dated": F.when(dated, 1.0).otherwise(0.0),
        "hist_renewal": F.when(dated, (F.col("_years") - (F.col("age_p50") - F.col("o_age_p50"))) / F.greatest("_years", F.lit(0.08))).otherwise(0.0),
        "hist_velocity_delta": F.when(dated & (F.col("o_velocity_p50") > 0) & (F.col("velocity_p50") > 0), lg("velocity_p50") - lg("o_velocity_p50")).otherwise(0.0),
    }
    return j.select("keyword", *[F.when(old_enough, v).otherwise(0.0).alias(k) for k, v in values.items()])


def backfill_ages(states: DataFrame, observations: DataFrame, apps: DataFrame) -> DataFrame:
    """States that lack ages get them from the observations of that date."""
    blank = states.where("age_p50 is null").select("keyword", "country", "observed_at")
    rows = observations.join(blank, ["keyword", "country", "observed_at"]).join(apps.select("pkg", "released_at", "installs"), "pkg")
    rows = rows.withColumn("_days", days_since(F.col("released_at"), F.col("observed_at"))).withColumn("_age", F.when(F.col("_days") > 0, F.col("_days") / 365.0))
    new = rows.groupBy("keyword", "country", "observed_at").agg(
        F.percentile("_age", 0.5).alias("_a"), F.percentile(F.when(F.col("installs") > 0, F.col("installs") / F.greatest("_age", F.lit(0.25))), 0.5).alias("_v"),
        F.count_if(F.col("_age") <= 1.0).alias("_n"), (F.count("_age") / F.count("*")).alias("_k"),
    ).where("_a is not null")
    joined = states.join(new, ["keyword", "country", "observed_at"], "left")
    pairs = {"age_p50": "_a", "velocity_p50": "_v", "newcomers": "_n", "age_known_frac": "_k"}
    return joined.select(*[F.when(F.col("_a").isNotNull(), F.col(pairs[c])).otherwise(F.col(c)).alias(c) if c in pairs else F.col(c) for c in states.columns])


def session_states(pages: DataFrame, day: str = "observed_at") -> DataFrame:
    """Field history of archived session pages: one state of each (keyword, country, day).

    ``pages`` has a row for each app of a page: doc, path, keyword, country, the day,
    installs and released_at. Of several copies of a page the widest stays. Installs
    that the page does not tell count as none; ages are those at the page's own day.
    """
    sized = pages.withColumn("n_apps", F.count("*").over(Window.partitionBy("doc", "path")))
    copy = Window.partitionBy("keyword", "country", day).orderBy(F.desc("n_apps"), "doc", "path")
    widest = sized.withColumn("_first", F.first(F.struct("doc", "path")).over(copy)).where(F.struct("doc", "path") == F.col("_first"))
    counts = F.coalesce("installs", F.lit(0).cast("long")).cast("double")
    rows = widest.withColumn("observed_at", F.col(day))
    states = rows.groupBy("keyword", "country", "observed_at").agg(F.count("*").alias("n_apps"), F.percentile(counts, 0.5).alias("installs_p50"), F.percentile(counts, 0.9).alias("installs_p90"), *age_stats())
    return states.withColumnRenamed("observed_at", day).withColumns({"rating_p50": F.lit(None).cast("double"), "exact_match": F.lit(None).cast("long"), "source": F.lit("research")})


def age_stats() -> list[Column]:
    """Of rows with released_at and observed_at: median age, newcomers, share of known ages; releases after the day do not count."""
    days = F.when(F.col("released_at") <= F.col("observed_at"), F.datediff("observed_at", "released_at"))
    age = F.when(days > 0, days / 365.0)
    return [F.percentile(age, 0.5).alias("age_p50"), F.count_if(age <= 1.0).alias("newcomers"), (F.count(age) / F.count("*")).alias("age_known_frac")]


def archive_age_stats(rows: DataFrame, key: tuple[str, ...] | list[str] = ("keyword", "observed_at")) -> DataFrame:
    """Ages of archived page rows at their own date; releases after it do not count."""
    return rows.groupBy(*key).agg(*age_stats())


def consecutive_snapshots(observations: DataFrame, min_gap: int = 3) -> DataFrame:
    """(keyword, older, newer, gap_days) of neighbouring snapshots far enough apart."""
    times = observations.select("keyword", "observed_at").distinct()
    pairs = times.withColumn("newer", F.lead("observed_at").over(Window.partitionBy("keyword").orderBy("observed_at"))).withColumnRenamed("observed_at", "older")
    return pairs.withColumn("gap_days", F.abs(F.datediff("newer", "older"))).where(F.col("newer").isNotNull() & (F.col("gap_days") >= min_gap))


def is_new_app(released: Column, seen: Column) -> Column:
    age = F.datediff(seen, released) / 365.0
    return F.coalesce((age >= 0) & (age <= NEW_APP_YEARS), F.lit(False))


def transitions(observations: DataFrame, apps: DataFrame, min_gap: int = 3, sources: tuple[str, ...] = ("serp",), country: str | None = "us") -> DataFrame:
    """Entries, exits and moves between consecutive snapshots of a keyword in a country."""
    observations = of_country(observations, country)
    seen = observations.where(F.col("source").isin(*sources)) if sources else observations
    pairs = consecutive_snapshots(seen, min_gap)
    rows = seen.where("position is not null").join(apps.select("pkg", "title", "installs", "released_at"), "pkg")
    a = pairs.join(rows.select("keyword", F.col("observed_at").alias("older"), "pkg", F.col("position").alias("was")), ["keyword", "older"])
    b = pairs.join(rows.select("keyword", F.col("observed_at").alias("newer"), "pkg", F.col("position").alias("now")), ["keyword", "newer"])
    both = a.select("keyword", "older", "newer", "gap_days", "pkg", "was").join(b.select("keyword", "older", "newer", "gap_days", "pkg", "now"), ["keyword", "older", "newer", "gap_days", "pkg"], "full")
    event = F.when(F.col("was").isNull(), "entered").when(F.col("now").isNull(), "left").when(F.col("was") != F.col("now"), "moved")
    out = both.withColumn("event", event).where("event is not null").join(apps.select("pkg", "title", "released_at"), "pkg")
    return out.select("keyword", "pkg", "event", F.col("was").alias("from_position"), F.col("now").alias("to_position"), "gap_days", F.col("newer").alias("observed_at"), "title", ((F.col("event") == "entered") & is_new_app(F.col("released_at"), F.col("newer"))).alias("is_new"))


def transition_summary(events: DataFrame, most: int = 6) -> DataFrame:
    """Counts, and the first ``most`` entries of new apps by keyword, day and app."""
    shown = F.concat_ws(" ", "keyword", F.col("observed_at").cast("string"), "pkg", F.col("to_position").cast("string"))
    first = events.where("is_new").orderBy("keyword", "observed_at", "pkg").limit(most)
    examples = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("keyword", "observed_at", "pkg", shown.alias("shown")))), lambda x: x["shown"]).alias("examples"))
    return events.agg(
        F.count("*").alias("transitions"), F.count_if(F.col("event") == "entered").alias("entered"), F.count_if(F.col("event") == "left").alias("left_page"),
        F.count_if(F.col("event") == "moved").alias("moved"), F.count_if("is_new").alias("new_app_entries"), F.count_if(F.col("is_new") & (F.col("to_position") <= 10)).alias("new_app_reached_top10"),
    ).crossJoin(examples)


def outcomes(observations: DataFrame, apps: DataFrame, developers: tuple[str, ...], country: str | None = "us") -> DataFrame:
    """Best position of own apps for each keyword; null if never on the page."""
    observations = of_country(observations, country)
    mine = apps.where(F.lit(False))
    if developers:
        mine = apps.where(F.greatest(*[F.col("developer").like(d).cast("int") for d in (*developers, *developers)]) == 1)
    own = observations.where(F.col("source").isin("owned", "review")).unionByName(observations.where(~F.col("source").isin("owned", "review")).join(mine.select("pkg"), "pkg", "left_semi"))
    return own.groupBy("keyword").agg(F.min("position").alias("_p")).select("keyword", F.when(F.col("_p") < ABSENT, F.col("_p")).alias("position"))


def snapshot_pairs(observations: DataFrame, min_gap: int = 7) -> DataFrame:
    spans = observations.groupBy("keyword").agg(F.count_distinct("observed_at").alias("days"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    return spans.withColumn("gap_days", F.datediff("last", "first")).where(F.col("gap_days") >= min_gap).where("days > 1")


def research_before(rows: DataFrame) -> DataFrame:
    """(keyword, sample JSON list with installs, hits 'a/b') to recorded state."""
    sample = F.from_json("sample", "array<struct<installs:string>>")
    counts = F.filter(F.transform(sample, lambda x: F.nullif(F.regexp_replace(x["installs"], r"[^0-9]", ""), F.lit("")).try_cast("long")), lambda n: n.isNotNull() & (n > 0))
    parts = F.split("hits", "/")
    read = rows.select("keyword", F.size(sample).alias("n_apps"), counts.alias("_c"), (F.get(parts, 0).try_cast("int") / F.greatest(F.get(parts, 1).try_cast("int"), F.lit(1))).alias("title_hit_rate"))
    flat = read.select("keyword", "n_apps", "title_hit_rate", F.explode_outer("_c").alias("_i"))
    return flat.groupBy("keyword", "n_apps", "title_hit_rate").agg(F.percentile("_i", 0.5).alias("installs_median"))


def backtest(before: DataFrame, after: DataFrame, top_k: int = 10) -> DataFrame:
    """Recorded installs of the keywords that were later ranked, and that were missed; six of each by name."""
    j = before.hint("merge").join(after, "keyword").withColumn("_hit", F.coalesce(F.col("position") <= top_k, F.lit(False)))
    median = lambda hit, name: exact_percentiles(j.where(hit), F.col("installs_median"), [0.5]).select(F.get("values", 0).alias(name))
    counts = j.agg(F.count("*").alias("pairs"), F.count_if("_hit").alias("ranked"), F.count_if(~F.col("_hit")).alias("missed"))
    first = lambda hit, name: j.where(hit).select("keyword").orderBy("keyword").limit(6).agg(F.array_sort(F.collect_list("keyword")).alias(name))
    medians = counts.crossJoin(median(F.col("_hit"), "median_when_ranked")).crossJoin(median(~F.col("_hit"), "median_when_missed"))
    return medians.crossJoin(first(F.col("_hit"), "examples_ranked")).crossJoin(first(~F.col("_hit"), "examples_missed"))
