"""New apps against whole pages: fields from outside, and one answer for each page."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rankfield.operators import entry, field, intent, models, scoring, state
from rankfield.operators import features as fx
from rankfield.sources.storage import kept

AS_OF = dt.date(2024, 1, 1)
COLUMNS = ["kw_in_title", "rating", "log_reviews", "field_installs_p50", "field_relevant_count", "days_since_update"]


@pytest.fixture(scope="module")
def pages(spark):
    """Three pages of 14 apps, the third without a single date."""
    apps, seen = [], []
    for k, keyword in enumerate(("spider tracker", "coffee timer", "moss atlas")):
        for i in range(14):
            pkg = f"{keyword[:2]}{i:02}"
            title = keyword.title() if (i + k) % 3 == 0 else f"{keyword.split()[0].title()} thing {i}"
            released = None if k == 2 or i == 5 else AS_OF - dt.timedelta(days=60 + 170 * ((i * 5 + k) % 9))
            apps.append((pkg, title, "", "", 10 ** (2 + (14 - i) // 3) + 37 * i, 3.0 + (i * 7 % 5) / 3, 10 + i, released, AS_OF - dt.timedelta(days=30 + i)))
            seen.append((keyword, "us", pkg, i + 1, "serp", 0, AS_OF))
    table = spark.createDataFrame(apps, "pkg string, title string, short_desc string, description string, installs long, rating double, reviews long, released_at date, updated_at date")
    rows = spark.createDataFrame(seen, "keyword string, country string, pkg string, position long, source string, featured int, observed_at date")
    none = spark.createDataFrame([], "pkg string, observed_at date, installs long, reviews long")
    return state.attach_context(state.ranked_fields(rows, table), none, rows, table, str(AS_OF)).transform(kept, "pages")


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame([("coffee timer", "ad", 0.9, 5_000)], "keyword string, pkg string, relevance double, installs long")


def split_of(pages):
    return pages.select("keyword", "pkg", (F.col("slot") % 2).cast("int").alias("group"))


def same(a, b):
    return a == b if not isinstance(a, float) else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_an_outsider_sees_what_an_app_left_out_of_its_page_sees(spark, pages, cards):
    """The last app's own field is the field of the page without it, from its place."""
    rows = kept(field.prepared(pages, split_of(pages)), "rows")
    inside = {r.keyword: r.asDict() for r in field.field_table(rows, cards).where("own_slot = 14").collect()}
    guests = rows.where("slot = 14").select("keyword", "pkg", "slot", "group")
    outside = {r.keyword: r.asDict() for r in field.outside_table(rows.where("slot < 14"), guests, cards).collect()}
    assert len(outside) == 3
    for keyword, want in inside.items():
        for name, value in want.items():
            assert same(outside[keyword][name], value), (keyword, name, outside[keyword][name], value)


def test_without_a_place_there_are_no_neighbours(spark, pages, cards):
    rows = field.prepared(pages, split_of(pages))
    guests = scoring.hypothetical_entrants(pages.select("keyword").distinct(), str(AS_OF))
    for r in field.outside_table(rows, entry.entrant_rows(guests), cards).collect():
        assert (r.n, r.weakest_rank > 0, r.relevant_count) == (10, True, 5)
        assert (r.band_all, r.band_evidence, r.below_all, r.neighbour_rate, r.recent_neighbour_rate, r.recent_neighbour_gap, r.curve_here) == (0, 0, 0, 0, 0, 0, 0)
        assert r.has_featured == (1 if r.keyword == "coffee timer" else 0)


def test_all_of_the_leading_group_are_rivals(spark, pages):
    membership = pages.select("keyword", "pkg", F.when(F.col("slot") <= 3, 0).otherwise(1).alias("group"))
    guests = entry.entrant_rows(scoring.hypothetical_entrants(pages.select("keyword").distinct(), str(AS_OF)))
    assert {(r.intent_rivals, r.intent_reach, r.intent_share) for r in intent.outside_stats(pages, membership, guests).collect()} == {(3, 1.0, 0.3)}


def test_entries_rank_both_sides_alike(spark, pages, cards):
    """Ties with the entrant do not push it down; an override wins; evidence is counted."""
    page = pages.select("keyword", "pkg", F.explode(F.array(F.lit(0), F.lit(1))).alias("member"), (5.0 - F.col("slot")).alias("logit"))
    new = pages.select("keyword").distinct().select("keyword", F.lit("new").alias("pkg"), F.explode(F.array(F.lit(0), F.lit(1))).alias("member")).withColumn("logit", F.lit(2.0))
    held = spark.createDataFrame([("moss atlas", 7.0)], "keyword string, value double")
    got = {r.keyword: r for r in entry.entries(page, new, cards, held, 5).collect()}
    assert {k: (r.entry_rank, r.displayed_rank, r.field_size) for k, r in got.items()} == {"spider tracker": (3, 3, 15), "coffee timer": (3, 4, 16), "moss atlas": (3, 3, 15)}
    for r in got.values():
        assert (r.agreement, r.evidence, r.confidence) == (1.0, 0.2, 0.2)
        assert math.isclose(r.chance, 1 / (1 + math.exp(-2)))
    assert (got["moss atlas"].crowding, got["moss atlas"].overridden, got["coffee timer"].overridden) == (7.0, True, False)


def test_an_entrant_is_scored_whole(spark, pages, cards):
    membership = split_of(pages)
    rows = kept(field.prepared(pages, membership), "rows")
    blank = lambda prefix: pages.select("keyword").distinct().select("keyword", *[F.lit(0.0).alias(c) for c in fx.FEATURES if c.startswith(prefix)])
    signals, history = blank("sugg_"), blank("hist_")
    table = kept(fx.extract_features(rows, field.field_table(rows, cards), intent.intent_stats(rows.drop("group"), membership), signals, history), "table")
    scaler = kept(fx.fit_scaler(table, COLUMNS), "scaler")
    own = table.select("keyword", "pkg", F.col("age").alias("_age"), F.col("rate").alias("_rate"))
    scaled = fx.apply_scaler(table, scaler, COLUMNS).drop("age", "rate").join(own, ["keyword", "pkg"]).withColumnsRenamed({"_age": "age", "_rate": "rate"})
    aligned = kept(fx.sign_align(fx.training_set(scaled)), "aligned")
    dated = rows.where("released_at is not null")
    day = F.lit(AS_OF)
    kernel = models.kernel_features(fx.describe_points(fx.download_points(field.leave_one_out(rows.drop("group"), dated.select("keyword", "pkg", "slot", "released_at", "rate"))), day, day))
    kernel = kernel.join(dated.select("keyword", F.col("pkg").alias("own_pkg"), F.log1p("rate").alias("log_rate")), ["keyword", "own_pkg"])
    head, _ = models.fit_rate_head(aligned, COLUMNS)
    fitted = entry.Fitted(models.fit_members(aligned, COLUMNS, 2), scaler, COLUMNS, 3, entry.fit_rates(kernel, 2), [head], math.log1p(5e7))
    guests = scoring.hypothetical_entrants(rows.select("keyword").distinct(), str(AS_OF)).withColumn("cosine", F.lit(1.0))
    none = spark.createDataFrame([], "keyword string, value double")
    got = {r.keyword: r for r in entry.score_entries(rows, membership, aligned, guests, cards, signals, history, none, fitted, str(AS_OF), {"max_rank": 5}).collect()}
    assert set(got) == {"spider tracker", "coffee timer", "moss atlas"}
    # the rank, counted again from the members' logits
    blind = entry.entrant_features(rows, membership, entry.entrant_rows(guests), cards, signals, history)
    assert {(r.kw_in_title, r.band_rate, r.days_since_release) for r in blind.collect()} == {(1.0, 0.0, 0.0)}
    mean = lambda df: df.groupBy("keyword", "pkg").agg(F.round(F.avg("logit"), 9).alias("s")).collect()
    page, new = mean(models.member_scores(fitted.rankers, aligned)), mean(models.member_scores(fitted.rankers, entry.aligned(blind, fitted)))
    for n in new:
        assert got[n.keyword].entry_rank == 1 + sum(p.s > n.s for p in page if p.keyword == n.keyword)
    for k, r in got.items():
        assert r.answered_by == ("head" if k == "moss atlas" else "page")
        assert 0 <= r.low_per_year <= r.per_year <= r.high_per_year and math.isclose(r.per_month * 12, r.per_year)
        assert r.displayed_rank == r.entry_rank + (k == "coffee timer")
        assert r.meets_thresholds == (r.entry_rank <= 5) and r.verdict == ("BUILD IT" if r.entry_rank <= 3 else "WORTH A TRY" if r.entry_rank <= 10 else "SKIP")
        # nobody dated above the slot is told where the page answered
        above = rows.where((F.col("keyword") == k) & (F.col("slot") < r.entry_rank) & F.col("released_at").isNotNull()).count()
        assert ("nothing ranks above this slot" in r.caveats) == (k != "moss atlas" and above == 0)
