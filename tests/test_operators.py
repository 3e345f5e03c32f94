import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.functions import parse
from rankfield.functions import text as tx
from rankfield.operators import change, evaluate, field, ingest, intent, memory, models, scoring, state, suggest
from rankfield.operators import features as fx

AS_OF = dt.date(2024, 1, 1)
APPS = "pkg string, title string, short_desc string, description string, installs long, rating double, reviews long, released_at date, updated_at date"


def one(spark, sql_value, expression):
    return spark.createDataFrame([(sql_value,)], "s string").select(expression(F.col("s")).alias("v")).first().v


def page(spark, rows, keyword="spider tracker"):
    """Slots with context from (title, installs, age in days or None) in rank order."""
    data = []
    for i, (title, installs, days) in enumerate(rows):
        released = None if days is None else AS_OF - dt.timedelta(days=days)
        data.append((f"o{i:02}", title, "", "", installs, 4.5, 10, released, AS_OF - dt.timedelta(days=30)))
    apps = spark.createDataFrame(data, APPS)
    seen = spark.createDataFrame([(keyword, "us", r[0], i + 1, "serp", 0, AS_OF) for i, r in enumerate(data)], "keyword string, country string, pkg string, position long, source string, featured int, observed_at date")
    none = spark.createDataFrame([], "pkg string, observed_at date, installs long, reviews long")
    return field.prepared(state.attach_context(state.ranked_fields(seen, apps), none, seen, apps, str(AS_OF)))


def entrant(slots):
    """The page as an app sees it that is not on it."""
    return field.summarise(slots.withColumns({"own_pkg": F.lit("new"), "own_slot": F.lit(0), "idx": F.col("slot")})).first()


@pytest.mark.parametrize(("text", "count"), [("45,891,296", 45_891_296), (None, 0), ("", 0), ("soon", 0)])
def test_counts(spark, text, count):
    assert one(spark, text, parse.parse_count) == count


@pytest.mark.parametrize(("text", "count"), [("5M", 5_000_000), ("500k", 500_000), ("1.2B+", 1_200_000_000), ("100,000+", 100_000), ("soon", None), (None, None)])
def test_compact_counts(spark, text, count):
    assert one(spark, text, parse.parse_compact_count) == count


def test_dates(spark):
    assert one(spark, "May 29, 2013", parse.parse_store_date) == dt.date(2013, 5, 29)
    assert one(spark, "soon", parse.parse_store_date) is None
    for text, want in (("2013", (dt.date(2013, 7, 1), "year")), ("2013-05-29T10:00", (dt.date(2013, 5, 29), "day")), ("May 2, 2020", (dt.date(2020, 5, 2), "day")), ("1850", (None, None))):
        assert tuple(one(spark, text, lambda c, i=i: parse.parse_flexible_date(c)[i]) for i in (0, 1)) == want


def test_packages_keywords_and_numbers(spark):
    assert one(spark, "https://s.example/d?id=com.a.b&hl=en", parse.package_from_url) == "com.a.b"
    assert one(spark, "https://s.example/apps/com.a.b?x=1", parse.package_from_url) == "com.a.b"
    assert one(spark, "The Habit Tracker App: free", parse.keyword_from_title) == "habit tracker"
    assert one(spark, "one two three four five six - x", parse.keyword_from_title) == "one two three four"
    assert one(spark, "Free App", parse.keyword_from_title) is None
    assert [one(spark, s, lambda c: parse.human_number(c.cast("long"))) for s in ("999", "1200", "3000000", "4000000000")] == ["999", "1.2K", "3M", "4B"]


def test_only_the_leading_promoted_cards_have_no_rank(spark):
    rows = spark.createDataFrame([("p", 0, "promo", True), ("p", 1, "a", False), ("p", 2, "b", True), ("p", 3, "c", False)], "page string, ordinal int, pkg string, featured boolean")
    assert {r.pkg: r.position for r in ingest.assign_organic_positions(rows).collect()} == {"promo": None, "a": 1, "b": 2, "c": 3}


def test_session_documents_at_any_depth(spark):
    docs = spark.createDataFrame([("d1", '{"a":[{"b":{"keyword":" Cat ","apps":[{"package":"p1","installs":"5M"},{"appId":"p2"}]}}]}'), ("d2", '{"seed_keyword":"dog","market_proof":{"semantic_matches":[{"package":"p3","title":"t"}]}}'), ("d3", '{"keyword":"ant","qualifying":[{"package":"p4"}],"non_qualifying":[{"package":"p5"}]}'), ("d4", "not json"), ("d5", None)], "doc string, json string")
    rows = ingest.extract_session_pages(spark, docs).collect()
    assert sorted((r.keyword, r.ordered, r.ordinal, r.pkg, r.installs) for r in rows) == [("ant", False, 0, "p4", None), ("ant", False, 1, "p5", None), ("cat", True, 0, "p1", 5_000_000), ("cat", True, 1, "p2", None), ("dog", True, 0, "p3", None)]


def test_writes_are_idempotent_and_first_or_last_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "pkg string, version int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 0, "y"), ("c", 1, "y")], "pkg string, version int, v string")
    assert sorted((r.pkg, r.v) for r in ingest.upsert(old, new, ["pkg"], "version").collect()) == [("a", "y"), ("b", "x"), ("c", "y")]
    once = ingest.append_once(old, new, ["pkg"])
    assert sorted((r.pkg, r.v) for r in ingest.append_once(once, new, ["pkg"]).collect()) == [("a", "x"), ("b", "x"), ("c", "y")]


def test_leave_one_out_drops_exactly_one_row(spark):
    pairs = field.leave_one_out(page(spark, [("X", 10**9, 400), ("Y", 1000, 400), ("Z", 2000, 400)]))
    rows = {r.own_pkg: r for r in field.summarise(pairs).collect()}
    assert rows["o00"].n == 2 and rows["o00"].installs_p50 == 1500 and rows["o01"].installs_p90 > 10**8
    assert all(r.idx == i + 1 for own in ("o00", "o01", "o02") for i, r in enumerate(pairs.where(F.col("own_pkg") == own).orderBy("idx").collect()))


def test_newcomers_ages_and_rates(spark):
    old, young = entrant(page(spark, [("a", 5_000_000, 8 * 365)] * 10)), entrant(page(spark, [("a", 5_000_000, 200)] * 10))
    assert (old.newcomers, young.newcomers) == (0, 10) and old.age_p50 == 8.0 and young.page_all > 5 * old.page_all
    fast, slow = entrant(page(spark, [("a", 10**6, 300)] * 3)), entrant(page(spark, [("a", 10**6, 3000)] * 3))
    assert fast.page_all / slow.page_all > 5
    unknown = entrant(page(spark, [("a", 5_000_000, None)] * 10))
    assert (unknown.age_known_frac, unknown.newest_entrant_age, unknown.newcomers) == (0.0, 0.0, 0)


def test_a_page_of_filler_is_not_a_wall(spark):
    filler, wall = entrant(page(spark, [("Find Hub", 50_000_000, 900)] * 10)), entrant(page(spark, [("Spider Tracker Pro", 50_000_000, 900)] * 10))
    assert (filler.exact_match_count, filler.no_intent, filler.relevant_count) == (0, 1, 0)
    assert (wall.exact_match_count, wall.no_intent, wall.relevant_count, wall.intent_cut) == (10, 0, 10, 10)
    assert wall.relevance_p50 == 1.0


def test_an_empty_field_has_its_defaults(spark):
    slots = page(spark, [("only", 10, 10)])
    cards = spark.createDataFrame([], "keyword string, relevance double, installs long")
    row = field.field_table(slots, cards).first()
    assert (row.n, row.weakest_rank, row.has_featured, row.page_all) == (0, 99, 0, 0.0)


def test_two_meanings_split(spark):
    vectors = [[1.0, 0.0]] + [[0.0, 1.0]] * 5
    rows = spark.createDataFrame([("phone mirror", f"o{i}", i + 1, v, t, n, 900, 2.5) for i, (v, t, n) in enumerate(zip(vectors, ["Phone Mirror"] + ["Cast Screen"] * 5, [125] + [20_000_000] * 5, strict=True))], "keyword string, pkg string, slot int, vector array<double>, title string, installs long, days int, age double")
    groups = intent.cluster_pages(rows)
    joined = rows.join(groups, ["keyword", "pkg"])
    found = {r.group: r for r in intent.describe_groups(joined).collect()}
    assert (found[0].size, found[0].median_installs, found[1].size, found[1].best_rank) == (1, 125, 5, 2)
    assert {r.group: r.label for r in intent.label_groups(joined).collect()} == {0: "mirror", 1: "cast / screen"}
    assert intent.ambiguous_pages(groups).count() == 1
    assert {r.group for r in intent.cluster_pages(rows.limit(2)).collect()} == {0}


def test_average_linkage_uses_mean_similarity():
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    v = np.array([angle(0), angle(40), angle(80)])
    assert intent.average_linkage(v, 0.5).tolist() in ([0, 0, 2], [0, 1, 1])
    assert len(set(intent.average_linkage(v, 0.4).tolist())) == 1


def test_registry_directions(spark):
    rows = fx.feature_registry(spark).collect()
    assert len({r.name for r in rows}) == len(rows) == 96
    assert [sum(r.direction == d for r in rows) for d in ("inc", "dec", "free")] == [13, 24, 59]


def test_suggestion_signals(spark):
    rows = [("phone mirror", i, s) for i, s in enumerate(["phone mirror", "phone mirror app", "phone mirror free", "phone mirror tv", "phone mirror pc"])] + [("qq", 0, "other")]
    table = spark.createDataFrame(rows, "query string, position int, suggestion string")
    keywords = spark.createDataFrame([("phone mirror",), ("qq",), ("never",)], "keyword string")
    got = {r.keyword: r for r in suggest.suggestion_signals(table, keywords).collect()}
    assert (got["phone mirror"].sugg_is_canonical, got["phone mirror"].sugg_self_rank, got["phone mirror"].sugg_extends, got["phone mirror"].sugg_unrelated) == (1.0, 0.0, 0.8, 0.0)
    assert (got["qq"].sugg_self_listed, got["qq"].sugg_unrelated, got["never"].sugg_self_rank) == (0.0, 1.0, 1.0)


def test_split_never_divides_a_keyword(spark):
    rows = spark.createDataFrame([(f"k{i % 4}", f"p{i}") for i in range(40)], "keyword string, pkg string")
    sides = fx.group_split(rows).select("keyword", "held_out").distinct().collect()
    assert len(sides) == 4 and sum(r.held_out for r in sides) == 1


@pytest.mark.parametrize(("rank", "target"), [(1, 5.25), (2, 4.5), (3, 3.5), (5, 1.5), (9, 0.75)])
def test_rank_targets(spark, rank, target):
    row = spark.createDataFrame([([5.0, 4.0, 3.0, 2.0, 1.0], rank)], "s array<double>, r int")
    assert row.select(memory.target_score_for_rank(F.col("s"), F.col("r")).alias("t")).first().t == target


def test_residuals_are_local_bounded_and_exact(spark):
    kinds = "id long, keyword string, pkg string, features array<double>, residual double, weight double"
    filed = spark.createDataFrame([(1, "k", "p", [0.0] * 8, 4.0, 5.0)], kinds)
    asks = spark.createDataFrame([("k", "p", [9.0] * 8), ("k", "here", [0.0] * 8), ("k", "far", [6.0] * 8)], "keyword string, pkg string, features array<double>")
    got = {r.pkg: r.residual for r in memory.read_residuals(asks, filed).collect()}
    assert got["p"] == pytest.approx(4 * 5 / 6) and got["here"] == pytest.approx(20 / 6) and abs(got["far"]) < 1e-6
    assert {r.residual for r in memory.read_residuals(asks, filed.limit(0)).collect()} == {0.0}
    assert memory.drop_stale_shapes(filed, 7).count() == 0


def test_metrics_on_small_tables(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "y int, p double")
    assert evaluate.auc(rows).first().auc == pytest.approx(0.875)
    assert evaluate.auc(rows.where("y = 1")).first().auc == 0.5
    exact = spark.createDataFrame([(1, 1.0), (0, 0.0), (0, 0.3), (1, 0.3)], "y int, p double")
    assert evaluate.calibration_error(exact).first().ece == pytest.approx(0.1)


def test_transitions_enter_leave_and_move(spark):
    apps = spark.createDataFrame([(p, p, 1, AS_OF - dt.timedelta(days=40)) for p in "abc"], "pkg string, title string, installs long, released_at date")
    day = lambda n: AS_OF + dt.timedelta(days=n)
    seen = spark.createDataFrame([("k", p, n, "serp", day(d)) for d, places in ((0, {"a": 1, "b": 2}), (1, {"a": 1}), (8, {"a": 2, "c": 1})) for p, n in places.items()], "keyword string, pkg string, position long, source string, observed_at date")
    got = sorted((r.pkg, r.event, r.from_position, r.to_position, r.is_new) for r in change.transitions(seen, apps).collect())
    assert got == [("a", "moved", 1, 2, False), ("c", "entered", None, 1, True)]


def test_download_points_accept_a_future_release(spark):
    points = spark.createDataFrame([("k", "me", 1, 1, AS_OF - dt.timedelta(days=n), r, 100.0) for r, n in ((1, 400), (2, 40))], "keyword string, own_pkg string, own_slot int, place int, released date, rank int, rate double")
    at = lambda n: [r.newer for r in fx.describe_points(points, F.lit(AS_OF + dt.timedelta(days=n)), F.lit(AS_OF)).orderBy("rank").collect()]
    assert at(0) == pytest.approx([-math.log1p(400), -math.log1p(40)]) and at(7) == pytest.approx([-math.log1p(407), -math.log1p(47)])


def test_ranker_never_falls_in_a_monotone_feature(spark):
    rng = np.random.default_rng(4)
    columns = ["kw_in_title", "rating", "field_installs_p50", "kw_tokens"]
    rows = []
    for i in range(300):
        x = rng.normal(size=4)
        rows.append((f"k{i % 10}", f"p{i}", i % 30, float(2 * x[0] - x[3] + 0.3 * rng.normal() > 0), 1.0, *map(float, x)))
    table = spark.createDataFrame(rows, "keyword string, pkg string, slot int, label double, weight double, " + ", ".join(f"{c} double" for c in columns))
    model = models.fit_monotone_ranker(table, columns)
    weights = models.coefficients(model, columns)
    assert all(weights[c] >= 0 for c in columns[:3]) and weights["kw_tokens"] < 0
    up = {r.pkg: r.logit for r in models.scores(model, table.withColumn("rating", F.col("rating") + 1)).collect()}
    assert all(up[r.pkg] >= r.logit - 1e-9 for r in models.scores(model, table).collect())
    p = models.scores(model, table).select((1 / (1 + F.exp(-F.col("logit")))).alias("p"), "pkg").join(table.select("pkg", F.col("label").cast("int").alias("y")), "pkg")
    assert evaluate.auc(p).first().auc > 0.8


def test_download_estimate_scales_with_the_page(spark):
    rng = np.random.default_rng(5)

    def points(scale, pages=40):
        out = []
        for k in range(pages):
            level = rng_level[k] * scale
            out += [(f"k{k}", "me", 5, i + 1, AS_OF - dt.timedelta(days=100 * (i + 1)), i + 1, level * (7 - i)) for i in range(6)]
        return spark.createDataFrame(out, "keyword string, own_pkg string, own_slot int, place int, released date, rank int, rate double")

    rng_level = np.exp(rng.normal(8, 1, 40)).tolist()
    day = F.lit(AS_OF)
    kernel = lambda s: models.kernel_features(fx.describe_points(points(s), day, day))
    train = kernel(1).withColumn("log_rate", F.col("level") - 0.5)
    model = models.fit_page_relative_rates(train)
    yearly = lambda s: {r.keyword: math.expm1(r.log_rate_hat) for r in models.predict_rates(model, kernel(s)).collect()}
    one_x, thousand_x = yearly(1), yearly(1000)
    assert all(800 < thousand_x[k] / one_x[k] < 1250 for k in one_x)


def test_corrected_rank_is_exact_on_the_settled_page(spark):
    scored = spark.createDataFrame([("k", f"p{i}", float(10 - i)) for i in range(10)], "keyword string, pkg string, score double")
    for rank in (1, 3, 7, 10):
        asks = spark.createDataFrame([("k", "p8", rank)], "keyword string, pkg string, rank int")
        row = memory.rank_corrections(asks, scored).first()
        moved = scored.withColumn("score", F.when(F.col("pkg") == "p8", row.score + row.residual * 5 / 6).otherwise(F.col("score")))
        assert scoring.predicted_ranks(moved).where("pkg = 'p8'").first().predicted_rank == rank


def test_vectors_and_text(spark):
    rows = spark.createDataFrame([("abc abd",), ("ab",), ("",), (None,)], "t string")
    got = {r.t: r.vector for r in tx.hashed_trigram_vectors(rows, "t", 64).collect()}
    assert set(got) == {"abc abd", "ab", ""} and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(tx.cosine(F.col("a"), F.col("b")).alias("c"), tx.cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert (pair.c, pair.n) == (pytest.approx(math.sqrt(0.5)), 0.0)


SEEN = "keyword string, country string, pkg string, position long, source string, featured int, observed_at date"


def test_pages_of_two_countries_stay_apart(spark):
    apps = spark.createDataFrame([(p, p, "", "", 10, 4.0, 1, AS_OF, AS_OF) for p in "abc"], APPS)
    seen = spark.createDataFrame([("k", c, p, n, "serp", 0, AS_OF) for c, p, n in (("us", "a", 2), ("us", "c", 7), ("de", "b", 1), ("de", "a", 3))], SEEN)
    at = lambda **kw: {(r.country, r.pkg): r.slot for r in state.ranked_fields(seen, apps, **kw).collect()}
    assert at() == {("us", "a"): 1, ("us", "c"): 2} and at(country="de") == {("de", "b"): 1, ("de", "a"): 2}
    assert at(country=None) == at() | at(country="de")
    assert {r.pkg: r.breadth for r in state.keyword_breadth(seen).collect()} == {"a": 1, "b": 1, "c": 1}


def test_a_review_outlasts_an_absence_of_the_same_day(spark):
    apps = spark.createDataFrame([("a", "a", "", "", 10, 4.0, 1, AS_OF, AS_OF)], APPS)
    seen = spark.createDataFrame([("k", "us", "a", 251, "owned", 0, AS_OF), ("k", "us", "a", 3, "review", 0, AS_OF), ("k", "us", "a", 9, "serp", 0, AS_OF)], SEEN)
    assert [r.position for r in state.latest_observations(seen, apps).collect()] == [3]
    numbered = seen.withColumn("id", F.when(F.col("source") == "owned", 7).otherwise(1))
    assert [r.position for r in state.latest_observations(numbered, apps).collect()] == [251], "the row written last"


def test_given_groups_are_the_competition(spark):
    slots = page(spark, [("Spider Tracker", 100, 400), ("Cast Screen", 10**7, 400), ("Cast Now", 10**7, 400), ("Spider Tracker Pro", 300, 400)])
    groups = slots.select("keyword", "pkg", F.when(F.col("pkg").isin("o00", "o03"), 0).otherwise(1).alias("group"))
    split = field.prepared(slots.drop("on_intent", "advantage", "rate_vs_age"), groups)
    got = {r.own_pkg: (r.relevant_count, r.installs_p50_relevant) for r in field.summarise(field.near_rows(split)).collect()}
    assert got["o00"] == (1, 300.0) and got["o01"] == (1, 10.0**7)


def test_near_rows_hold_what_the_summary_reads(spark):
    slots = page(spark, [(f"Spider {i}", 1000 * (i * 7 % 31), 100 + 37 * i) for i in range(30)])
    both = [sorted(map(str, field.summarise(pairs).collect())) for pairs in (field.leave_one_out(slots), field.near_rows(slots))]
    assert both[0] == both[1]


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in np.round(rng.normal(0, 10, 3000), 1)] + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    at = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = evaluate.exact_percentiles(rows, F.col("v"), at).first()["values"]
    assert got == pytest.approx(np.percentile([v for v in values if v is not None], [100 * q for q in at]).tolist())
    assert evaluate.exact_percentiles(rows.limit(0), F.col("v"), at).first()["values"] is None


def test_near_residuals_equal_all_pairs_and_meet_few(spark):
    rng = np.random.default_rng(3)
    kinds = "id long, keyword string, pkg string, features array<double>, residual double, weight double"
    # four far clouds, a hot one, and vectors of another length
    spots = [rng.normal(size=6) * 30 for _ in range(4)]
    near = lambda i: (spots[i % 4 if i % 3 else 0] + rng.normal(size=6)).tolist()
    held = [(i, f"k{i}", "p", near(i) if i % 10 else [0.5] * 5, float(rng.normal()), float(1 + i % 5)) for i in range(120)] + [(500, "k3", "p", near(3), 9.0, 2.0), (501, "k3", "p", None, 1.0, 1.0)]
    rows = [(f"k{i}", "q" if i % 2 else "p", near(i) if i % 11 else [0.4] * 5) for i in range(80)]
    filed = spark.createDataFrame(held, kinds)
    asks = spark.createDataFrame(rows, "keyword string, pkg string, features array<double>")

    def plain(keyword, pkg, x):
        own = [h for h in held if h[1] == keyword and h[2] == pkg and h[3] is not None and len(h[3]) == len(x)]
        if own:
            return own[-1][4] * own[-1][5] / (own[-1][5] + 1)
        weights = sorted(((h[5] * math.exp(-sum((a - b) ** 2 for a, b in zip(x, h[3], strict=True)) / 0.5625), h[4], h[0]) for h in held if h[3] is not None and len(h[3]) == len(x)), key=lambda w: (-round(w[0], 9), w[2]))[:16]
        return sum(w * r for w, r, _ in weights) / (sum(w for w, _, _ in weights) + 1)

    got = {(r.keyword, r.pkg): r.residual for r in memory.read_residuals(asks, filed).collect()}
    assert len(got) == len(rows)
    for keyword, pkg, x in rows:
        assert got[keyword, pkg] == pytest.approx(plain(keyword, pkg, x), abs=1e-9)
    assert memory.near_corrections(asks, filed).count() < len(rows) * len(held) / 2


def dated_page(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(3):
        for slot in range(1, n + 1):
            days = int(rng.choice([0, 30, 200, 400, 545, 2000]))
            rows.append((f"k{k}", f"p{slot}", slot, days, days / 365, float(rng.integers(0, 9)) * 100 if days else 0.0, int(rng.integers(0, 5)), float(rng.choice([0.0, 0.25, 0.5]))))
    rows += [("alone", "p1", 1, 100, 0.3, 5.0, 7, 0.1), ("old", "p1", 1, 0, 0.0, 0.0, 7, 0.0), ("old", "p2", 2, 100, 0.3, 8.0, 7, 0.0)]
    return rows, spark.createDataFrame(rows, "keyword string, pkg string, slot int, days int, age double, rate double, installs int, advantage double")


def test_unaided_rates_without_the_own_app_equal_a_loop(spark):
    rows, df = dated_page(spark)
    found = field.unaided_recent(df)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.keyword, r.own_pkg): (r.unaided_recent_rate, r.unaided_recent_evidence) for r in found.collect()}
    want = {}
    for key, own, *_ in rows:
        others = sorted((r[5], 1 - r[7], r[2]) for r in rows if r[0] == key and r[1] != own and r[3] > 0 and r[4] <= 1.5)
        if others:
            total, seen = sum(w for _, w, _ in others), 0.0
            for rate, w, _ in others:
                seen += w
                if round(seen, 9) >= round(total / 2, 9):
                    want[key, own] = (rate, pytest.approx(total))
                    break
    assert got == want


def test_page_curves_without_the_own_app_equal_least_squares(spark):
    rows, df = dated_page(spark, 40, 9)
    found = field.page_curve(df)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.keyword, r.own_pkg): r for r in found.collect()}
    for key, own, slot, *_ in rows:
        points = [(r[2], math.log1p(r[3]), math.log1p(r[5])) for r in rows if r[0] == key and r[1] != own and r[3] > 0 and r[6] > 0]
        assert ((key, own) in got) == bool(points)
        if len(points) >= 6:
            x = np.array([(1, a, b) for a, b, _ in points])
            y = np.array([c for *_, c in points])
            b0, b1, b2 = np.linalg.lstsq(x, y, rcond=None)[0]
            r = got[key, own]
            fit = 1 - ((y - x @ [b0, b1, b2]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
            here = max(math.expm1(min(b0 + b1 * slot + b2 * min(p[1] for p in points), 30)), 0)
            assert [r.curve_rank_slope, r.curve_age_slope, r.curve_fit, r.curve_here, r.curve_points] == pytest.approx([b1, b2, fit, here, len(points)], rel=1e-6, abs=1e-8)


def test_what_if_equals_the_linear_form_and_a_loop(spark):
    rng = np.random.default_rng(6)
    names = ["a", "b", "c"]
    rows = [(f"k{k}", f"p{s}", s, *map(float, rng.integers(0, 4, 3))) for k in range(3) for s in range(1, 13)]
    df = spark.createDataFrame(rows, "keyword string, pkg string, slot int, a double, b double, c double")
    weights = {"a": 0.5, "b": -1.0, "c": 2.0}
    linear = scoring.what_if(df, names, lambda x: x.withColumn("score", sum(F.col(n) * w for n, w in weights.items())))
    told = lambda d: sorted((r.keyword, r.pkg, r.feature, round(r.gain, 9), round(r.closable, 9)) for r in scoring.why(d).collect())
    assert told(linear) == told(scoring.counterfactual(df, spark.createDataFrame(list(weights.items()), "feature string, coefficient double"), names))
    # an ensemble of seven, none linear
    member = lambda i, a, b, c: max(a, i % 3) * b - i * 0.1 * c * c
    score = lambda a, b, c: sum(member(i, a, b, c) for i in range(7)) / 7
    column = sum(F.greatest(F.col("a"), F.lit(float(i % 3))) * F.col("b") - i * 0.1 * F.col("c") * F.col("c") for i in range(7)) / 7
    got = {(r.keyword, r.pkg, r.feature): (r.yours, r.theirs, r.gain, r.closable) for r in scoring.what_if(df, names, lambda x: x.withColumn("score", column)).collect()}
    want = {}
    for key, pkg, _, *x in rows:
        gate = next(r for r in rows if r[0] == key and r[2] == 10)[3:]
        gains = {i: score(*[gate[j] if j == i else x[j] for j in range(3)]) - score(*x) for i in range(3) if x[i] != gate[i]}
        whole = score(*[gate[j] if gains.get(j, 0) > 0 else x[j] for j in range(3)]) - score(*x)
        want |= {(key, pkg, names[i]): (x[i], gate[i], pytest.approx(g), pytest.approx(whole)) for i, g in gains.items()}
    assert got == want


def test_a_corrected_rank_is_recorded_first_and_lands(spark):
    day = dt.date(2001, 1, 1)
    seen = spark.createDataFrame([("k", "us", f"p{i}", i, "serp", 0, day) for i in range(1, 8)], "keyword string, country string, pkg string, position long, source string, featured int, observed_at date")
    listing = spark.createDataFrame([(f"p{i}", f"t{i}", 100 * i) for i in range(1, 8)], "pkg string, title string, installs long")
    settle = lambda o: state.ranked_fields(o, listing)
    score = lambda s: s.select("keyword", "pkg", (10.0 - F.col("slot")).alias("score"))
    reviews = spark.createDataFrame([("k", "p6", 2)], "keyword string, pkg string, rank int")
    recorded, filed = memory.apply_rank_corrections(reviews, seen, settle, score, "2001-02-01")
    slot = {r.pkg: r.slot for r in settle(recorded).collect()}
    (row,) = filed.collect()
    assert slot["p6"] == 2 and recorded.count() == 8 and row.status == "queued"
    # p6 has settled at slot 2 (score 8); the aim lies between its neighbours of 9 and 7
    assert (row.score, row.target, row.residual) == (8.0, 8.0, 0.0)
    far, filed = memory.apply_rank_corrections(reviews, seen, settle, lambda s: s.select("keyword", "pkg", F.when(F.col("pkg") == "p6", 1.0).otherwise(10.0 - F.col("slot")).alias("score")), "2001-02-01")
    (row,) = filed.collect()
    assert row.target == 8.0 and row.residual == pytest.approx((8.0 - 1.0) * 6 / 5)


def test_sessions_become_field_history(spark):
    day = AS_OF
    rows = [("d1", "$/a", "k", "us", day, 100, day - dt.timedelta(days=100)), ("d1", "$/a", "k", "us", day, None, None), ("d1", "$/a", "k", "us", day, 300, day - dt.timedelta(days=800)), ("d2", "$", "k", "us", day, 9, None)]
    pages = spark.createDataFrame(rows, "doc string, path string, keyword string, country string, observed_at date, installs long, released_at date")
    (row,) = change.session_states(pages).collect()
    assert (row.n_apps, row.installs_p50, row.newcomers, row.source) == (3, 100.0, 1, "research") and row.age_known_frac == pytest.approx(2 / 3)


def test_short_numbers_round_as_printf_does(spark):
    """By the exact binary value, ties to even: 1.25 to 1.2, 1.15 (a little less) to 1.1, 309.65 (a little less) to 309.6."""

    def want(n):
        cut, mark = next((c, m) for c, m in ((1e9, "B"), (1e6, "M"), (1e3, "K")) if n >= c)
        return f"{n / cut:.1f}".removesuffix(".0") + mark

    numbers = [*range(1_000, 1_000_001, 50), *range(10**6, 10**8, 50_000), *range(10**9, 10**11, 50_000_000), 309_649.5, 309_650.5, 999_949.5, 9.2e18]
    rows = spark.createDataFrame([(float(n),) for n in numbers], "n double")
    for kind in ("double", "long"):
        got = rows.select(F.col("n").cast(kind).alias("n"), parse.human_number(F.col("n").cast(kind)).alias("v")).collect()
        assert len(got) == len(numbers) and not [r for r in got if r.v != want(r.n)]
    spelt = spark.createDataFrame([(1_250,), (1_150,), (309_650,), (8_750,), (999_950,)], "n long").select(parse.human_number(F.col("n")).alias("v"))
    assert [r.v for r in spelt.collect()] == ["1.2K", "1.1K", "309.6K", "8.8K", "1000K"]


def test_a_narrative_tells_tied_numbers_as_its_sql(spark):
    rows = page(spark, [("spider tracker", 309_650, 30), ("habit", 1_250, None)])
    fields = field.summarise(rows.withColumns({"own_pkg": F.lit("new"), "own_slot": F.lit(0), "idx": F.col("slot")}))
    told = scoring.narrative(fields.withColumns({"has_featured": F.lit(0), "featured_relevance": F.lit(0.0)}))
    assert told.first().narrative == "1 of 2 apps answer the phrase, around 309.6K installs. An app with 1.2K installs holds rank 2. 1 of them launched within a year."


def test_a_page_story_tells_tied_numbers_as_its_sql(spark):
    columns = "keyword string, n long, scraped long, group_size long, group_best_rank int, group_median_installs double, group_weakest_installs long, group_newcomers long, group_newcomer_installs long, weakest_installs long, weakest_rank int, age_known_frac double, newest_entrant_age double, newcomers long, has_featured int, featured_relevance double, demand double, entry_rank int"
    rows = [
        ("many", 10, 202, 68, 1, 502_450.0, 40_000, 12, 1_250_000, 8_250, 4, 1.0, 0.2, 3, 0, 0.0, 50.0, 11),
        ("few", 10, 30, 3, 1, 1_150_000.0, 1_150, 0, 0, 1_150, 7, 1.0, 0.2, 0, 0, 0.0, 50.0, 11),
        ("one", 10, 30, 1, 2, 2_250.0, 2_250, 0, 0, 2_250, 2, 0.0, 0.0, 0, 0, 0.0, 50.0, 11),
    ]
    enter = " A well-made newcomer would enter at about rank 11, below where the installs are."
    assert {r.keyword: r.story.removesuffix(enter) for r in scoring.page_story(spark.createDataFrame(rows, columns)).collect()} == {
        "many": "The question is well answered: 68 of 202 apps, at about 502.4K installs. Rank 4 is held with 8.2K installs, so the top is not defended. 12 of them are under a year old, the largest at 1.2M installs, so there is a way in.",
        "few": "3 of 30 apps answer this question, at about 1.1M installs; the rest are something else.",
        "one": "One app only answers this question: 2.2K installs at rank 2; the other 29 answer another.",
    }
