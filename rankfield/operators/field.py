"""Competitive field of a page, with every app left out of its own field."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions.text import RELEVANT

KEY = ["keyword", "own_pkg", "own_slot"]
SCALE = 3.0
BAND, BELOW = 2, 5


def _own(slots: DataFrame) -> DataFrame:
    group = [F.col("group").alias("_own_group")] if "group" in slots.columns else []
    return slots.select("keyword", F.col("pkg").alias("own_pkg"), F.col("slot").alias("own_slot"), *group)


def _paired(pairs: DataFrame) -> DataFrame:
    """``idx``, and competition by the own app's group where pages are split."""
    return _by_group(pairs.where("own_pkg <> pkg").withColumn("idx", F.col("slot") - (F.col("slot") > F.col("own_slot")).cast("int")))


def _by_group(pairs: DataFrame) -> DataFrame:
    if "_own_group" not in pairs.columns:
        return pairs
    mine = F.when(F.col("_own_group").isNotNull(), F.coalesce(F.col("group") == F.col("_own_group"), F.lit(False)))
    return pairs.withColumn("on_intent", F.coalesce(mine, F.col("on_intent"))).drop("_own_group", "group")


def leave_one_out(slots: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(keyword, own app) x all other rows of the page; ``idx`` is the slot without the own.

    ``others`` are the rows to meet, if not all. Quadratic in the page, 250 slots at most:
    what looks at the top or around the own slot only takes ``near_rows``.
    """
    return _paired(_own(slots).join(slots if others is None else others, "keyword"))


def near_rows(slots: DataFrame, top_n: int = 10) -> DataFrame:
    """The pairs of ``leave_one_out`` in the first ``top_n`` or close to the own slot.

    Each app names the slots that it looks at, so the pairs grow with the rows.
    """
    near = F.sequence(F.greatest(F.col("own_slot") - BAND, F.lit(1)), F.col("own_slot") + BELOW)
    wanted = F.array_distinct(F.concat(F.sequence(F.lit(1), F.lit(top_n + 1)), near))
    return _paired(_own(slots).withColumn("slot", F.explode(wanted)).join(slots.hint("merge"), ["keyword", "slot"]))


def outside_rows(slots: DataFrame, entrants: DataFrame, top_n: int = 10) -> DataFrame:
    """The pairs of ``near_rows`` for apps that are not on the page: nobody is left out.

    ``entrants`` has (keyword, pkg, slot), the slot that an app would take or null, and
    ``group`` where pages are split.
    """
    near = F.sequence(F.greatest(F.col("own_slot") - BAND, F.lit(1)), F.col("own_slot") + BELOW)
    wanted = F.array_distinct(F.concat(F.sequence(F.lit(1), F.lit(top_n)), F.coalesce(near, F.array().cast("array<int>"))))
    own = _own(entrants.withColumn("slot", F.col("slot").cast("int"))).withColumn("slot", F.explode(wanted))
    return _by_group(own.join(slots.hint("merge"), ["keyword", "slot"]).withColumn("idx", F.col("slot")))


def _p(column: str | Column, q: float) -> Column:
    return F.percentile(column, F.lit(q))


def _if(condition: Column, value: Column | str) -> Column:
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def rates(prefix: str, where: Column) -> list[Column]:
    """Median yearly rates of a set: lifetime, of recent apps, as measured; counts."""
    recent = where & (F.col("days") > 0) & (F.col("age") <= 1.0)
    return [
        _zero(_p(_if(where, "floor_rate"), 0.5)).alias(f"{prefix}_all"),
        _zero(_p(_if(recent, "floor_rate"), 0.5)).alias(f"{prefix}_recent"),
        F.count_if(recent).alias(f"{prefix}_recent_n"),
        _zero(_p(_if(where, F.col("measured_per_day") * 365.0), 0.5)).alias(f"{prefix}_measured"),
        F.count(_if(where, "measured_per_day")).alias(f"{prefix}_measured_n"),
    ]


def _first(condition: Column, by: list[Column], value: str) -> Column:
    """``value`` of the first row by ``by`` among those that meet the condition."""
    return F.min(F.when(condition, F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], F.col(value).alias("v"))))["v"]


def summarise(pairs: DataFrame, top_n: int = 10) -> DataFrame:
    """One aggregate for every field statistic of a (keyword, own app), from ``near_rows``."""
    top = F.col("idx") <= top_n
    known, recent = top & (F.col("days") > 0), top & (F.col("days") > 0) & (F.col("age") <= 1.0)
    mine = top & F.col("on_intent")
    fresh_mine = mine & (F.col("days") > 0) & (F.col("age") <= 1.0)
    gap = F.abs(F.col("slot") - F.col("own_slot"))
    placed = F.col("own_slot").isNotNull()  # an app without a place has no neighbours
    near, below = (gap > 0) & (gap <= BAND), (F.col("slot") > F.col("own_slot")) & (F.col("slot") <= F.col("own_slot") + BELOW)
    slot = F.col("slot")
    rest = top & (F.col("idx") > 1)
    q = lambda c, where, x: _p(_if(where, F.col(c).cast("double")), x)
    return pairs.groupBy(*KEY).agg(
        F.count_if(top).alias("n"),
        q("installs", top, 0.1).alias("installs_p10"), q("installs", top, 0.5).alias("installs_p50"), q("installs", top, 0.9).alias("installs_p90"),
        q("rating", top, 0.5).alias("rating_p50"), q("reviews", top, 0.5).alias("reviews_p50"),
        _zero(q("age", known, 0.5)).alias("age_p50"), _zero(F.min(_if(known, "age"))).alias("newest_entrant_age"),
        _zero(q("age", known, 0.9) - q("age", known, 0.1)).alias("age_spread"), (F.count_if(known) / F.greatest(F.count_if(top), F.lit(1))).alias("age_known_frac"),
        q("stale_days", top, 0.5).alias("staleness_p50"),
        F.count_if(recent).alias("newcomers"), F.coalesce(F.max(_if(recent, "installs")), F.lit(0)).alias("newcomer_installs"),
        _first(top, [F.col("installs"), slot], "installs").alias("weakest_installs"), _first(top, [F.col("installs"), slot], "slot").alias("weakest_rank"), _first(top, [F.col("installs"), slot], "title").alias("weakest_title"),
        F.count_if(top & F.col("exact")).alias("exact_match_count"),
        q("relevance", top, 0.5).alias("relevance_p50"), (_first(top, [F.col("idx")], "relevance") - _first(top, [-F.col("idx")], "relevance")).alias("relevance_drop"),
        F.count_if(mine).alias("relevant_count"), _zero(q("installs", mine, 0.5)).alias("installs_p50_relevant"), (F.count_if(mine) == 0).cast("int").alias("no_intent"),
        *rates("page", top), *rates("intent", mine), *rates("band", near), *rates("below", below),
        F.array_sort(F.collect_list(_if(mine, "slot"))).alias("_run"),
        F.coalesce(F.min(_if(fresh_mine, "slot")), F.lit(0)).alias("recent_best_rank"), _zero(_first(fresh_mine, [slot], "rate")).alias("recent_rate_at_best"),
        _zero(_first(mine & placed, [gap, slot], "rate")).alias("neighbour_rate"), _zero(_first(mine & placed, [gap, slot], "age")).alias("neighbour_age"),
        _zero(_first(fresh_mine & placed, [gap, slot], "rate")).alias("recent_neighbour_rate"), F.coalesce(F.min(_if(fresh_mine, gap)), F.lit(0)).alias("recent_neighbour_gap"),
        F.count_if(near).alias("band_evidence"),
        _first(top, [F.col("idx")], "exact").cast("double").alias("leader_match"), _first(top, [F.col("idx")], "relevance").alias("leader_relevance"),
        (F.log1p(_first(top, [F.col("idx")], "installs")) - F.log1p(F.coalesce(q("installs", rest, 0.5), q("installs", top, 0.5)))).alias("leader_lead"),
        F.coalesce(F.min(_if(top & F.col("exact"), "idx")), F.lit(0)).alias("first_match_rank"),
        _first(top, [F.col("idx")], "breadth").alias("leader_breadth"),
        (F.log1p(_first(top, [F.col("idx")], "breadth")) - F.log1p(F.coalesce(q("breadth", rest, 0.5), q("breadth", top, 0.5)))).alias("breadth_gap"),
        _zero(_first(known, [F.col("days"), slot], "rate")).alias("newest_rate"), F.coalesce(_first(known, [F.col("days"), slot], "slot"), F.lit(0)).alias("newest_rank"),
        q("advantage", top, 0.9).alias("advantage_p90"), q("advantage", top, 0.5).alias("advantage_p50"), _first(top, [F.col("idx")], "advantage").alias("leader_advantage"),
    ).withColumns({
        "intent_cut": F.size(F.filter(F.col("_run"), lambda x, i: x == i + 1)),
        "match_starts_below": F.greatest(F.col("first_match_rank") - 1, F.lit(0)),
    }).withColumn("intent_cut_share", F.col("intent_cut") / F.greatest(F.col("n"), F.lit(1))).drop("_run")


def rate_gap(rate: Column, days: Column, norm: Column) -> Column:
    """Signed log gap of a rate to what its age earns; 0 without an age or a norm."""
    return F.when((days > 0) & (norm > 0), F.log1p(rate) - F.log1p(norm)).otherwise(0.0)


def advantage(rate: Column, days: Column, norm: Column) -> Column:
    gap = rate_gap(rate, days, norm)
    return F.when(gap > 0, 1.0 - F.exp(-gap / SCALE)).otherwise(0.0)


def with_peer_norms(slots: DataFrame) -> DataFrame:
    """Fill a missing age norm with the median rate of page peers within half to twice the age."""
    peers = slots.select("keyword", F.col("pkg").alias("_pkg"), F.col("age").alias("_age"), F.col("rate").alias("_rate"), F.col("days").alias("_days"))
    asks = slots.where("age_norm <= 0 and days > 0").select("keyword", "pkg", "age")
    pairs = asks.join(peers, "keyword").where("_pkg <> pkg and _days > 0 and _age >= 0.5 * age and _age <= 2.0 * age")
    medians = pairs.groupBy("keyword", "pkg").agg(F.percentile("_rate", 0.5).alias("_norm"))
    joined = slots.join(medians, ["keyword", "pkg"], "left")
    return joined.withColumn("age_norm", F.when(F.col("age_norm") > 0, F.col("age_norm")).otherwise(F.coalesce("_norm", F.lit(0.0)))).drop("_norm")


def prepared(context: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Slots with peer norms, advantage, rate gap and intent by relevance.

    With ``groups`` (keyword, pkg, group), the competition of an app is its own group;
    relevance decides only for apps that are in none.
    """
    rows = with_peer_norms(context)
    if groups is not None:
        rows = rows.join(groups.select("keyword", "pkg", "group").hint("merge"), ["keyword", "pkg"], "left")
    args = F.col("rate"), F.col("days"), F.col("age_norm")
    return rows.withColumn("advantage", advantage(*args)).withColumn("rate_vs_age", rate_gap(*args)).withColumn("on_intent", F.col("relevance") >= RELEVANT)


YOUNG, DATED = "days > 0 and age <= 1.5", "days > 0 and installs > 0"


def unaided_recent(slots: DataFrame) -> DataFrame:
    """Weighted median rate of the page's other apps up to 1.5 years old, weight 1 - advantage.

    No app meets the others: the young apps of a page are put in order of their rate once,
    with running sums of their weights. Without an app of weight w at place k the median
    is the first app whose sum reaches half of what is left: by sum S_i >= (W - w) / 2
    before k, by S_i >= (W + w) / 2 after it. Both are searched by sorting the thresholds
    in among the sums.
    """
    page = Window.partitionBy("keyword")
    young = F.expr(YOUNG)
    rows = slots.select("keyword", F.col("pkg").alias("own_pkg"), F.col("slot").alias("own_slot"), F.when(young, F.col("rate")).alias("_rate"), F.when(young, 1.0 - F.col("advantage")).alias("_w"))
    order = page.orderBy(F.col("_w").isNull(), "_rate", "_w", "own_slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_seen", F.when(F.col("_w").isNotNull(), F.sum("_w").over(order))).withColumn("_k", F.when(F.col("_w").isNotNull(), F.count("_w").over(order))).withColumn("_all", F.sum("_w").over(page))
    w = F.coalesce("_w", F.lit(0.0))
    others = F.count("_w").over(page) - F.col("_w").isNotNull().cast("int")
    # a place in the order (kind 1), or one of the two thresholds of an app (kind 0: before places of that sum)
    entry = lambda kind, at, part: F.struct(F.round(at, 9).alias("at"), F.lit(kind).alias("kind"), F.lit(part).alias("part"))
    entries = F.filter(F.array(entry(1, F.col("_seen"), 0), entry(0, (F.col("_all") - w) / 2, 1), entry(0, (F.col("_all") + w) / 2, 2)), lambda e: e["at"].isNotNull())
    line = rows.withColumn("_others", others).withColumn("_left", F.col("_all") - w).withColumn("_e", F.explode(entries))
    down = page.orderBy(F.desc("_e.at"), F.desc("_e.kind"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_hit", F.last(F.when(F.col("_e.kind") == 1, F.struct("_rate", "_k")), ignorenulls=True).over(down)).where("_others > 0")
    hit = lambda part: F.max(F.when(F.col("_e.part") == part, F.col("_hit")))
    own = found.groupBy(*KEY).agg(hit(1).alias("_low"), hit(2).alias("_high"), F.max("_k").alias("_k"), F.max("_left").alias("_left"))
    rate = F.when(F.col("_k").isNull() | (F.col("_low._k") < F.col("_k")), F.col("_low._rate")).otherwise(F.col("_high._rate"))
    some = F.col("_left") > 1e-6
    return own.select(*KEY, F.when(some, rate).otherwise(0.0).alias("unaided_recent_rate"), F.when(some, F.col("_left")).otherwise(0.0).alias("unaided_recent_evidence"))


def page_curve(slots: DataFrame, least: int = 6) -> DataFrame:
    """Least squares of log rate on rank and log age over the page's other dated apps, and its value at the own rank.

    No app meets the others: the page's sums, taken about its means, lose the own terms.
    """
    page = Window.partitionBy("keyword")
    dated = F.expr(DATED)
    of = lambda c: F.when(dated, c)
    rows = slots.select("keyword", F.col("pkg").alias("own_pkg"), F.col("slot").alias("own_slot"), of(F.col("slot").cast("double")).alias("_x"), of(F.log1p("days")).alias("_z"), of(F.log1p("rate")).alias("_y"))
    centred = rows.withColumns({f"_c{c}": F.avg(f"_{c}").over(page) for c in "xzy"}).withColumns({c: F.col(f"_{c}") - F.col(f"_c{c}") for c in "xzy"})
    terms = {"m": F.when(F.col("x").isNotNull(), 1.0), "x": F.col("x"), "z": F.col("z"), "y": F.col("y"), "xx": F.expr("x * x"), "zz": F.expr("z * z"), "yy": F.expr("y * y"), "xz": F.expr("x * z"), "xy": F.expr("x * y"), "zy": F.expr("z * y")}
    s = centred.select("*", *[(F.coalesce(F.sum(t).over(page), F.lit(0.0)) - F.coalesce(t, F.lit(0.0))).alias(f"s{n}") for n, t in terms.items()])
    # the youngest of the others: the second youngest for the youngest itself
    ages = page.orderBy(F.col("_z").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_z1", F.first("_z", ignorenulls=True).over(ages)).withColumn("_z2", F.nth_value("_z", 2, ignoreNulls=True).over(ages))
    s = s.withColumn("young", F.when(F.col("_z") == F.col("_z1"), F.col("_z2")).otherwise(F.col("_z1")))
    s = s.where("sm > 0").withColumns({"vx": F.expr("sxx / sm - sx * sx / (sm * sm)"), "vz": F.expr("szz / sm - sz * sz / (sm * sm)"), "vy": F.expr("syy / sm - sy * sy / (sm * sm)"), "cxz": F.expr("sxz / sm - sx * sz / (sm * sm)"), "cxy": F.expr("sxy / sm - sx * sy / (sm * sm)"), "czy": F.expr("szy / sm - sz * sy / (sm * sm)"), "ax": F.expr("_cx + sx / sm"), "az": F.expr("_cz + sz / sm"), "ay": F.expr("_cy + sy / sm")})
    s = s.withColumn("det", F.col("vx") * F.col("vz") - F.col("cxz") * F.col("cxz"))
    ok = (F.col("sm") >= least) & (F.col("det") > 1e-9)
    s = s.withColumn("b1", (F.col("cxy") * F.col("vz") - F.col("czy") * F.col("cxz")) / F.nullif("det", F.lit(0.0))).withColumn("b2", (F.col("czy") * F.col("vx") - F.col("cxy") * F.col("cxz")) / F.nullif("det", F.lit(0.0)))
    s = s.withColumn("b0", F.expr("ay - b1 * ax - b2 * az")).withColumn("_fit", F.when(F.col("vy") * F.col("sm") > 1e-9, F.expr("(b1 * cxy + b2 * czy) / vy")).otherwise(0.0))
    here = F.when(F.col("own_slot").isNotNull(), F.greatest(F.expm1(F.least(F.expr("b0 + b1 * own_slot + b2 * young"), F.lit(30.0))), F.lit(0.0))).otherwise(0.0)
    keep = lambda c: F.when(ok, c).otherwise(0.0)
    return s.select(*KEY, keep(F.col("b1")).alias("curve_rank_slope"), keep(F.col("b2")).alias("curve_age_slope"), keep(F.least(F.greatest("_fit", F.lit(-1.0)), F.lit(1.0))).alias("curve_fit"), keep(here).alias("curve_here"), F.when(ok, F.col("sm").cast("long")).otherwise(0).alias("curve_points"))


def featured_summary(cards: DataFrame) -> DataFrame:
    """Per keyword: a promoted card, its best relevance, its most installs."""
    return cards.groupBy("keyword").agg(F.lit(1).alias("has_featured"), F.max("relevance").alias("featured_relevance"), F.max("installs").alias("featured_installs"))


def _with_defaults(table: DataFrame) -> DataFrame:
    numbers = {c: 0 for c, kind in table.dtypes if c not in KEY and kind not in ("string",)}
    return table.fillna(numbers | {"weakest_rank": 99})


def field_table(slots: DataFrame, cards: DataFrame) -> DataFrame:
    """Every statistic of every (keyword, own app); an empty field gets its defaults."""
    own = _own(slots).select(*KEY)
    return _with_defaults(own.join(summarise(near_rows(slots)).hint("merge"), KEY, "left").join(unaided_recent(slots).hint("merge"), KEY, "left").join(page_curve(slots).hint("merge"), KEY, "left").join(featured_summary(cards), "keyword", "left"))


def outside_table(slots: DataFrame, entrants: DataFrame, cards: DataFrame) -> DataFrame:
    """The same for apps that are not on the page, ``entrants`` as in ``outside_rows``.

    An app without age and installs adds nothing to a page's sums, so as one more row of
    the page it reads the sums of all others.
    """
    key = ["keyword", "own_pkg"]
    sums = ["keyword", "pkg", "slot", "days", "age", "installs", "rate", "advantage"]
    nothing = {"days": 0, "age": 0.0, "installs": 0, "rate": 0.0, "advantage": 0.0}
    kinds = dict(slots.dtypes)
    guests = entrants.select("keyword", "pkg", F.col("slot").cast(kinds["slot"]).alias("slot"), *[F.lit(v).cast(kinds[c]).alias(c) for c, v in nothing.items()])
    shown = slots.select(*sums).unionByName(guests)
    tables = (summarise(outside_rows(slots, entrants)), unaided_recent(shown), page_curve(shown))
    out = _own(guests).select(*KEY)
    for t in tables:
        out = out.join(t.drop("own_slot").hint("merge"), key, "left")
    return _with_defaults(out.join(featured_summary(cards), "keyword", "left"))
