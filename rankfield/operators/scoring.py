"""Scores to ranks, bands, verdicts and sentences."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions import parse
from rankfield.functions import text as tx
from rankfield.operators.evaluate import exact_percentiles
from rankfield.sources.storage import kept

TOP_K = 10


def ensemble_scores(members: DataFrame) -> DataFrame:
    """Mean logit, and mean and sample spread of the probability, over the members."""
    p = 1.0 / (1.0 + F.exp(-F.col("logit")))
    return members.groupBy("keyword", "pkg").agg(F.avg("logit").alias("logit"), F.avg(p).alias("chance"), F.stddev_samp(p).alias("spread"))


def agreement(spread: Column) -> Column:
    return 1.0 - F.least(spread / 0.5, F.lit(1.0))


def confidence(spread: Column, n_keywords: Column) -> Column:
    """Agreement times evidence: members fitted to few keywords agree and know little."""
    return agreement(spread) * F.least(n_keywords / 25.0, F.lit(1.0))


def thompson_draw(members: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Each row scored by one member, picked by a hash of the row."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", "keyword", "pkg", F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return members.where(F.col("member") == place % k)


def download_figures(mean: Column, spread: Column, cap: float) -> dict[str, Column]:
    """Yearly, monthly, daily, low and high counts from log predictions."""
    undo = lambda x: F.expm1(F.least(F.greatest(x, F.lit(0.0)), F.lit(cap)))
    s = F.least(spread, F.lit(2.0))
    year = undo(mean)
    return {"per_year": year, "per_month": year / 12.0, "per_day": year / 365.0, "low_per_year": undo(mean - s), "high_per_year": undo(mean + s)}


def download_caveats(slots: DataFrame, entries: DataFrame) -> DataFrame:
    """Why a page's download figure may be worth little; ``entries`` has (keyword, entry_rank)."""
    pages = slots.join(entries, "keyword").groupBy("keyword").agg(
        F.bool_or((F.col("slot") < F.col("entry_rank")) & F.col("released_at").isNotNull()).alias("_above"), F.bool_or("exact").alias("_exact"), F.count("*").alias("_n"), F.count("released_at").alias("_dated")
    )
    unread = F.when((F.col("_dated") > 0) & ~F.col("_above"), "nothing ranks above this slot")
    unnamed = F.when(~F.col("_exact"), F.concat(F.lit("none of the "), F.col("_n").cast("string"), F.lit(" apps carry the phrase in their title")))
    return pages.select("keyword", F.array_compact(F.array(unread, unnamed)).alias("caveats"))


def predicted_ranks(scored: DataFrame) -> DataFrame:
    """1 + the incumbents (own app excluded) with a higher score; ties share a rank."""
    return scored.withColumn("predicted_rank", F.rank().over(Window.partitionBy("keyword").orderBy(F.desc("score"))))


def hypothetical_entrants(keywords: DataFrame, as_of: str) -> DataFrame:
    """One well-optimised new app for each keyword."""
    kw = F.col("keyword")
    day = F.lit(as_of).cast("date")
    return keywords.select("keyword", F.lit("__hypothetical__").alias("pkg"), F.initcap(kw).alias("title"), kw.alias("short_desc"), F.repeat(F.concat(kw, F.lit(". ")), F.lit(8)).alias("description"), F.lit(0).cast("long").alias("installs"), F.lit(0.0).alias("rating"), F.lit(0).cast("long").alias("reviews"), day.alias("released_at"), day.alias("updated_at"))


def entry_ranks(scored: DataFrame, entrants: DataFrame, cards: DataFrame) -> DataFrame:
    """Rank of each keyword's entrant, with promoted cards shown above it."""
    above = scored.select("keyword", F.col("score").alias("_s")).join(entrants.select("keyword", F.col("score").alias("_e")), "keyword")
    ranks = above.groupBy("keyword").agg((F.count_if(F.col("_s") > F.col("_e")) + 1).alias("entry_rank"), F.count("*").alias("_n"))
    promoted = cards.groupBy("keyword").agg(F.count("*").alias("_cards"))
    shown = F.coalesce("_cards", F.lit(0))
    return ranks.join(promoted, "keyword", "left").select("keyword", "entry_rank", (F.col("entry_rank") + shown).alias("displayed_rank"), (F.col("_n") + 1 + shown).alias("field_size"))


def score_quantiles(scored: DataFrame) -> DataFrame:
    """One row: the 0th to 100th percentile of the score."""
    return exact_percentiles(scored, F.col("score"), [i / 100 for i in range(101)]).select(F.col("values").alias("quantiles"))


def to_percentile(quantiles: Column, value: Column) -> Column:
    return F.size(F.filter(quantiles, lambda q: q < value))


def crowding(scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Percentile of the score that holds the last qualifying slot; an override wins."""
    order = Window.partitionBy("keyword").orderBy(F.desc("score"), "pkg")
    gate = scored.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("keyword"))).where(F.col("_r") == F.least(F.col("_n"), F.lit(TOP_K)))
    held = gate.crossJoin(F.broadcast(score_quantiles(scored))).select("keyword", to_percentile(F.col("quantiles"), F.col("score")).alias("_c"))
    return held.join(overrides.select("keyword", F.col("value").alias("_v")), "keyword", "left").select("keyword", F.coalesce("_v", F.col("_c").cast("double")).alias("crowding"), F.col("_v").isNotNull().alias("overridden"))


def rank_band(rank: Column) -> Column:
    return F.when(rank <= 3, "strong").when(rank <= TOP_K, "winnable").when(rank <= 3 * TOP_K, "borderline").otherwise("unlikely")


def rank_verdict(rank: Column) -> Column:
    return F.when(rank <= 3, "BUILD IT").when(rank <= TOP_K, "WORTH A TRY").otherwise("SKIP")


def demand_band(score: Column) -> Column:
    return F.when(score >= 70, "more demand").when(score >= 40, "moderate demand").when(score >= 0, "less demand")


def crowding_band(score: Column) -> Column:
    return F.when(score >= 80, "too crowded").when(score >= 60, "crowded").when(score >= 35, "moderately crowded").when(score >= 0, "less crowded")


def shortfalls(chance: Column, certainty: Column, rank: Column, downloads: Column, thresholds: dict[str, float]) -> Column:
    """Array of the thresholds a row fails; 0 turns one off."""
    limit = lambda k: F.lit(thresholds.get(k, 0))
    under = lambda k, v: (limit(k) > 0) & (v < limit(k))
    return F.array_compact(F.array(
        F.when(under("min_chance", chance), "chance"), F.when(under("min_certainty", certainty), "certainty"),
        F.when((limit("max_rank") > 0) & (rank > limit("max_rank")), "rank"), F.when(under("min_downloads", downloads), "downloads"),
    ))


def recommend(entries: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rank, chance and certainty in percent, failed thresholds and the verdict."""
    chance, certainty = F.round(F.col("chance") * 100).cast("int"), F.round(F.col("confidence") * 100).cast("int")
    failed = shortfalls(chance, certainty, F.col("entry_rank"), F.col("per_year"), thresholds)
    return entries.select("keyword", F.col("entry_rank").alias("rank"), chance.alias("rank_chance"), certainty.alias("certainty"), failed.alias("shortfalls"), (F.size(failed) == 0).alias("meets_thresholds"), rank_verdict(F.col("entry_rank")).alias("verdict"))


def field_report(fields: DataFrame) -> DataFrame:
    """Page statistics of a keyword as they are shown."""
    return fields.select(
        "keyword", "n", "installs_p10", "installs_p50", "installs_p90", "rating_p50", "exact_match_count", F.round("age_p50", 1).alias("age_p50_years"), "newcomers", "newcomer_installs", F.round("newest_entrant_age", 2).alias("newest_entrant_age"),
        F.round("age_known_frac", 2).alias("age_known_frac"), "weakest_installs", "weakest_rank", "weakest_title", F.round(F.log10(F.col("installs_p90") + 1) - F.log10(F.col("installs_p10") + 1), 2).alias("spread"),
        F.round("page_all", 1).alias("velocity_p50"), "relevant_count", F.round("relevance_p50", 2).alias("relevance_p50"), "installs_p50_relevant", F.round("age_spread", 1).alias("age_spread"),
        # the bar: what half of the page has
        F.col("installs_p50").alias("bar_installs"), F.col("rating_p50").alias("bar_rating"), (F.col("exact_match_count") >= F.greatest(F.floor(F.col("n") / 2), F.lit(1))).alias("keyword_in_title"),
    )


def narrative(pages: DataFrame) -> DataFrame:
    """Ordered sentences about a page, the strongest signal first."""
    n = F.col("n")
    text = lambda c: F.col(c).cast("string")
    card = F.when(F.col("featured_relevance") >= 0.40, "A promoted card that answers the phrase sits above the results.").when(F.col("has_featured") == 1, "A promoted card sits above the results.")
    few = F.floor(n / 3)
    meaning = F.when(F.col("relevant_count") == 0, "No app on the page is about the phrase.").when(F.col("relevant_count") <= F.greatest(few, F.lit(2)), F.concat(text("relevant_count"), F.lit(" of "), text("n"), F.lit(" apps answer the phrase, around "), parse.human_number(F.col("installs_p50_relevant")), F.lit(" installs."))).otherwise(F.concat(F.lit("The phrase is well served: "), text("relevant_count"), F.lit(" of "), text("n"), F.lit(" apps answer it.")))
    opening = F.when(F.col("weakest_installs") < 10_000, F.concat(F.lit("An app with "), parse.human_number(F.col("weakest_installs")), F.lit(" installs holds rank "), text("weakest_rank"), F.lit(".")))
    door = F.when(F.col("newcomers") > 0, F.concat(text("newcomers"), F.lit(" of them launched within a year."))).when(F.col("age_known_frac") > 0, "None of them launched within a year.")
    return pages.select("keyword", F.concat_ws(" ", card, meaning, opening, door).alias("narrative"))


def page_story(pages: DataFrame) -> DataFrame:
    """(keyword, story): what is known of a page and of the group of apps that answer the
    same question as the newcomer would, in order of weight.

    ``pages`` has the field statistics of a page (scraped: its apps; n: those at the top)
    and, where the page is split, the group's ``group_size``, ``group_best_rank``,
    ``group_median_installs``, ``group_weakest_installs``, ``group_newcomers`` and
    ``group_newcomer_installs``; then ``demand`` (0 to 100, or null) and ``entry_rank``
    (null without a ranker).
    """
    said = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    short = parse.human_number
    n, scraped, size, rank = F.col("n"), F.col("scraped"), F.col("group_size"), F.col("entry_rank")
    blind = F.when(rank.isNull(), "There is no fitted ranker, so this is what was seen and no forecast.")
    card = F.when(F.col("featured_relevance") >= tx.RELEVANT, "A promoted card that answers the phrase holds the best place, so rank 1 is worth less.").when(F.col("has_featured") == 1, "A promoted card above the results takes a share of the visits.")
    meaning = (
        F.when(size.isNull(), "The page does not split by meaning.")
        .when(size == 1, said("One app only answers this question: ", short(F.col("group_weakest_installs")), " installs at rank ", F.col("group_best_rank"), "; the other ", scraped - 1, " answer another."))
        .when(size <= F.greatest(F.floor(scraped / 3), F.lit(2)), said(size, " of ", scraped, " apps answer this question, at about ", short(F.col("group_median_installs")), " installs; the rest are something else."))
        .otherwise(said("The question is well answered: ", size, " of ", scraped, " apps, at about ", short(F.col("group_median_installs")), " installs."))
    )
    weak = F.col("weakest_installs")
    opening = F.when((F.col("weakest_rank") <= n) & (weak < 10_000) & (size.isNull() | (F.col("group_weakest_installs") != weak)), said("Rank ", F.col("weakest_rank"), " is held with ", short(weak), " installs, so the top is not defended."))
    fresh, best = F.col("group_newcomers"), F.col("group_newcomer_installs")
    newest = F.round("newest_entrant_age", 1)
    door = F.when(F.col("age_known_frac") >= 0.5, (
        F.when((fresh > 0) & (size == 1), "It is under a year old, so there is a way in.")
        .when((fresh > 0) & (best >= 10_000), said(fresh, " of them are under a year old, the largest at ", short(best), " installs, so there is a way in."))
        .when(fresh > 0, said(fresh, " of them are under a year old, so there is a way in."))
        .when((fresh == 0) & (newest >= 4), said("Nothing new has come in for ", F.floor(newest).cast("int"), " years."))
        .when(F.col("newcomers") >= 2, said(F.col("newcomers"), " apps of the page are under a year old, though they answer another question."))
    ))
    demand = F.when(F.coalesce("demand", F.lit(50.0)) >= 70, "Many people search for it.").when(F.col("demand") < 40, "Few people search for it, which limits what any rank brings.")
    call = F.when(rank <= TOP_K, said("A well-made newcomer would enter at about rank ", rank, ", where the installs are.")).when(rank > TOP_K, said("A well-made newcomer would enter at about rank ", rank, ", below where the installs are."))
    return pages.select("keyword", F.concat_ws(" ", blind, card, meaning, opening, door, demand, call).alias("story"))


def counterfactual(features: DataFrame, coefficients: DataFrame, names: list[str], gate_slot: int = TOP_K) -> DataFrame:
    """(keyword, pkg, feature, yours, theirs, gain) against the holder of the gate slot:
    the first slot from ``gate_slot`` on, else the last. Linear in the coefficients."""
    last = features.groupBy("keyword").agg(F.coalesce(F.min(F.when(F.col("slot") >= gate_slot, F.col("slot"))), F.max("slot")).alias("_g"))
    gate = features.join(last, "keyword").where("slot = _g").select("keyword", F.array(*[F.col(n).cast("double") for n in names]).alias("_theirs"))
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("yours"), F.get("_theirs", i).alias("theirs")) for i, n in enumerate(names)])
    apart = features.join(gate, "keyword").select("keyword", "pkg", F.explode(F.filter(cells, lambda x: x["yours"] != x["theirs"])).alias("_x")).select("keyword", "pkg", "_x.*")
    gain = F.col("coefficient") * (F.col("theirs") - F.col("yours"))
    # a coefficient for each feature: as few as the features
    return apart.join(F.broadcast(coefficients), "feature").select("keyword", "pkg", "feature", "yours", "theirs", gain.alias("gain"))


def what_if(features: DataFrame, names: list[str], score: Callable[[DataFrame], DataFrame], gate_slot: int = TOP_K) -> DataFrame:
    """(keyword, pkg, feature, yours, theirs, gain, closable) for any model, by scoring it again.

    Every row is scored as it is and once for each feature in which it differs from the
    holder of the gate slot, with that feature swapped; then once with all swaps that
    gained. ``score`` adds a ``score`` to rows that have the columns ``names``: all probes
    are rows of one table, so a model scores them in one pass.
    """
    last = features.groupBy("keyword").agg(F.coalesce(F.min(F.when(F.col("slot") >= gate_slot, F.col("slot"))), F.max("slot")).alias("_g"))
    gate = features.join(last, "keyword").where("slot = _g").select("keyword", F.array(*[F.col(n).cast("double") for n in names]).alias("_theirs"))
    own = features.join(gate, "keyword").select("keyword", "pkg", F.array(*[F.col(n).cast("double") for n in names]).alias("_yours"), "_theirs")

    def scored(rows: DataFrame, *more: str) -> DataFrame:
        return score(rows.select("keyword", "pkg", *more, *[F.get("_x", i).alias(n) for i, n in enumerate(names)])).select("keyword", "pkg", *more, "score")

    differs = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.get("_yours", i) != F.get("_theirs", i))
    probes = own.select("*", F.explode(F.concat(F.array(F.lit(-1)), differs)).alias("_i"))
    swapped = F.transform("_yours", lambda x, i: F.when(i == F.col("_i"), F.get("_theirs", i)).otherwise(x))
    once = kept(scored(probes.select("keyword", "pkg", "_i", swapped.alias("_x")), "_i"), "what-if")
    base = once.where("_i < 0").select("keyword", "pkg", F.col("score").alias("_base"))
    gains = once.where("_i >= 0").join(base.hint("merge"), ["keyword", "pkg"]).select("keyword", "pkg", "_i", (F.col("score") - F.col("_base")).alias("gain"))
    up = gains.groupBy("keyword", "pkg").agg(F.collect_set(F.when(F.col("gain") > 0, F.col("_i"))).alias("_up"))
    best = F.transform("_yours", lambda x, i: F.when(F.array_contains("_up", i), F.get("_theirs", i)).otherwise(x))
    whole = scored(own.join(up.hint("merge"), ["keyword", "pkg"]).select("keyword", "pkg", best.alias("_x")))
    told = gains.join(own.hint("merge"), ["keyword", "pkg"]).join(base.hint("merge"), ["keyword", "pkg"]).join(whole.hint("merge"), ["keyword", "pkg"])
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("_i"))
    return told.select("keyword", "pkg", feature.alias("feature"), F.get("_yours", F.col("_i")).alias("yours"), F.get("_theirs", F.col("_i")).alias("theirs"), "gain", (F.col("score") - F.col("_base")).alias("closable"))


def why(gains: DataFrame, up: int = 6, down: int = 3) -> DataFrame:
    """The largest gains and losses of each row, and all gains at once."""
    part = Window.partitionBy("keyword", "pkg")
    ranked = gains.withColumn("_up", F.row_number().over(part.orderBy(F.desc("gain"), "feature"))).withColumn("_down", F.row_number().over(part.orderBy("gain", "feature")))
    if "closable" not in gains.columns:  # of a linear model the sum of the gains; ``what_if`` scores them together
        ranked = ranked.withColumn("closable", F.sum(F.greatest("gain", F.lit(0.0))).over(part))
    return ranked.where(((F.col("gain") > 0) & (F.col("_up") <= up)) | ((F.col("gain") < 0) & (F.col("_down") <= down))).drop("_up", "_down")


def feature_pull(coefficients: DataFrame) -> DataFrame:
    """Mean absolute weight of each feature over the members, as a share of the largest."""
    mean = coefficients.groupBy("feature").agg(F.avg(F.abs("coefficient")).alias("_m"))
    most = mean.agg(F.max("_m").alias("_x"))
    return mean.crossJoin(F.broadcast(most)).select("feature", (F.col("_m") / F.col("_x")).alias("pull"))


def evidence_summary(observations: DataFrame, runs: DataFrame) -> DataFrame:
    seen = observations.agg(F.count_distinct("keyword").alias("keywords"))
    return seen.crossJoin(runs.where("active").agg(F.max("n_rows").alias("rows"))).withColumn("validated", F.col("keywords") >= 25)


def exact_titles(slots: DataFrame) -> DataFrame:
    return slots.withColumn("exact", tx.exact_match(F.col("title"), F.col("keyword")))
