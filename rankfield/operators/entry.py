"""Where a new app would enter a page, answered whole: rank, chance, downloads, verdict."""

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.operators import features as fx
from rankfield.operators import field, intent, models, scoring
from rankfield.sources.storage import kept

FULL_EVIDENCE = 25


class Fitted(NamedTuple):
    """What scoring an entrant takes from training."""

    rankers: list[PipelineModel]
    scaler: DataFrame  # of the table that the rankers and heads were fitted on
    columns: list[str]
    n_keywords: int
    rates: list[PipelineModel]  # page-relative download models
    heads: list[PipelineModel]  # answer where a page has no dated app
    log_cap: float  # the largest log rate that training has seen


def entrant_rows(entrants: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """``entrants`` with the columns of page context: no age, no rate, and the slot that
    ``ranks`` (keyword, entry_rank) gives them, if any. A ``cosine`` to the keyword is kept."""
    rows = entrants if ranks is None else entrants.join(ranks.select("keyword", "entry_rank").hint("merge"), "keyword")
    slot = F.lit(None).cast("int") if ranks is None else F.col("entry_rank").cast("int")
    fixed = {"slot": slot, "days": F.lit(0), "age": F.lit(0.0), "stale_days": F.lit(0), "rate": F.lit(0.0), "source": F.lit("entrant"), "group": F.lit(0)}
    return rows.withColumns(fixed if "cosine" in entrants.columns else fixed | {"cosine": F.lit(0.0)})


def entrant_features(rows: DataFrame, membership: DataFrame, entrants: DataFrame, cards: DataFrame, suggestions: DataFrame, history: DataFrame) -> DataFrame:
    """The features of ``entrants`` (from ``entrant_rows``) against the whole page ``rows``.

    The own group is the one that holds the top of the page, which is the first.
    """
    fields = kept(field.outside_table(rows, entrants, cards), "entrant-fields")
    return fx.extract_features(entrants, fields, intent.outside_stats(rows.drop("group"), membership, entrants), suggestions, history)


def aligned(features: DataFrame, fitted: Fitted) -> DataFrame:
    return fx.sign_align(fx.apply_scaler(features, fitted.scaler, fitted.columns))


def entries(page: DataFrame, entrants: DataFrame, cards: DataFrame, overrides: DataFrame, n_keywords: int) -> DataFrame:
    """Rank, chance, confidence and crowding of each page's entrant.

    ``page`` and ``entrants`` have the logit of each row by each member. The page is one
    that ranks by the members, not by what was seen, so both sides are judged alike. A
    keyword without a page has no answer; one member alone has no agreement. Scores are
    told apart to nine digits, as a mean's last ones depend on the order of its members.
    """
    mean = F.round("logit", 9)
    seen = kept(scoring.ensemble_scores(page).select("keyword", "pkg", mean.alias("score")), "page-scores")
    new = scoring.ensemble_scores(entrants).withColumn("logit", mean).withColumn("agreement", scoring.agreement(F.col("spread")))
    told = new.select("keyword", "pkg", F.col("logit").alias("score"), (1.0 / (1.0 + F.exp(-F.col("logit")))).alias("chance"), "agreement").withColumn("evidence", F.lit(min(n_keywords / FULL_EVIDENCE, 1.0)))
    ranks = scoring.entry_ranks(seen, told, cards)
    return ranks.join(told.hint("merge"), "keyword").join(scoring.crowding(seen, overrides).hint("merge"), "keyword").withColumn("confidence", F.col("agreement") * F.col("evidence"))


def _over_members(fitted: list[DataFrame], value: str) -> DataFrame:
    """Mean and spread of a log rate over the members, none where one answers alone."""
    each = fitted[0]
    for more in fitted[1:]:
        each = each.unionByName(more)
    return each.groupBy("keyword").agg(F.avg(value).alias("_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_spread"))


def downloads(rows: DataFrame, ranked: DataFrame, features: DataFrame, fitted: Fitted, as_of: str) -> DataFrame:
    """Yearly, monthly and daily downloads of an entrant at the rank it was given.

    ``ranked`` are entrants with that rank as ``slot``, ``features`` theirs. The page's
    dated apps answer where there are any, the fitted heads elsewhere. Caveats speak of
    the page's answer only.
    """
    day = F.lit(as_of).cast("date")
    own = ranked.select("keyword", F.col("pkg").alias("own_pkg"), F.col("slot").alias("own_slot"))
    points = fx.download_points(rows.where("released_at is not null").join(own.hint("merge"), "keyword"))
    kernel = kept(models.kernel_features(fx.describe_points(points, day, day)), "entrant-kernel")
    page = _over_members([models.predict_rates(m, kernel).select("keyword", "log_rate_hat") for m in fitted.rates], "log_rate_hat").select("keyword", F.col("_mean").alias("_p"), F.col("_spread").alias("_ps"))
    asked = kept(aligned(features, fitted).withColumn("rank", (F.col("slot") - 1) / 10.0), "entrants-at-rank")
    head = _over_members([m.transform(asked).select("keyword", "rate_hat") for m in fitted.heads], "rate_hat")
    both = head.join(page.hint("merge"), "keyword", "left")
    figures = scoring.download_figures(F.coalesce("_p", "_mean"), F.coalesce("_ps", "_spread"), fitted.log_cap)
    by_page = F.col("_p").isNotNull()
    told = both.select("keyword", F.when(by_page, "page").otherwise("head").alias("answered_by"), *[c.alias(k) for k, c in figures.items()])
    why = scoring.download_caveats(rows, ranked.select("keyword", F.col("slot").alias("entry_rank")))
    return told.join(why.hint("merge"), "keyword", "left").withColumn("caveats", F.when(F.col("answered_by") == "page", F.col("caveats")).otherwise(F.array().cast("array<string>")))


def score_entries(
    rows: DataFrame, membership: DataFrame, features: DataFrame, entrants: DataFrame, cards: DataFrame, suggestions: DataFrame, history: DataFrame, overrides: DataFrame, fitted: Fitted, as_of: str, thresholds: dict[str, float] | None = None
) -> DataFrame:
    """One answer for each keyword: where its entrant would land and what that brings.

    ``rows`` are prepared pages split by ``membership``, ``features`` the aligned features
    of their apps, ``entrants`` one app for each keyword. The entrant is scored without a
    rank, as nobody knows it yet; the rank that comes out is where the download question
    is asked. The ranker is not asked again with its own answer.
    """
    context = (rows, membership)
    blind = kept(entrant_features(*context, entrant_rows(entrants), cards, suggestions, history), "entrant-features")
    page = kept(models.member_scores(fitted.rankers, features), "page-logits")
    logits = kept(models.member_scores(fitted.rankers, aligned(blind, fitted)), "entrant-logits")
    answers = kept(entries(page, logits, cards, overrides, fitted.n_keywords), "entries")
    ranked = kept(entrant_rows(entrants, answers), "ranked-entrants")
    there = entrant_features(*context, ranked, cards, suggestions, history)
    whole = answers.join(downloads(rows, ranked, there, fitted, as_of).hint("merge"), "keyword")
    judged = scoring.recommend(whole, thresholds or {}).select("keyword", "rank_chance", "certainty", "shortfalls", "meets_thresholds", "verdict")
    return whole.join(judged.hint("merge"), "keyword")


def fit_rates(kernel: DataFrame, k: int = 7) -> list[PipelineModel]:
    """A page-relative model for each resample of the own apps of ``kernel``."""
    drawn = kept(fx.bootstrap_resamples(kernel, k, ("keyword", "own_pkg")), "rate-resamples")
    return [models.fit_page_relative_rates(drawn.where(F.col("member") == i).drop("member")) for i in range(k)]
