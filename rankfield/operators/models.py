"""Rank and download estimators on ``pyspark.ml``, fitted and applied on tables."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.operators import features as fx
from rankfield.sources.storage import kept

WIDTHS = ((1.0, 0.2), (2.0, 0.5), (4.0, 1.0))


def _bounds(columns: list[str]) -> DenseMatrix:
    """Aligned monotone columns cannot count against an app; free ones can."""
    # finite: the solver scales bounds by the spread of a column, which may be 0
    return DenseMatrix(1, len(columns), [0.0 if c in fx.MONOTONE else -1e9 for c in columns])


def _logistic(columns: list[str], intercept: bool, weight: str | None) -> Pipeline:
    fit = LogisticRegression(featuresCol="x", labelCol="label", maxIter=25, regParam=0.01, elasticNetParam=0.0, fitIntercept=intercept, standardization=True, lowerBoundsOnCoefficients=_bounds(columns), **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), fit])


def fit_monotone_ranker(aligned: DataFrame, columns: list[str]) -> PipelineModel:
    """Chance of a top slot; never falls as an aligned monotone column rises."""
    return _logistic(columns, True, "weight").fit(aligned)


def fit_pairwise_ranker(aligned: DataFrame, pairs: DataFrame, columns: list[str]) -> PipelineModel:
    """Logistic loss on feature differences of (better, worse), both orientations."""
    a = aligned.select("keyword", F.col("pkg").alias("better"), F.array(*columns).alias("_a"))
    b = aligned.select("keyword", F.col("pkg").alias("worse"), F.array(*columns).alias("_b"))
    gaps = pairs.join(a, ["keyword", "better"]).join(b, ["keyword", "worse"]).select(F.zip_with("_a", "_b", lambda x, y: x - y).alias("d"))
    both = gaps.withColumn("label", F.lit(1.0)).unionByName(gaps.select(F.transform("d", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))
    rows = both.select("label", *[F.get("d", i).alias(c) for i, c in enumerate(columns)])
    return _logistic(columns, False, None).fit(kept(rows, "preference-pairs"))


def coefficients(model: PipelineModel, columns: list[str]) -> dict[str, float]:
    return dict(zip(columns, model.stages[-1].coefficients.toArray().tolist(), strict=True))


def scores(model: PipelineModel, aligned: DataFrame) -> DataFrame:
    """keyword, pkg, slot, logit."""
    raw = vector_to_array("rawPrediction")
    return model.transform(aligned).select("keyword", "pkg", "slot", F.get(raw, 1).alias("logit"))


def fit_members(aligned: DataFrame, columns: list[str], k: int = 7) -> list[PipelineModel]:
    """The ensemble: one ranker for each resample of the table."""
    resamples = kept(fx.bootstrap_resamples(aligned, k), "resamples")
    return [fit_monotone_ranker(resamples.where(F.col("member") == i), columns) for i in range(k)]


def mean_logit(models: list[PipelineModel], rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``, the members' mean logit."""
    columns, raw = rows.columns, vector_to_array("rawPrediction")
    out = rows.withColumn("score", F.lit(0.0))
    for m in models:
        out = m.transform(out).withColumn("score", F.col("score") + F.get(raw, 1)).select(*columns, "score")
    return out.withColumn("score", F.col("score") / len(models))


def member_scores(models: list[PipelineModel], aligned: DataFrame) -> DataFrame:
    out = None
    for i, m in enumerate(models):
        rows = scores(m, aligned).withColumn("member", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def kernel_features(described: DataFrame, widths: tuple[tuple[float, float], ...] = WIDTHS) -> DataFrame:
    """Per (keyword, own app): the page's level and kernel-weighted means relative to it.

    The level is the mean log rate of the points. Every other column is a difference, so
    a page that pays a thousand times more gives the same row.
    """
    key = ["keyword", "own_pkg"]
    level = described.groupBy(*key).agg(F.avg("log_rate").alias("level"))
    rows = described.join(level, key).withColumn("_r", F.col("log_rate") - F.col("level"))
    columns = {"rate": "_r", "newer": "newer", "by_rank": "by_rank", "apart": "apart", "ranks_apart": "ranks_apart", "above": "above", "age": "age"}
    sums: list[Column] = []
    for i, (days, ranks) in enumerate(widths):
        w = F.exp(-F.col("apart") / days - F.col("ranks_apart") / ranks)
        sums += [(F.sum(w * F.col(c)) / (F.sum(w) + 1e-9)).alias(f"{name}_{i}") for name, c in columns.items()]
    return rows.groupBy(*key, "level").agg(*sums)


def kernel_columns(widths: tuple[tuple[float, float], ...] = WIDTHS) -> list[str]:
    return [f"{c}_{i}" for i in range(len(widths)) for c in ("rate", "newer", "by_rank", "apart", "ranks_apart", "above", "age")]


def fit_page_relative_rates(kernel: DataFrame, target: str = "log_rate") -> PipelineModel:
    """Huber fit of the log rate relative to the page's level."""
    columns = kernel_columns()
    stages = [
        SQLTransformer(statement=f"SELECT *, {target} - level AS _y FROM __THIS__"),
        VectorAssembler(inputCols=columns, outputCol="x"),
        LinearRegression(featuresCol="x", labelCol="_y", predictionCol="_p", loss="huber", maxIter=60, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(kernel)


def predict_rates(model: PipelineModel, kernel: DataFrame) -> DataFrame:
    """keyword, own_pkg, log_rate_hat: the prediction with the level put back."""
    assembled = model.stages[1].transform(kernel)
    return model.stages[2].transform(assembled).select("keyword", "own_pkg", (F.col("_p") + F.col("level")).alias("log_rate_hat"))


def fit_rate_head(train: DataFrame, columns: list[str], rank: str = "rank") -> tuple[PipelineModel, list[str]]:
    """Weighted fit of young apps' log yearly rate; refitted without the own rank if a
    worse rank would earn more, as the solver has no bounds."""
    used = [c for c in columns if c not in fx.LEAKS]
    rows = train.where("rate_label is not null").withColumn(rank, (F.col("slot") - 1) / 10.0)

    def fit(names: list[str]) -> PipelineModel:
        regression = LinearRegression(featuresCol="x", labelCol="rate_label", predictionCol="rate_hat", weightCol="rate_weight", loss="squaredError", regParam=0.1)
        return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), regression]).fit(rows)

    model = fit([*used, rank])
    if model.stages[-1].coefficients[len(used)] <= 0:
        return model, [*used, rank]
    return fit(used), used
