"""Classifier fits on Spark ML: logistic regression, boosted trees, sweeps and leaderboards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from math import sqrt
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank import schemas, session
from weekrank.operators import columns, compiled, encode, evaluate, joins, levels, ordered

# The regularisation grid and the chosen strength.
C_GRID = [0.01, 0.1, 1.0, 10.0, 100.0]
BEST_C = 0.01
# Tree grids (capacity first, then learning and sampling) and the chosen settings.
CAPACITY_GRID = {"maxDepth": [3, 4, 5, 6, 7], "maxIter": [100, 200, 400, 800, 1500]}
SAMPLING_GRID = {"stepSize": [0.03, 0.05, 0.1], "minChildWeight": [1, 3, 5], "subsamplingRate": [0.6, 0.8, 1.0],
                 "featureSubset": [0.6, 0.8, 1.0]}
DEEP_TREES = {"maxDepth": 7, "maxIter": 1500, "stepSize": 0.05, "minChildWeight": 5, "subsamplingRate": 1.0,
              "featureSubset": 1.0}
SIMPLE_TREES = {"maxDepth": 4, "maxIter": 400, "stepSize": 0.1, "minChildWeight": 5, "subsamplingRate": 0.8,
                "featureSubset": 0.6}
SAMPLED_CAPACITIES = [{"maxDepth": 7, "maxIter": 1500}, {"maxDepth": 4, "maxIter": 400}]
STATIC_FEATURES = ["track_duration", "spotify_popularity"]

#: Boosting rounds between two checkpoints of the running predictions: what a lost executor costs, and the longest lineage.
CHECKPOINT_ROUNDS = 10
#: Fits of a sweep that are under way at the same time, so that their small jobs fill the cluster.
PARALLEL_FITS = 4

_OUTPUT = {"probabilityCol": "_probability", "rawPredictionCol": "_raw", "predictionCol": "_prediction"}


def model_input(df: DataFrame, features: Sequence[str], label: str = schemas.LABEL) -> DataFrame:
    """Features without gaps and an integer label; the same column list on every span."""
    return columns.with_defaults(df, features).withColumn(label, F.coalesce(F.col(label).cast("int"), F.lit(0)))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = schemas.LABEL, c: float = 1.0,
                 scale: bool = False, max_iter: int = 1000, rows: int | None = None, tol: float = 1e-6) -> PipelineModel:
    """L2 logistic regression with inverse strength `c`.

    The penalty is stated per summed loss (C form); Spark averages the loss, hence regParam = 1 / (C n). With `scale` the features
    have mean 0 and variance 1 over the n rows (Spark's scaler divides by n - 1; a second stage makes up for it).

    One wide vector that marks a level is fitted on tables instead (`levels.fit`): the same optimum, whatever the number of levels.
    """
    counted = levels.cells(df, features[0], label) if len(features) == 1 and not scale else None
    if counted is not None:
        intercept, table = levels.fit(counted[0], c, max_iter, tol)
        return PipelineModel([levels.LevelLogisticModel(intercept=intercept, table=table, size=counted[1], columns={"featuresCol": features[0], **_OUTPUT})])
    n = df.count() if rows is None else rows
    stages, at = [VectorAssembler(inputCols=list(features), outputCol="_features")], "_features"
    if scale:
        by_n = Vectors.dense([sqrt(n / (n - 1.0)) if n > 1 else 1.0] * len(features))
        stages += [StandardScaler(inputCol=at, outputCol="_scaled", withMean=True, withStd=True),
                   ElementwiseProduct(scalingVec=by_n, inputCol="_scaled", outputCol="_standard")]
        at = "_standard"
    stages.append(LogisticRegression(featuresCol=at, labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
                                     standardization=False, maxIter=max_iter, tol=tol, **_OUTPUT))
    return Pipeline(stages=stages).fit(session.compact(df))


def class_weight(df: DataFrame, label: str = schemas.LABEL) -> float:
    """Negatives per positive of the rows to fit on; 1 without positives."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    return counts["q"] / counts["p"] if counts["p"] else 1.0


def fit_trees(df: DataFrame, features: Sequence[str], label: str = schemas.LABEL, seed: int = 42,
              weight: float | None = None, **settings) -> PipelineModel:
    """Boosted trees with positives weighted by negatives / positives, or by `weight` (that of the training rows for a refit).

    The running predictions are checkpointed in the shared folder every CHECKPOINT_ROUNDS rounds, so that many rounds are
    neither one lineage nor lost with an executor. The first r trees of a fit are the fit with r rounds (`compiled.staged`).
    """
    settings, context = dict(settings), df.sparkSession.sparkContext
    session.checkpoint_dir(df.sparkSession)
    balance = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    if weight is None:
        weight = balance["q"] / balance["p"] if balance["p"] else 1.0
    rows = balance["p"] + balance["q"]
    leaf = settings.pop("minChildWeight", None)
    if leaf is not None:
        # A share of the total weight, which weights both classes with `q`.
        settings["minWeightFractionPerNode"] = min(0.49, leaf / max(2.0 * balance["q"], 1.0)) if rows else 0.0
    subset = settings.pop("featureSubset", None)
    if subset is not None:
        settings["featureSubsetStrategy"] = "all" if subset >= 1.0 else str(subset)
    weighted = df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    trees = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", seed=seed, predictionCol="_prediction", cacheNodeIds=True,
                          checkpointInterval=CHECKPOINT_ROUNDS if context.getCheckpointDir() else -1, **settings)
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    return Pipeline(stages=[assembler, trees]).fit(session.compact(weighted))


def first_cut(df: DataFrame, features: Sequence[str]) -> tuple[str, float] | None:
    """The first feature with two different values, and the middle of its two lowest; None where all are constant."""
    values = [F.col(f"`{f}`").cast("double") for f in features]
    lowest = df.agg(*[F.min(v) for v in values]).first()
    above = df.agg(*[F.min(F.when(v > F.lit(low), v)) for v, low in zip(values, lowest)]).first()
    return next(((f, (low + high) / 2.0) for f, low, high in zip(features, lowest, above) if high is not None), None)


def with_probability(df: DataFrame, model: PipelineModel, name: str = "probability") -> DataFrame:
    """Append the positive-class probability; intermediate columns are dropped."""
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn("_p", vector_to_array(F.col("_probability"))[1]).drop(*extra).withColumnRenamed("_p", name)


def compare(models: dict[str, PipelineModel], df: DataFrame, label: str = schemas.LABEL) -> DataFrame:
    """ROC-AUC and average precision of several models on one span."""
    rows = [
        evaluate.area_metrics(with_probability(df, model), label=label).select(F.lit(name).alias("model"), "*")
        for name, model in models.items()
    ]
    return ordered.union_all(*rows)


def model_summary(name: str, scored: DataFrame, threshold: float, k: int = 3, label: str = schemas.LABEL,
                  week: str = schemas.WEEK_TS, tie_break: Sequence[str] = schemas.ENTITY) -> DataFrame:
    """One line of the final comparison: area, hit and threshold metrics (one row each)."""
    areas = evaluate.holdout_metrics(scored, threshold, label=label)
    hits = evaluate.hit_rates(scored, k, label=label, week=week, tie_break=tie_break)
    return ordered.beside(areas, hits).select(F.lit(name).alias("model"), "*")


def side_by_side(spark: SparkSession, fits: Sequence[Callable[[], DataFrame]], parallel: int = PARALLEL_FITS) -> DataFrame:
    """The tables of several fits, `parallel` of which run at the same time; each is stored, so nothing is fitted again."""
    def one(run):
        return session.cut(run())
    with ThreadPool(max(1, parallel)) as pool:
        return ordered.union_all(*pool.map(inheritable_thread_target(spark)(one), fits))


def sweep_logistic(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = schemas.LABEL,
                   grid: Sequence[float] = C_GRID, tol: float = 1e-6) -> DataFrame:
    """Validation metrics per regularisation strength, best average precision first."""
    n = train.count()
    fits = {str(c): fit_logistic(train, features, label, c=c, rows=n, tol=tol) for c in grid}
    return compare(fits, validation, label).withColumn("C", F.col("model").cast("double")).drop("model").orderBy(F.desc("pr_auc"), "C")


def staged_areas(validation: DataFrame, model: PipelineModel, features: Sequence[str], rounds: Sequence[int], label: str = schemas.LABEL) -> DataFrame:
    """Validation areas of the first r trees for every r: one pass over the rows, one line each."""
    scored = session.cut(compiled.staged(validation, model, features, rounds).select(F.col(label).alias("_label"), "probabilities"))
    rows = [evaluate.area_metrics(scored.select("_label", F.col("probabilities")[i].alias("probability")), label="_label").select(
        F.lit(r).alias("maxIter"), "*") for i, r in enumerate(rounds)]
    return ordered.union_all(*rows)


def sweep_capacity(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = schemas.LABEL, grid: dict[str, Sequence] = CAPACITY_GRID,
                   parallel: int = PARALLEL_FITS, name: str = "gbt", **base) -> DataFrame:
    """First stage: depth and number of trees. One fit per depth, with the most trees; the smaller numbers are its prefixes.

    Columns model, maxIter, roc_auc, pr_auc, maxDepth; best average precision first.
    """
    base = {"stepSize": 0.1, "weight": class_weight(train, label), **base}

    def of(depth):
        fit = fit_trees(train, features, label, maxDepth=depth, maxIter=max(grid["maxIter"]), **base)
        areas = staged_areas(validation, fit, features, grid["maxIter"], label).withColumn("maxDepth", F.lit(depth))
        return areas.withColumn("model", F.concat(F.lit(f"{name}_maxDepth{depth}_maxIter"), F.col("maxIter").cast("string")))

    return side_by_side(train.sparkSession, [lambda d=d: of(d) for d in grid["maxDepth"]], parallel).orderBy(F.desc("pr_auc"), "model")


def sweep_trees(train: DataFrame, validation: DataFrame, features: Sequence[str], grid: dict[str, Sequence] = SAMPLING_GRID,
                label: str = schemas.LABEL, name: str = "gbt", parallel: int = PARALLEL_FITS, **base) -> DataFrame:
    """Validation metrics per point of a parameter grid, best average precision first."""
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    base = {"weight": class_weight(train, label), **base}

    def of(point):
        fit = fit_trees(train, features, label, **{**base, **point})
        title = f"{name}_" + "_".join(f"{k}{v}" for k, v in point.items())
        return evaluate.area_metrics(with_probability(validation, fit), label=label).select(
            F.lit(title).alias("model"), "*", *[F.lit(float(v)).alias(k) for k, v in point.items()])

    return side_by_side(train.sparkSession, [lambda p=p: of(p) for p in points], parallel).orderBy(F.desc("pr_auc"), "model")


def sweep_sampling(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = schemas.LABEL,
                   capacities: Sequence[dict] = SAMPLED_CAPACITIES, grid: dict[str, Sequence] = SAMPLING_GRID, **base) -> DataFrame:
    """Second stage: learning rate and sampling around each chosen capacity; `base_config` names the capacity."""
    swept = []
    for capacity in capacities:
        title = "gbt_" + "_".join(f"{k}{v}" for k, v in capacity.items())
        swept.append(sweep_trees(train, validation, features, grid, label, name=title, **{**base, **capacity}).withColumn("base_config", F.lit(title)))
    return ordered.union_all(*swept).orderBy(F.desc("pr_auc"), "model")


def coefficients(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Coefficients of the last stage (one row per feature), largest absolute value first."""
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].coefficients.toArray())]
    table = spark.createDataFrame(rows, "feature string, coef double").withColumn("abs_coef", F.abs("coef"))
    return table.orderBy(F.desc("abs_coef"), "feature")


def level_coefficients(spark: SparkSession, model: PipelineModel, fitted: DataFrame, first: int = 0) -> DataFrame:
    """level and coefficient for the levels of a sparse vector whose numbers start at feature `first` (as many as the model holds)."""
    last, numbered = model.stages[-1], encode.numbered_levels(fitted)
    if isinstance(last, levels.LevelLogisticModel):
        table = session.cut(last.table.filter(F.col("at") >= first).select((F.col("at") - first).alias("level_index"), "coef"))
        held = F.when(F.col("level_index") < last.numFeatures - first, F.coalesce("coef", F.lit(0.0)))
        return joins.lookup(numbered, table, ["level_index"], spread_by=["level"]).select("level", held.alias("coef"))
    values = last.coefficients.toArray()[first:]
    table = spark.createDataFrame(pd.DataFrame({"level_index": range(len(values)), "coef": values}), "level_index long, coef double")
    return joins.lookup(numbered, session.cut(table), ["level_index"], spread_by=["level"]).select("level", "coef")


def leaderboard(table: DataFrame, n: int, by: str = "abs_coef", tie_break: str = "feature") -> DataFrame:
    return ordered.top(table, n, F.desc(by), tie_break)
