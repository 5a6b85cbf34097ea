"""Fitted models as expressions, staged scoring, certificates and sweeps."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weekrank.operators import compiled, encode, model, score
from weekrank.sources import artifacts

FEATURES = ["a", "b b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    x[:, 2] = rng.normal(0, 1, 400)
    y = (x[:, 0] + 2 * (x[:, 1] > 4) + x[:, 2] + rng.normal(0, 1, 400) > 6.5).astype(int)
    return spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, `b b` double, c double, is_week_favorite int")


def both(df, fit):
    """Probabilities of the pipeline, of the expression, and of DuckDB's reading of the expression."""
    plain = compiled.compiled(fit, FEATURES)
    scored = model.with_probability(df, fit).withColumn("plain", plain.probability()).toPandas()
    duck = duckdb.connect()
    duck.register("t", scored)
    return scored["probability"], scored["plain"], duck.execute(f"SELECT {plain.sql()} AS p FROM t").df()["p"]


@pytest.mark.parametrize("scale", [False, True])
def test_logistic_expression(rows, scale):
    a, b, c = both(rows, model.fit_logistic(rows, FEATURES, c=0.5, scale=scale))
    assert np.allclose(a, b, rtol=1e-12) and np.allclose(a, c, rtol=1e-12)


def test_tree_expression(rows):
    fit = model.fit_trees(rows, FEATURES, maxDepth=3, maxIter=6, stepSize=0.3)
    a, b, c = both(rows, fit)
    assert np.allclose(a, b, rtol=1e-12) and np.allclose(a, c, rtol=1e-12)
    trees = compiled.trees_of(fit.stages[-1])
    assert [w for w, _ in trees] == [1.0] + [0.3] * 5 and isinstance(trees[0][1], compiled.Split)


def test_standard_features_divide_by_n(rows):
    fit = model.fit_logistic(rows, FEATURES, c=0.5, scale=True, tol=1e-12)
    x = np.array(rows.select(*[F.col(f"`{f}`") for f in FEATURES]).collect())
    y = np.array([r[0] for r in rows.select("is_week_favorite").collect()])
    z, w = (x - x.mean(axis=0)) / x.std(axis=0), np.zeros(4)
    z = np.column_stack([np.ones(len(z)), z])
    penalty = np.diag([0, 2.0, 2.0, 2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    assert np.allclose(fit.stages[-1].coefficients.toArray(), w[1:], atol=1e-5)


def test_certificate_tells_an_optimum_from_a_fit_cut_short(rows):
    def worst(**settings):
        fit = model.fit_logistic(rows, FEATURES, c=2.0, **settings)
        proof = compiled.certificate(rows, fit, FEATURES, "is_week_favorite", 2.0).collect()
        assert [r.feature for r in proof] == ["intercept", *FEATURES]
        return max(abs(r.gradient) for r in proof)
    assert worst(tol=1e-12) < 1e-4 < 0.1 < worst(max_iter=2)


def test_a_prefix_is_the_short_fit(rows):
    settings = dict(maxDepth=3, stepSize=0.2, subsamplingRate=0.7, featureSubset=0.7, minChildWeight=2)
    long = model.fit_trees(rows, FEATURES, maxIter=9, **settings)
    staged = compiled.staged(rows, long, FEATURES, [9, 1, 4]).select("probabilities").collect()
    for i, n in enumerate([9, 1, 4]):
        short = model.fit_trees(rows, FEATURES, maxIter=n, **settings)
        want = [r[0] for r in model.with_probability(rows, short).select("probability").collect()]
        assert np.allclose([r.probabilities[i] for r in staged], want, rtol=1e-12)
    with pytest.raises(ValueError):
        compiled.staged(rows, long, FEATURES, [10])


def test_rounds_are_checkpointed_in_the_shared_folder(spark, rows):
    fit = model.fit_trees(rows, FEATURES, maxDepth=2, maxIter=3)
    trees = fit.stages[-1]
    assert trees.getCheckpointInterval() == model.CHECKPOINT_ROUNDS and trees.getCacheNodeIds()
    assert spark.sparkContext.getCheckpointDir() is not None


def test_sweeps_cover_their_grids(rows):
    train, validation = rows.filter("a < 6"), rows.filter("a >= 4")
    capacity = model.sweep_capacity(train, validation, FEATURES, grid={"maxDepth": [1, 2], "maxIter": [2, 3, 5]}).collect()
    assert len(capacity) == 6 and [r.pr_auc for r in capacity] == sorted((r.pr_auc for r in capacity), reverse=True)
    one = model.fit_trees(train, FEATURES, maxDepth=2, maxIter=3, stepSize=0.1)
    area = model.evaluate.area_metrics(model.with_probability(validation, one)).first()
    same = next(r for r in capacity if (r.maxDepth, r.maxIter) == (2, 3))
    assert abs(same.pr_auc - area.pr_auc) < 1e-12 and same.model == "gbt_maxDepth2_maxIter3"
    grid = {"stepSize": [0.1, 0.3], "subsamplingRate": [0.8], "minChildWeight": [1], "featureSubset": [1.0]}
    swept = model.sweep_sampling(train, validation, FEATURES, capacities=[{"maxDepth": 1, "maxIter": 2}, {"maxDepth": 2, "maxIter": 2}], grid=grid).collect()
    assert len(swept) == 4 and {r.base_config for r in swept} == {"gbt_maxDepth1_maxIter2", "gbt_maxDepth2_maxIter2"}


def test_defaults_are_the_full_grids():
    points = 1
    for values in model.SAMPLING_GRID.values():
        points *= len(values)
    assert points == 81 and len(model.SAMPLED_CAPACITIES) == 2
    assert len(model.CAPACITY_GRID["maxDepth"]) * len(model.CAPACITY_GRID["maxIter"]) == 25 and max(model.CAPACITY_GRID["maxIter"]) == 1500


def test_stored_expression_scores_rows_without_the_category(spark, rows, tmp_path):
    frame = rows.withColumn("genre_bucket", F.when(F.col("a") > 4, "rock"))
    encoder = encode.fit_one_hot(frame, min_freq=1)
    features = [*FEATURES, *encoder.names]
    fit = model.fit_logistic(model.model_input(encoder.fit_transform(frame), features), features)
    artifacts.save(artifacts.Artifacts(fit, encoder, features, 0.4), str(tmp_path))
    stored = artifacts.load(spark, str(tmp_path))
    for df in (frame, frame.drop("genre_bucket"), frame.drop("c")):
        plain = score.score_plain(df, stored.expression, stored.encoder, stored.features, stored.threshold)
        staged = score.score(df, stored.model, stored.encoder, stored.features, stored.threshold)
        a = [(r.probability, r.above_threshold) for r in plain.collect()]
        b = [(r.probability, r.above_threshold) for r in staged.collect()]
        assert np.allclose(a, b, rtol=1e-12) and "genre_bucket" in plain.columns
