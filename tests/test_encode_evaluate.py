import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import session
from weekrank.operators import encode, evaluate, model, score
from weekrank.sources import artifacts


def weekly(spark, n):
    days = [dt.datetime(2021, 1, 2) + dt.timedelta(weeks=i) for i in range(n)]
    return spark.createDataFrame([(d, i) for d in days for i in range(2)], "week_saturday_dt timestamp, i int")


@pytest.mark.parametrize("n, sizes", [(5, (3, 1, 1)), (11, (6, 2, 3))])
def test_time_split(spark, n, sizes):
    df = weekly(spark, n).unionByName(spark.createDataFrame([(None, 9)], "week_saturday_dt timestamp, i int"))
    split = encode.time_split(df)
    assert tuple(part(df).count() // 2 for part in (split.train, split.validation, split.test)) == sizes
    assert split.labelled(df).groupBy("split").count().count() == 3
    inclusive = encode.time_split(df, boundary="inclusive")
    assert inclusive.train(df).count() // 2 == int(0.6 * n) + 1


def test_time_split_needs_five_weeks(spark):
    with pytest.raises(ValueError):
        encode.time_split(weekly(spark, 4))


def test_one_hot_is_asymmetric(spark):
    train = spark.createDataFrame([("rock",)] * 20 + [("jazz",)] * 3 + [(None,)] * 20, "g string")
    fitted = encode.fit_one_hot(train, "g", 20, "g")
    assert fitted.names == ["g__other", "g__rock", "g__unknown"]
    assert fitted.fit_transform(train).agg(F.sum("g__other")).first()[0] == 3
    other = spark.createDataFrame([("jazz",), ("other",), (None,), ("new",)], "g string")
    assert [tuple(r) for r in fitted.transform(other).select(*fitted.names).collect()] == [(0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert encode.fit_one_hot(train, "absent").names == []
    assert encode.fit_one_hot(train.filter("g = 'rock'"), "g", 20).levels == ("rock",)


def scored(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        rows.append((i, f"w{i % 9}", y, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)))
    return spark.createDataFrame(rows, "i long, week string, is_week_favorite int, probability double")


def test_area_metrics_by_brute_force(spark):
    df = scored(spark)
    pdf = df.toPandas()
    pos, neg = pdf[pdf["is_week_favorite"] == 1]["probability"].values, pdf[pdf["is_week_favorite"] == 0]["probability"].values
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap, before = 0.0, 0.0
    for t in sorted(set(pdf["probability"]), reverse=True):
        chosen = pdf[pdf["probability"] >= t]["is_week_favorite"]
        recall = chosen.sum() / len(pos)
        ap, before = ap + chosen.mean() * (recall - before), recall
    got = evaluate.area_metrics(df).first()
    assert (got["roc_auc"], got["pr_auc"]) == (pytest.approx(auc), pytest.approx(ap))
    points = evaluate.roc_points(df).toPandas().sort_values("fpr")
    assert points["tpr"].is_monotonic_increasing and points[["fpr", "tpr"]].max().tolist() == [1.0, 1.0]


def test_best_threshold_by_brute_force(spark):
    df = scored(spark, seed=8)
    pdf = df.toPandas()

    def f1(t):
        hit = pdf["probability"] >= t
        tp = (hit & (pdf["is_week_favorite"] == 1)).sum()
        return 2 * tp / (hit.sum() + (pdf["is_week_favorite"] == 1).sum())

    best = max(sorted(set(pdf["probability"])), key=lambda t: (f1(t), -t))
    got = evaluate.best_threshold(df).first()
    assert got["threshold"] == best and got["f1"] == pytest.approx(f1(best))
    m = evaluate.threshold_metrics(df, best).first()
    assert m["f1"] == pytest.approx(got["f1"]) and m["tp"] + m["fn"] == (pdf["is_week_favorite"] == 1).sum()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == len(pdf)
    lines = {r["class"]: r for r in evaluate.class_report(df, best).collect()}
    assert lines["1"]["recall"] == pytest.approx(m["recall"]) and lines["accuracy"]["f1"] == pytest.approx((m["tp"] + m["tn"]) / len(pdf))


def test_equal_scores_and_no_positives(spark):
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "is_week_favorite int, probability double")
    assert evaluate.best_threshold(flat).first()["threshold"] == 0.5
    assert evaluate.area_metrics(flat).first()["roc_auc"] == 0.5
    none = flat.withColumn("is_week_favorite", F.lit(0))
    assert evaluate.threshold_table(none).first()["f1"] == 0.0
    assert evaluate.area_metrics(none).first()["roc_auc"] is None


def test_hit_rates_and_top(spark):
    df = scored(spark)
    pdf = df.toPandas().sort_values(["week", "probability", "i"], ascending=[True, False, True])
    groups = [g["is_week_favorite"].values for _, g in pdf.groupby("week") if g["is_week_favorite"].sum()]
    got = evaluate.hit_rates(df, 3, week="week", tie_break=["i"]).first()
    assert tuple(got) == (len(groups), pytest.approx(np.mean([g[0] for g in groups])), pytest.approx(np.mean([g[:3].max() for g in groups])))
    empty = evaluate.hit_rates(df.withColumn("is_week_favorite", F.lit(0)), 3, week="week", tie_break=["i"]).first()
    assert tuple(empty) == (0, 0.0, 0.0)
    table = evaluate.top_table(df, 2, week="week", entity=["i"])
    assert table.count() == 18 and table.columns == ["week", "rank", "i", "probability", "is_true_favorite"]
    assert "WindowGroupLimit" in table._jdf.queryExecution().executedPlan().toString()


def test_decide(spark, rows):
    df = spark.createDataFrame([("a", 0, 0.9), ("b", 0, 0.2), ("c", 0, 0.3), ("c", 1, 0.7), ("c", 2, 0.7)], "request_id string, index int, probability double")
    out = score.decide(df, 0.5)
    assert rows(out, "request_id", "index", "mode", "prediction", "above_threshold", "winner_index", "n_tracks") == [
        ("a", 0, "single_threshold", 1, 1, 0, 1), ("b", 0, "single_threshold", 0, 0, 0, 1), ("c", 0, "ranking", 0, 0, 1, 3),
        ("c", 1, "ranking", 1, 1, 1, 3), ("c", 2, "ranking", 0, 1, 1, 3)]


def test_requests(spark):
    shape = T.StructType([T.StructField("x", T.DoubleType())])
    good = spark.createDataFrame([("a", '{"tracks": [{"x": 1}, {}]}')], "request_id string, payload string")
    assert [tuple(r) for r in score.parse_requests(good, shape).collect()] == [("a", 0, 1.0), ("a", 1, None)]
    bad = spark.createDataFrame([("b", '{"tracks": []}')], "request_id string, payload string")
    with pytest.raises(Exception, match="non-empty"):
        score.parse_requests(bad, shape).collect()


def test_logistic_is_the_optimum_of_the_c_form_and_survives_storage(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [1.0, 5.0]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=300) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t), "rock" if t else None) for (a, b), t in zip(x, y)], "a double, b double, is_week_favorite int, genre_bucket string")
    c = 0.5
    fit = model.fit_logistic(model.model_input(df, ["a", "b"]), ["a", "b"], c=c)
    w, b0 = fit.stages[-1].coefficients.toArray(), fit.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ w + b0)))
    assert np.abs(w + c * x.T @ (p - y)).max() < 0.05 and abs((p - y).sum()) < 0.05
    encoder = encode.fit_one_hot(df, min_freq=1)
    artifacts.save(artifacts.Artifacts(fit, encoder, ["a", "b"], 0.4), str(tmp_path / "m"))
    stored = artifacts.load(spark, str(tmp_path / "m"))
    assert (stored.features, stored.threshold, stored.encoder) == (["a", "b"], 0.4, encoder)
    # Absent columns become 0, an absent category becomes unknown.
    out = score.score(df.limit(3).select("a"), stored.model, stored.encoder, stored.features, stored.threshold).collect()
    want = [1 / (1 + np.exp(-(r["a"] * w[0] + b0))) for r in out]
    assert [r["probability"] for r in out] == pytest.approx(want)
    assert all(r["above_threshold"] == int(r["probability"] >= 0.4) for r in out)
    board = model.leaderboard(model.coefficients(spark, fit, ["a", "b"]), 1)
    assert board.first()["feature"] == ("a" if abs(w[0]) > abs(w[1]) else "b")


def test_trees_learn(spark):
    df = scored(spark, 200).withColumn("x", F.col("is_week_favorite") + F.col("probability") / 10)
    fit = model.fit_trees(df, ["x"], maxDepth=2, maxIter=2, minChildWeight=1, featureSubset=0.6)
    assert evaluate.area_metrics(model.with_probability(df.drop("probability"), fit)).first()["roc_auc"] == 1.0


def test_levels_as_a_table_agree_with_named_columns(spark):
    train = spark.createDataFrame([("rock",)] * 3 + [("pop",)] * 2 + [("jazz",), (None,)], "g string")
    later = spark.createDataFrame([("rock",), ("jazz",), ("other",), (None,)], "g string")
    levels, named = encode.fit_levels(train, "g", 2), encode.fit_one_hot(train, "g", 2, "g")
    assert {(r["level"], r["own"], r["n"]) for r in levels.collect()} == {("rock", True, 3), ("pop", True, 2), ("other", False, 2)}
    assert [(r["level"], r["level_index"]) for r in encode.numbered_levels(levels).orderBy("level").collect()] == [("other", 0), ("pop", 1), ("rock", 2)]
    assert named.levels == ("other", "pop", "rock")
    for rows, fitting, wide in ((train, True, named.fit_transform(train)), (later, False, named.transform(later))):
        got = {(r["g"], r["level"]) for r in encode.with_level(rows, "g", levels, fitting).collect()}
        want = {(r["g"], next((n for n in named.levels if r[f"g__{n}"]), None)) for r in wide.collect()}
        assert got == want
    assert encode.fit_levels(train.limit(0), "g").count() == 0


def test_many_levels_are_one_sparse_vector(spark):
    """100,000 levels and no column for any of them."""
    n = 100_000
    rows = spark.range(2 * n).select(F.concat(F.lit("k"), F.col("id") % n).alias("key"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    levels = encode.fit_levels(rows, "key", 1)
    vectors = encode.level_vectors(rows, "key", levels, True)
    assert vectors.columns == ["key", "label", "levels"]
    first = vectors.first()["levels"]
    assert first.size == n and first.numNonzeros() == 1
    fit = model.fit_logistic(session.cut(vectors), ["levels"], "label", c=1.0, max_iter=20)
    found = model.level_coefficients(spark, fit, levels)
    assert found.count() == n and found.select("level").distinct().count() == n
    # A level seen once with each label lies between those seen twice with one.
    by = rows.groupBy(F.col("key").alias("level")).agg(F.sum("label").alias("hits")).join(found, "level").groupBy("hits").agg(F.min("coef"), F.max("coef")).orderBy("hits").collect()
    assert all(a[2] < b[1] for a, b in zip(by, by[1:]))


def test_rows_without_a_level_are_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    levels = encode.fit_levels(train, "key", 2)
    other = spark.createDataFrame([("a",), ("b",), ("new",), (None,), ("other",)], "key string")
    got = {r["key"]: list(r["levels"].toArray()) for r in encode.level_vectors(other, "key", levels, False).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 0.0], "new": [0.0, 0.0], None: [0.0, 0.0], "other": [0.0, 1.0]}
    assert [list(r["levels"].toArray()) for r in encode.level_vectors(train, "key", levels, True).orderBy("key").collect()] == [
        [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]


def test_a_wide_level_vector_is_fitted_on_tables(spark):
    """20,000 levels: the optimum, with the coefficients as a table and none of them in the driver."""
    n = 20_000
    rows = spark.range(3 * n).select((F.col("id") % n).cast("string").alias("key"), (F.xxhash64("id") % 3 == 0).cast("int").alias("label"))
    fitted = encode.fit_levels(rows, "key", 1)
    vectors = session.cut(encode.level_vectors(rows, "key", fitted, True))
    fit = model.fit_logistic(vectors, ["levels"], "label", c=2.0, tol=1e-11)
    last, found = fit.stages[-1], model.level_coefficients(spark, fit, fitted)
    assert last.table.columns == ["at", "coef"] and last.numFeatures == n
    assert len(vectors.schema.json()) < 1000  # no name of a level
    by = rows.groupBy(F.col("key").alias("level")).agg(F.count("*").alias("n"), F.sum("label").alias("hits")).join(found, "level")
    p = 1.0 / (1.0 + F.exp(-F.lit(last.intercept) - F.col("coef")))
    worst, total, count = by.agg(F.max(F.abs(F.col("n") * p - F.col("hits") + F.col("coef") / 2.0)), F.sum(F.col("n") * p - F.col("hits")), F.count("*")).first()
    assert count == n and worst < 1e-9 and abs(total) < 1e-6
    scored = model.with_probability(vectors, fit)
    assert scored.columns == [*vectors.columns, "probability"]
    want = by.select(F.col("level").alias("key"), p.alias("want"))
    assert scored.join(want, "key").filter(F.abs(F.col("probability") - F.col("want")) < 1e-12).count() == 3 * n
    for value, intercept in ((1, float("inf")), (0, float("-inf"))):
        same = model.fit_logistic(vectors.withColumn("label", F.lit(value)), ["levels"], "label")
        assert same.stages[-1].intercept == intercept
        assert model.level_coefficients(spark, same, fitted).agg(F.count("*"), F.max(F.abs("coef"))).first() == (n, 0.0)
