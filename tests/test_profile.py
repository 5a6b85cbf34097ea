import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekrank.operators import profile
from test_ordered import numbers


def test_spearman_equals_pandas_with_gaps(spark):
    df = numbers(spark, 300).withColumn("c", F.col("a") * 2 + F.col("id") % 7)
    want = df.toPandas()[["a", "b", "c"]].corr(method="spearman")
    for row in profile.spearman(df, ["a", "b", "c"]).collect():
        assert row["spearman"] == pytest.approx(want.loc[row["feature_a"], row["feature_b"]], abs=1e-12)
    pairs = profile.high_correlation_pairs(df, ["a", "c"], 0.5)
    assert pairs.count() == int(abs(want.loc["a", "c"]) >= 0.5)


def test_pearson_skips_gaps(spark):
    df = numbers(spark, 200).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    want = df.toPandas()[["a", "b", "y"]].corr()["y"]
    got = {r["feature"]: r["correlation"] for r in profile.pearson_with_label(df, ["a", "b"], "y").collect()}
    assert got == pytest.approx({"a": want["a"], "b": want["b"]})


def test_mutual_information(spark):
    df = numbers(spark, 200).select((F.col("id") % 2).alias("x"), F.lit(0).alias("z"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    pdf = df.toPandas()
    joint = pd.crosstab(pdf["x"], pdf["y"]) / len(pdf)
    want = sum(joint.loc[a, b] * np.log(joint.loc[a, b] / (joint.loc[a].sum() * joint[b].sum())) for a in (0, 1) for b in (0, 1))
    got = {r["feature"]: r for r in profile.mutual_information(df, ["x", "z"], "y").collect()}
    assert got["x"]["mi"] == pytest.approx(want) and got["z"]["mi"] == 0 and got["x"]["support"] == 100 and got["x"]["prevalence"] == 0.5


def test_histogram_folds_the_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (99.9,), (100.0,), (100.1,), (-1.0,), (None,)], "v double")
    want, _ = np.histogram([0.0, 5.0, 99.9, 100.0, 100.1, -1.0], bins=np.arange(0, 101, 5))
    got = profile.histogram(df, "v", 0, 100, 20).orderBy("bin").collect()
    assert [r["count"] for r in got] == want.tolist() and got[0]["center"] == 2.5
    assert [r["percent"] for r in got][:2] == [25.0, 25.0]


def test_lift_bins(spark):
    df = spark.createDataFrame([(0.0, 1), (0.9, 0), (1.0, 1), (200.0, 1), (float("inf"), 1), (None, 1), (-5.0, None)], "f double, y int")
    got = profile.lift_bins(df, "f", "y", [0, 1, 3, float("inf")]).orderBy("bin").collect()
    assert [(r["count"], r["favorite_rate"]) for r in got] == [(2, 0.5), (1, 1.0), (1, 1.0)]
    low = profile.lift_bins(df, "f", "y", [float("-inf"), 0, 1]).orderBy("bin").collect()
    assert [(r["count"], r["favorite_rate"]) for r in low] == [(0, None), (2, 0.5)]
    assert profile.lift_bins(df.withColumnRenamed("f", "scrobbles_week"), "scrobbles_week", "y").count() == 8


def test_describe_and_missing(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 1.5), (4, "a", None), (4, None, None)], "n int, s string, d double")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    want = df.toPandas()["n"].describe()
    assert [got["n"][c] for c in ("mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(want[1:].tolist())
    assert (got["s"]["count"], got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (3, 2, "a", 2)
    missing = {r["column"]: (r["na_pct"], r["non_null"], r["null"]) for r in profile.missing_table(df).collect()}
    assert missing == {"n": (0.0, 4, 0), "s": (0.25, 3, 1), "d": (0.75, 1, 3)}


def test_counts(spark, rows):
    df = spark.createDataFrame([("rock, pop", 1, "w1"), ("rock", 0, "w1"), (None, 0, None), ("", None, "w2")], "g string, y int, week_saturday_utc string")
    assert rows(profile.value_counts(profile.list_items(df, "g"), "genre")) == [("pop", 1), ("rock", 2)]
    assert rows(profile.bucket_counts(df, "g")) == [("other", 1), ("rock", 2)]
    assert rows(profile.bucket_mapping(df, "g")) == [("pop", "other"), ("rock", "rock")]
    assert rows(profile.class_balance(df, "y")) == sorted([(None, 1, 0.25), (0, 2, 0.5), (1, 1, 0.25)], key=repr)
    assert tuple(profile.class_weight(df, "y").first()) == (1, 2, pytest.approx(1 / 3), 2.0)
    assert rows(profile.weekly_activity(df)) == sorted([(None, 1), ("w1", 2), ("w2", 1)], key=repr)
    assert rows(profile.duplicate_counts(df, {"y": ["y"], "all": df.columns})) == [("all", 0), ("y", 1)]


def test_weekday_share_has_all_days(spark):
    df = spark.createDataFrame([("2021-01-02 10:00:00", 1), ("2021-01-02 11:00:00", 0), ("2021-01-03 11:00:00", None), (None, 0)], "date string, is_week_favorite int")
    got = {r["weekday"]: (r["share_favorite"], r["share_rest"]) for r in profile.weekday_share(df).collect()}
    assert len(got) == 7 and got["Saturday"] == (1.0, 0.5) and got["Sunday"] == (0.0, 0.5) and got["Monday"] == (0.0, 0.0)


def test_dates_validity_newness(spark, rows):
    df = spark.createDataFrame([("2020",), ("2020-01",), ("2020-01-02",), ("2020-01-02 03:04:05",), ("2020-13-01",), ("x",), (None,)], "d string")
    r = profile.date_profile(df, ["d"]).first()
    assert (r["non_null"], r["yyyy_only"], r["yyyy_mm"], r["yyyy_mm_dd"], r["datetime"], r["other_invalid"], r["parsed_ok"]) == (6, 1, 1, 2, 1, 1, 4)
    plays = spark.createDataFrame([("-1", "5", "101", "2030-01-01"), ("x", "-5", "50", "2020-01-01")],
                                  "track_duration string, spotify_duration_ms string, spotify_popularity string, date string")
    assert {v for _, v in rows(profile.validity(plays, profile.listening_checks("2025-01-01")))} == {1}
    week = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (0, 1)], "is_week_favorite int, first_seen_week int")
    assert rows(profile.newness_share(week)) == [("first_seen", 1, pytest.approx(1 / 3)), ("seen_before", 2, pytest.approx(2 / 3))]
    assert tuple(profile.time_span(df, "d").first()) == ("2020", "x")
