import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas
from weekrank.operators import columns, impute, ordered
from weekrank.plans.clean import clean_events


def test_projections(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, "a")], "scrobbles_week int, genre__rock int, released_within_28d int, artist_playcount int, artist_name string")
    assert columns.feature_columns(df) == ["scrobbles_week", "released_within_28d", "genre__rock"]
    assert "artist_playcount" not in columns.drop_leaky(df).columns
    assert "artist_name" not in columns.drop_identifiers(df).columns
    assert columns.drop_columns(df, ["nothing", "genre__rock"]).columns == ["scrobbles_week", "released_within_28d", "artist_playcount", "artist_name"]
    x, y = columns.split_features_label(columns.with_label(df))
    assert y.first()[0] == 0 and x.columns == columns.feature_columns(df)
    assert columns.common_features(df, df.drop("genre__rock")) == ["released_within_28d", "scrobbles_week"]


def test_defaults_conform_order(spark):
    df = spark.createDataFrame([(None, "1"), (2.0, "x")], "a double, b string")
    assert [tuple(r) for r in columns.with_defaults(df, ["a", "c"]).select("a", "c").collect()] == [(0.0, 0.0), (2.0, 0.0)]
    shaped = columns.conform(df, T.StructType([T.StructField("b", T.LongType()), T.StructField("z", T.StringType())]))
    assert [tuple(r) for r in shaped.collect()] == [(1, None), (None, None)]
    wide = spark.createDataFrame([(1, 2, 3, 4)], "d int, a_x int, b int, c int")
    assert columns.order_columns(wide, ["c", "q"], ["c", "b"]).columns == ["c", "b", "d"]
    both = spark.createDataFrame([(None, 2), (1, 3)], "k_x int, k_y int")
    assert [r[0] for r in columns.coalesce_sides(both, "k").collect()] == [2, 1]
    assert columns.coalesce_sides(df, "k") is df


def test_fixes_apply_in_order(spark, rows):
    df = spark.createDataFrame([("Fiona Apple", "Love More"), ("X", "Love More"), ("Y", "Pronto"), (None, None)], "artist_name string, track_name string")
    assert rows(columns.apply_fixes(df)) == sorted([
        ("Sharon Van Etten", "Love More (By Fiona Apple)"), ("X", "Love More"), ("Y", "Careless"), (None, None)], key=repr)


def test_label_period(spark):
    df = spark.createDataFrame([("2021-01-02", None), ("2020-12-26", None), (None, "2021-02-06 00:00:00"), ("bad", None)],
                               "week_saturday_dt string, week_saturday_utc string")
    kept = columns.label_period(columns.with_week_timestamp(df), "not a date")
    assert sorted(str(r[0].date()) for r in kept.select("week_saturday_dt").collect()) == ["2021-01-02", "2021-02-06"]
    with pytest.raises(KeyError):
        columns.with_week_timestamp(spark.range(1))


def test_between_times(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, d),) for d in (1, 2, 3)], "t timestamp")
    assert columns.between_times(df, F.col("t"), "2021-01-01", "2021-01-02").count() == 1
    assert columns.between_times(df, F.col("t")).count() == 3


def test_medians_even_odd_and_empty(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, None, None), (3.0, 7.0, None), (10.0, 9.0, None)], "a double, b double, c double")
    assert ordered.medians(df, ["a", "b", "c"]) == {"a": 2.5, "b": 7.0, "c": None}
    filled = impute.fill_medians(df, ["b", "c", "absent"])
    assert sorted(tuple(r) for r in filled.select("b", "b_was_missing", "c_was_missing").collect()) == [
        (5.0, 0, 1), (7.0, 0, 1), (7.0, 1, 1), (9.0, 0, 1)]
    aged = impute.fill_days_since_release(df.withColumnRenamed("a", "days_since_release"))
    assert {r[0] for r in aged.select("days_since_release_was_missing").collect()} == {0}


def test_clean_events(spark):
    df = spark.createDataFrame(
        [(" A\t", "2020-13", "rock, pop", "12", "3.5", 1), ("B", "junk", None, "x", None, 2), (None, None, "", None, "2.5", 3)],
        "artist_name string, spotify_release_date string, spotify_genres string, track_duration string, artist_listeners string, spotify_duration_ms int")
    out = {r["artist_name"]: r for r in clean_events(df).collect()}
    a, b, c = out["A"], out["B"], out[None]
    assert (a["spotify_release_date"], a["release_date_granularity"], a["spotify_release_date_was_missing"]) == ("2020-13-01", "month", 0)
    assert (b["spotify_release_date"], b["spotify_release_date_was_missing"]) == (None, 1)
    assert (a["genre_bucket"], b["genre_bucket"], c["genre_missing"]) == ("other", "unknown", 1)
    assert (a["track_duration"], b["track_duration"]) == (12.0, None)
    assert (a["artist_listeners"], b["artist_listeners"], c["artist_listeners"], b["artist_listeners_was_missing"]) == (4, 3, 2, 1) or \
        (a["artist_listeners"], b["artist_listeners"], c["artist_listeners"]) == (4, 3, 2)
    assert "spotify_duration_ms" not in a.asDict()


def test_fill_by_type(spark):
    df = spark.createDataFrame([(None, None, None)], "s string, n long, f double")
    assert tuple(columns.fill_by_type(df, {"s": "str", "n": "int64", "f": "float"}).first()) == ("", 0, None)
    assert schemas.LABEL_START == "2021-01-02"
