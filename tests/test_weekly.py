import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekrank import schemas, session
from weekrank.operators import features, weekly
from weekrank.plans.weekly_table import model_view, weekly_table

ENTITY = ["artist_name", "track_name"]


def plays(spark, seed=1, n=400, extra=()):
    rng = random.Random(seed)
    rows = [(i, f"a{rng.randint(0, 3)}", f"t{rng.randint(0, 2)}", str(pd.Timestamp("2021-01-01") + pd.Timedelta(seconds=rng.randint(0, 80 * 86400))),
             rng.choice([0, 1, None]), f"album{rng.randint(0, 5)}", "2021-01") for i in range(n)]
    df = spark.createDataFrame([*rows, *extra], "scrobble_number long, artist_name string, track_name string, date string, "
                               "is_week_favorite int, album_key string, spotify_release_date string")
    return weekly.anchor_week(df)


def test_base_equals_pandas(spark):
    df = plays(spark, extra=[(9001, None, "t0", "2021-01-05 00:00:00", 1, "x", None), (9002, "a0", "t0", "nonsense", 1, "x", None)])
    got = weekly.weekly_base(df).toPandas().set_index([*ENTITY, schemas.WEEK]).sort_index()
    pdf = df.toPandas().dropna(subset=[*ENTITY, schemas.WEEK])
    pdf["ts"] = pd.to_datetime(pdf["date"])
    for key, group in pdf.groupby([*ENTITY, schemas.WEEK]):
        row, last = got.loc[key], group.sort_values(["ts", "scrobble_number"]).iloc[-1]
        assert row["scrobbles_week"] == len(group)
        assert row["unique_days_week"] == group["ts"].dt.floor("D").nunique()
        assert row["scrobbles_last_fri_sat"] == group["ts"].dt.weekday.isin([4, 5]).sum()
        assert row["scrobbles_saturday"] == (group["ts"].dt.weekday == 5).sum()
        end = pd.Timestamp(key[2]) + pd.Timedelta(seconds=86399)
        assert row["last_scrobble_gap_days"] == pytest.approx((end - group["ts"].max()).total_seconds() / 86400)
        label = group["is_week_favorite"].max()
        assert row["is_week_favorite"] == (0 if np.isnan(label) else label)
        assert row["album_key"] == last["album_key"]
    assert len(got) == pdf.groupby([*ENTITY, schemas.WEEK]).ngroups


def test_day_mask_equals_distinct_days(spark, rows):
    df = plays(spark, seed=3)
    columns = [*ENTITY, schemas.WEEK, "unique_days_week"]
    assert rows(weekly.weekly_base(df, carry=[]), *columns) == rows(weekly.weekly_base(df, carry=[], week_from_ts=False), *columns)


def test_an_event_without_time_is_carried_and_ties_go_to_the_highest_number(spark):
    df = spark.createDataFrame([(1, "a", "t", "2021-01-02", "2021-01-02 10:00:00", "x"), (2, "a", "t", "2021-01-02", "2021-01-02 10:00:00", "y"),
                                (1, "b", "t", "2021-01-02", None, "z"), (2, "b", "t", "2021-01-02", "2021-01-02 10:00:00", "w")],
                               "scrobble_number long, artist_name string, track_name string, week_saturday_utc string, date string, track_key string")
    got = {r["artist_name"]: r for r in weekly.weekly_base(df).collect()}
    assert got["a"]["track_key"] == "y" and got["b"]["track_key"] == "z"
    assert got["b"]["scrobbles_week"] == 2 and got["b"]["unique_days_week"] == 1


def weeks(spark, spec):
    rows = [(a, "t", dt.datetime(2021, 1, 2) + dt.timedelta(weeks=w), n) for a, values in spec.items() for w, n in values]
    df = spark.createDataFrame(rows, "artist_name string, track_name string, week_saturday_dt timestamp, scrobbles_week long")
    return df.withColumn(schemas.WEEK, F.to_date("week_saturday_dt"))


def by_entity(df, column):
    out = {}
    for r in df.orderBy("artist_name", "week_saturday_dt").collect():
        out.setdefault(r["artist_name"], []).append(r[column])
    return out


def test_previous_weeks_do_not_leak_between_entities(spark):
    df = weeks(spark, {"a": [(0, 1), (1, 2), (2, 3)], "b": [(0, 10), (1, 20), (9, 30)]})
    assert by_entity(features.add_previous(df, 4), "scrobbles_prev_4w") == {"a": [0, 1, 3], "b": [0, 10, 30]}
    assert by_entity(features.add_previous(df, 1), "scrobbles_prev_1w") == {"a": [0, 1, 2], "b": [0, 10, 20]}
    calendar = features.add_previous(df, 4, calendar=True)
    assert by_entity(calendar, "scrobbles_prev_4w") == {"a": [0, 1, 3], "b": [0, 10, 0]}
    changed = weeks(spark, {"a": [(0, 1), (1, 2), (2, 3)], "b": [(0, 77)]})
    assert by_entity(features.add_previous(changed, 4), "scrobbles_prev_4w")["a"] == [0, 1, 3]


def test_history_features(spark):
    df = weeks(spark, {"a": [(0, 1), (1, 2), (5, 3)], "b": [(2, 4)]})
    out = features.add_history_family(features.add_momentum_family(df))
    assert by_entity(out, "prior_scrobbles_all_time") == {"a": [0, 1, 3], "b": [0]}
    assert by_entity(out, "prior_weeks_with_scrobbles") == {"a": [0, 1, 2], "b": [0]}
    assert by_entity(out, "first_seen_week") == {"a": [1, 0, 0], "b": [1]}
    assert by_entity(out, "weeks_since_first_scrobble") == {"a": [0, 1, 5], "b": [0]}
    assert by_entity(out, "week_over_week_change") == {"a": [1, 1, 1], "b": [4]}
    assert by_entity(out, "momentum_4w_ratio")["a"] == [1.0, 1.0, 0.75]


def test_rank_is_dense_inside_the_week(spark):
    df = weeks(spark, {"a": [(0, 5), (1, 1)], "b": [(0, 5), (1, 2)], "c": [(0, 3)]})
    assert by_entity(features.add_week_rank(df), "within_week_rank_by_scrobbles") == {"a": [1, 2], "b": [1, 1], "c": [2]}


def test_order_of_use_is_checked(spark):
    df = weeks(spark, {"a": [(0, 1)]})
    for call in (features.add_change, features.add_momentum, features.add_first_seen, features.add_released_within):
        with pytest.raises(ValueError):
            call(df)
    with pytest.raises(ValueError):
        features.add_previous(df, 0)


def test_release_features(spark):
    df = spark.createDataFrame([(28.0,), (0.0,), (-0.5,), (28.01,), (None,)], "days_since_release double")
    assert [r[0] for r in features.add_released_within(df).select("released_within_28d").collect()] == [1, 1, 0, 0, 0]
    events = spark.createDataFrame([("a", "t", "2021"), ("a", "t", "2020-06"), ("a", "t", None), ("b", "t", "junk")],
                                   "artist_name string, track_name string, spotify_release_date string")
    lookup = weekly.release_lookup(events)
    base = weeks(spark, {"a": [(0, 1)], "b": [(0, 1)]})
    joined = features.add_days_since_release(base, lookup=lookup)
    assert by_entity(joined, "days_since_release") == {"a": [215.0], "b": [None]}
    assert by_entity(features.add_days_since_release(base), "days_since_release") == {"a": [None], "b": [None]}


def test_prior_plus_current_is_the_running_sum_for_any_partitioning(spark, rows):
    columns = [*ENTITY, schemas.WEEK, "prior_scrobbles_all_time", "within_week_rank_by_scrobbles", "scrobbles_prev_4w", "album_key"]
    results = []
    for partitions in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(rows(weekly_table(plays(spark, seed=5).repartition(int(partitions))), *columns))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
    table = weekly_table(plays(spark, seed=5)).toPandas().sort_values([*ENTITY, schemas.WEEK])
    running = table.groupby(ENTITY)["scrobbles_week"].cumsum()
    assert (running == table["prior_scrobbles_all_time"] + table["scrobbles_week"]).all()


def test_model_view(spark):
    table = session.cut(weekly_table(plays(spark, seed=7)))
    view = model_view(table, "2021-02-06")
    assert set(table.columns) - set(view.columns) == {"prior_weeks_with_scrobbles", "weeks_since_first_scrobble"}
    assert str(view.agg(F.min(schemas.WEEK)).first()[0]) == "2021-02-06"
    # History before the label period still counts.
    assert view.filter("first_seen_week = 0").count() > 0
    ordered = [r[0] for r in weekly.in_week_order(view).select(schemas.WEEK_TS).collect()]
    assert ordered == sorted(ordered)
    assert session.drop_cuts(spark) > 0
