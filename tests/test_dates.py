import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from weekrank.functions import dates, numbers


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v")).alias("o")).collect())]


def test_week_ending_saturday(spark):
    stamps = ["2021-01-02 17:23:00", "2021-01-02 23:59:59", "2021-01-03 00:00:00", "2021-01-08 23:59:00", None]
    got = one(spark, stamps, lambda c: dates.week_ending_saturday(c.cast("timestamp")))
    assert [str(v) for v in got] == ["2021-01-02", "2021-01-02", "2021-01-09", "2021-01-09", "None"]


def test_nearest_saturday_matches_the_distance_rule(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(30)]

    def want(day):
        back = (day.weekday() - 5) % 7
        return day - dt.timedelta(days=back) if back <= 7 - back else day + dt.timedelta(days=7 - back)

    assert one(spark, days, dates.nearest_saturday, "date") == [want(d) for d in days]


def test_gap_to_the_end_of_saturday(spark):
    df = spark.createDataFrame([("2021-01-02", "2021-01-02 12:00:00")], "w string, t string")
    gap = df.select(dates.days_between(dates.week_end(F.col("w").cast("date")), F.col("t"))).first()[0]
    assert gap == 43199 / 86400


def test_release_day(spark):
    values = ["2020-05-01 10:00:00", "2020-05-01", "2020-05", " 2020 ", "20200501", "", None, "2020-13-45"]
    assert one(spark, values, dates.release_day) == [
        "2020-05-01", "2020-05-01", "2020-05-01", "2020-01-01", None, None, None, "2020-13-45"]
    assert one(spark, values, dates.release_granularity) == ["day", "day", "month", "year", None, None, None, "day"]


def test_release_timestamp(spark):
    values = ["2020", "2020-05", "2020-05-03", "2020-13-45", "0000", " ", None, "1500-01-01", "x"]
    got = [None if v is None else v.strftime("%Y-%m-%d") for v in one(spark, values, dates.release_timestamp)]
    assert got == ["2020-01-01", "2020-05-01", "2020-05-03", None, None, None, None, None, None]


def test_display_and_partial_dates(spark):
    got = one(spark, ["02 Jan 2021, 17:23", "2021-01-02 03:04:05", "17:23", "soon", None], lambda c: dates.iso_text(dates.parse_display(c)))
    assert got == ["2021-01-02 17:23:00", "2021-01-02 03:04:05", None, None, None]
    assert one(spark, ["1990", "1990-02", "1990-02-30", "1990-02-03", "", "199"], dates.normalise_partial) == [
        "1990-01-01", "1990-02-01", None, "1990-02-03", None, None]
    assert one(spark, ["02 Jan 2021, 00:01"], dates.display_epoch) == [int(pd.Timestamp("2021-01-02 00:01", tz="UTC").timestamp())]


def test_numbers(spark):
    assert one(spark, ["12", "x", "", " 3.5 ", "NaN", None], numbers.to_number) == [12.0, None, None, 3.5, None, None]
    assert one(spark, [0.5, 1.5, 2.5, -0.5, None], numbers.round_half_even, "double") == [0, 2, 2, 0, None]
    assert one(spark, [700.0, 10.0, None], lambda c: numbers.capped(c, 600), "double") == [600.0, 10.0, None]
    assert one(spark, [True, False, None], numbers.bool_as_double, "boolean") == [1.0, 0.0, 0.0]
    assert one(spark, [1, 0, None], numbers.bool_or_null, "int") == [True, False, None]
    assert one(spark, [True, False, None], numbers.flag, "boolean") == [1, 0, 0]
