import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas, session
from weekrank.sources import landed, tables


def test_csv_round_trip_and_missing_tokens(spark, tmp_path, rows):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, 'say "hi", ok', "2021-01-02 03:04:05"), (2, "NA", None), (3, "nan", "x"), (4, "Nan", None)],
                               "n int, s string, d string")
    tables.write_csv(df.coalesce(1), path)
    back = tables.read_csv(spark, path, ["n", "s", "d"], {"n": T.LongType()}, parse_dates=["d"])
    got = {r["n"]: r for r in back.collect()}
    assert got[1]["s"] == 'say "hi", ok' and str(got[1]["d"]) == "2021-01-02 03:04:05"
    assert got[2]["s"] is None and got[3]["s"] is None and got[4]["s"] == "Nan" and got[3]["d"] is None
    tables.write_csv(df, path, append=True)
    assert tables.read_csv(spark, path).count() == 8
    with pytest.raises(ValueError):
        tables.read_csv(spark, path, ["n", "absent"])
    assert tables.read_csv(spark, path, ["n", "absent"], safe=True).columns == ["n"]


def test_tables_and_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.optional(spark, path, schemas.ARTISTS).count() == 0
    tables.write_table(spark.range(3), path)
    tables.write_table(spark.range(3), path, append=True)
    assert tables.optional(spark, path, schemas.ARTISTS).count() == 6
    tables.write_report(spark.createDataFrame([(0.5, 3)], "roc_auc double, tp long"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"roc_auc": 0.5, "tp": 3}
    assert tables.load_inputs(spark, str(tmp_path)) is None
    tables.write_table(spark.createDataFrame([], schemas.SCROBBLES), str(tmp_path / "scrobbles.parquet"))
    found = tables.load_inputs(spark, str(tmp_path), register=True)
    assert set(found) == {"scrobbles"} and spark.table("scrobbles").count() == 0


def test_only_named_columns_are_read_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_table(spark.range(9).select("id", (F.col("id") * 2).alias("x"), F.lit("s").alias("y")), path)
    plan = spark.read.parquet(path).filter("x > 4").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,4)" in plan and "ReadSchema: struct<id:bigint,x:bigint>" in plan


def payloads(spark, bodies, **columns):
    rows = [(*(v[i] for v in columns.values()), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in columns), "payload string"]))


def test_history(spark):
    def play(name, at, **more):
        return {"name": name, "mbid": "m", "artist": {"#text": "Ar", "mbid": ""}, "album": {"#text": "Al"}, **({"date": {"#text": at}} if at else {}), **more}

    page = {"recenttracks": {"track": [play("now", "02 Jan 2021, 17:23", **{"@attr": {"nowplaying": "true"}}), play("undated", None),
                                       play("late", "03 Jan 2021, 00:00"), play("early", "01 Jan 2021, 10:00"), play("old", "01 Dec 2020, 10:00")]}}
    out = landed.scrobbles(payloads(spark, [page, "{}", "broken"]), "me", 10, after="2020-12-01 10:00:00", until="2021-01-03 00:00:00")
    got = [(r["scrobble_number"], r["track_name"], str(r["date"]), r["album_mbid"]) for r in out.orderBy("scrobble_number").collect()]
    assert got == [(11, "early", "2021-01-01 10:00:00", ""), (12, "late", "2021-01-03 00:00:00", "")]
    assert out.columns == schemas.SCROBBLES.names


def test_details(spark, rows):
    tracks = payloads(spark, [{"track": {"duration": "215999"}}, {}], artist_name=["a", "b"], track_name=["t", "t"])
    assert rows(landed.track_info(tracks)) == [("a", "t", 215), ("b", "t", 0)]
    albums = payloads(spark, [{"album": {"listeners": "5", "playcount": 6}}, {}], artist_name=["a", "b"], album_name=["x", "x"])
    assert rows(landed.album_info(albums)) == [("a", "x", 5, 6), ("b", "x", 0, 0)]
    artists = payloads(spark, [{"artist": {"stats": {"listeners": 1, "playcount": "2"}}}, {}], artist_name=["a", "b"])
    assert rows(landed.artist_info(artists)) == [("a", 1, 2), ("b", 0, 0)]
    user = payloads(spark, [{"user": {"name": "me", "playcount": "9", "image": [{"size": "extralarge", "#text": "u"}]}}])
    assert tuple(landed.user_profile(user).first()) == ("me", 9, None, None, None, "u", None)
    facts = payloads(spark, [{"tags": [{"name": "x", "count": 1}, {"name": "y", "count": 4}], "country": "US", "area": {"iso-3166-1-codes": ["PT"]},
                              "life-span": {"begin": "1990-02", "end": None, "ended": True}, "type": "Group"}, {"country": "US"}, {}], artist_mbid=["1", "2", "3"])
    assert rows(landed.artist_details(facts)) == [
        ("1", "Portugal", "Group", "y", "1990-02-01", "", 1.0), ("2", "United States", "", "", "", "", 0.0), ("3", "Unknown", "", "", "", "", 0.0)]


def test_catalog_and_favorites(spark, rows):
    found = {"id": "t1", "popularity": 5, "duration_ms": 7, "album": {"name": "al", "release_date": "2020"}, "artists": [{"id": "a1"}, {"id": "a2"}]}
    tracks = payloads(spark, [found, {}], artist_name=["a", "b"], track_name=["t", "t"])
    genres = payloads(spark, [{"id": "a1", "genres": ["rock", "pop"]}, {"id": "a2", "genres": []}])
    assert rows(landed.catalog_tracks(tracks, genres)) == [("a", "t", "t1", "al", "2020", 7, 5, "rock")]
    assert landed.catalog_tracks(tracks).first()["spotify_genres"] is None
    pages = payloads(spark, [{"items": [{"added_at": "2021-01-05T10:00:00Z", "track": {"id": "1", "name": "Pronto", "artists": [{"name": "x"}, {"name": "y"}]}},
                                        {"added_at": "2021-01-06T10:00:00Z", "track": {"id": "2", "name": "n", "artists": []}}, {"track": None}]}, {"items": []}])
    got = [(r["artist_name"], r["track_name"], str(r["week_saturday_utc"]), r["is_week_favorite"]) for r in landed.favorites(pages).orderBy("spotify_track_id").collect()]
    assert got == [("x", "Careless", "2021-01-02", 1), (None, "n", "2021-01-09", 1)]


def test_session_sizes(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.write_table(spark.range(1000), path)
    assert session.fits_broadcast(spark.read.parquet(path))
    assert not session.fits_broadcast(spark.createDataFrame([(1,)], "a int"))
    assert session.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for text, want in (("10MB", 10 << 20), ("5000b", 5000), ("77", 77), ("-1", -1)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert session.broadcast_limit(spark) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
