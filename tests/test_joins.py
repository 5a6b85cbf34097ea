import pytest
from pyspark.sql import functions as F

from weekrank import schemas
from weekrank.operators import joins, merge
from weekrank.plans.unified import unify


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_spread_join_equals_a_plain_join(spark, rows, parts):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 5 == 0, None)
                                    .otherwise(F.col("id") % 40).cast("long").alias("k"))
    right = spark.range(45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows(left.join(right, "k", "left").select("id", "k", "v"))
    assert rows(joins.spread_join(left, right, ["k"], spread_by=["id"], parts=parts), "id", "k", "v") == plain
    inner = rows(left.join(right, "k", "inner").select("id", "k", "v"))
    assert rows(joins.spread_join(left, right, ["k"], spread_by=["id"], parts=parts, how="inner"), "id", "k", "v") == inner


def test_spread_join_cuts_a_key_with_a_third_of_the_rows(spark):
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.spread_join(left, right, ["k"], spread_by=["id"], parts=32)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in left.join(right, "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 9000 and max(sizes) < 2500 < 3000 < max(plain)


def test_spread_join_null_safe(spark, rows):
    left = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, None, None)], "id int, a string, b string")
    right = left.select("a", "b", (F.col("id") * 10).alias("v"))
    assert rows(joins.spread_join(left, right, ["a", "b"], spread_by=["id"], null_safe=True), "id", "v") == [(1, 10), (2, 20), (3, 30)]


def test_attach_never_adds_rows_and_keeps_the_first_source(spark, rows):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, k string, have int")
    right = spark.createDataFrame([("a", 1, 99), ("a", 2, 98), (None, 3, 97)], "k string, v int, have int")
    assert rows(joins.attach(left, right, ["k"], spread_by=["id"], newest=["v"]), "id", "v", "have") == [(1, 2, 5), (2, None, 6)]
    assert joins.attach(left, None, ["k"], spread_by=["id"]) is left
    assert joins.attach(left, right, ["absent"], spread_by=["id"]) is left


def test_labels_differing_in_case_count_once(spark, rows):
    plays = spark.createDataFrame([(1, "A", "T", "2021-01-02 10:00:00"), (2, "a ", "t", "2021-01-02 11:00:00"), (3, None, "t", "2021-01-05 11:00:00")],
                                  "scrobble_number long, artist_name string, track_name string, date string")
    labels = spark.createDataFrame([("A", "T", "2021-01-02", 1), ("a", "t", "2021-01-02", 1), ("zz", "t", "2021-01-02", 1)],
                                   "artist_name string, track_name string, week_saturday_utc string, is_week_favorite int").withColumn(
        "week_saturday_utc", F.col("week_saturday_utc").cast("date"))
    out = unify(plays, favorites=labels)
    assert rows(out, "scrobble_number", "is_week_favorite", "artist_key") == [(1, 1, "a"), (2, 1, "a"), (3, 0, None)]


def test_large_label_tables_give_the_same_result(spark, rows):
    plays = spark.createDataFrame([(i, f"A{i % 4}", "T", f"2021-01-{2 + i % 20:02d} 10:00:00") for i in range(80)],
                                  "scrobble_number long, artist_name string, track_name string, date string")
    labels = spark.createDataFrame([("a1", "t", "2021-01-09", 1), ("a2", "T", "2021-01-16", 1)],
                                   "artist_name string, track_name string, week_saturday_utc string, is_week_favorite int").withColumn(
        "week_saturday_utc", F.col("week_saturday_utc").cast("date"))
    columns = ["scrobble_number", "is_week_favorite", "artist_key"]
    small = rows(unify(plays, favorites=labels), *columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = rows(unify(plays, favorites=labels), *columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small == large and sum(r[1] for r in small) > 0


def test_unify_sources(spark):
    plays = spark.createDataFrame([(i, f"Ar{i % 3}", f"T{i % 5}", None if i % 4 else "AL", f"m{i % 3}", "2021-01-05 00:00:00") for i in range(60)],
                                  "scrobble_number long, artist_name string, track_name string, album_name string, artist_mbid string, date string")
    artists = spark.createDataFrame([("AR0 ", 10), ("ar0", 11), ("ar1", 12)], "artist_name string, artist_listeners long")
    tracks = spark.createDataFrame([("ar0", "t0", 99)], "artist_name string, track_name string, track_duration long")
    albums = spark.createDataFrame([("ar2", " al", 5)], "artist_name string, album_name string, album_listeners long")
    metadata = spark.createDataFrame([("m1", "Group")], "artist_mbid string, mb_artist_type string")
    catalog = spark.createDataFrame([("Ar1", "t1", 50, 1)], "artist_name string, track_name string, spotify_popularity long, track_duration long")
    out = unify(plays, artists=artists, tracks=tracks, albums=albums, artist_metadata=metadata, catalog=catalog)
    got = {r["scrobble_number"]: r for r in out.collect()}
    assert len(got) == 60
    assert got[0]["artist_listeners"] == 10 and got[0]["track_duration"] == 99
    assert got[1]["mb_artist_type"] == "Group" and got[1]["spotify_popularity"] == 50 and got[1]["track_duration"] is None
    assert got[8]["album_listeners"] == 5 and got[2]["album_listeners"] is None
    assert out.columns[:6] == plays.columns and str(got[0]["week_saturday_utc"]) == "2021-01-09"


def test_pending_and_first_name(spark, rows):
    want = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 2)], "x string, y int")
    known = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    assert rows(joins.pending_keys(want, None, ["x", "y"])) == [("a", 1)]
    assert rows(joins.pending_keys(want, known, ["x", "y"], keep_null=True)) == [(None, 2)]
    named = spark.createDataFrame([("m", "late", 9), ("m", "early", 1), (None, "x", 0)], "id string, name string, n int")
    assert rows(joins.first_name(named, "id", "name", "n")) == [("m", "early")]


def test_two_pass_match(spark, rows):
    wanted = spark.createDataFrame([("A feat. B", "t"), ("A", "t"), ("C feat. D", "t"), ("Z", "t")], "artist_name string, track_name string")
    catalog = spark.createDataFrame([("A", "t", 2), ("A", "t", 1), ("C feat. D", "t", 3)], "artist_name string, track_name string, id int")
    assert rows(joins.two_pass_match(wanted, catalog, order=["id"])) == sorted(
        [("A feat. B", "t", 1, 2), ("A", "t", 1, 1), ("C feat. D", "t", 3, 1), ("Z", "t", None, None)], key=repr)


def test_countries(spark, rows):
    codes = spark.createDataFrame([("pt",), ("zz",), (None,)], "c string")
    out = joins.with_lookup(codes, F.col("c"), joins.iso_countries(spark), "country", "name")
    assert rows(out) == sorted([("pt", "Portugal"), ("zz", "Unknown"), (None, "Unknown")], key=repr)


def test_upsert_is_idempotent(spark, rows, tmp_path):
    new = spark.createDataFrame([("a", "w1", 2), ("a", "w1", 1), ("b", "w2", 1)], "k string, w string, at int")
    path = str(tmp_path / "t")
    merge.upsert_partitions(new, path, ["k", "w"], ["at"], "w", exists=False)
    first = rows(spark.read.schema(new.schema).parquet(path), "k", "w", "at")
    assert first == [("a", "w1", 2), ("b", "w2", 1)]
    newer = spark.createDataFrame([("a", "w1", 5), ("c", "w3", 1)], "k string, w string, at int")
    for _ in range(2):
        merge.upsert_partitions(newer, path, ["k", "w"], ["at"], "w", exists=True)
        assert rows(spark.read.schema(new.schema).parquet(path), "k", "w", "at") == [("a", "w1", 5), ("b", "w2", 1), ("c", "w3", 1)]
    assert schemas.LABEL == "is_week_favorite"


def test_lookup_keeps_the_column_order_for_any_size(spark):
    left = spark.createDataFrame([("x", 1, "a")], "v string, k int, w string")
    right = spark.createDataFrame([(1, "m")], "k int, more string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = {}
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        df = joins.lookup(left, right, ["k"], spread_by=["v"])
        found[limit] = (df.columns, df.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found["-1"] == found["10485760"] and found["-1"][0] == ["v", "k", "w", "more"]
