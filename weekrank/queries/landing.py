"""Landed JSON payloads and incremental ingest, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas, session
from weekrank.functions import dates
from weekrank.operators import columns, merge, ordered
from weekrank.queries.common import r, report, saturday, tables
from weekrank.sources import landed
from weekrank.sources import tables as files
from weekrank.streaming import ingest

QUERIES: dict = {}
SQL: dict = {}

_PAGE = 50  # events per landed page


def _history_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as pages of a play history, 50 to a page; errors with a large value are still playing."""
    events = tables(spark, folder, "events")
    item = F.struct(
        F.col("event_type").alias("name"), F.lit("").alias("mbid"),
        F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("#text"), F.lit("").alias("mbid")).alias("artist"),
        F.struct(F.col("props").alias("#text"), F.lit("").alias("mbid")).alias("album"),
        F.when(F.col("event_type") != "signup", F.struct(F.date_format("ts", dates.DISPLAY_FORMAT).alias("#text"))).alias("date"),
        F.struct(F.when((F.col("event_type") == "error") & (F.col("value") > 100), "true").alias("nowplaying")).alias("@attr"))
    pages = events.groupBy(F.floor(F.col("event_id") / F.lit(_PAGE)).alias("page")).agg(F.collect_list(item).alias("track"))
    return pages.select(F.to_json(F.struct(F.struct("track").alias("recenttracks"))).alias("payload"))


def landed_history(spark: SparkSession, folder: str) -> DataFrame:
    """Play events of landed pages inside a time span, numbered on from 500."""
    return report(landed.scrobbles(_history_pages(spark, folder), "listener", 500, after="2024-01-03 00:00:00",
                                   until="2024-01-28 12:00:00"))


QUERIES["landed_history"] = landed_history
SQL["landed_history"] = """
WITH e AS (SELECT event_type AS track_name, 'user ' || user_id AS artist_name, props AS album_name, date_trunc('minute', ts) AS tm
  FROM events WHERE event_type <> 'signup' AND NOT (event_type = 'error' AND value > 100)),
f AS (SELECT * FROM e WHERE tm > TIMESTAMP '2024-01-03' AND tm <= TIMESTAMP '2024-01-28 12:00:00')
SELECT 500 + row_number() OVER (ORDER BY tm, track_name, artist_name, album_name) AS scrobble_number, 'listener' AS username,
  track_name, '' AS track_mbid, strftime(tm, '%Y-%m-%d %H:%M:%S') AS date, artist_name, '' AS artist_mbid, album_name, '' AS album_mbid
FROM f"""


def landed_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Track, album and artist payloads of parts: durations in seconds and counts, 0 when unknown."""
    part = tables(spark, folder, "part")
    known = F.col("p_size") > 10
    track = landed.track_info(part.select(
        F.col("p_brand").alias("artist_name"), F.col("p_partkey").cast("string").alias("track_name"),
        F.to_json(F.struct(F.struct(F.when(known, F.col("p_size") * 1999).cast("string").alias("duration")).alias("track"))).alias("payload")))
    album = landed.album_info(part.select(
        F.col("p_brand").alias("artist_name"), F.col("p_partkey").cast("string").alias("album_name"),
        F.to_json(F.struct(F.struct(F.col("p_size").cast("string").alias("listeners"), F.when(known, "many").alias("playcount")).alias("album"))).alias("payload")))
    artist = landed.artist_info(part.select(
        F.col("p_partkey").cast("string").alias("artist_name"),
        F.when(known, F.to_json(F.struct(F.struct(F.struct(F.col("p_size").alias("listeners"), (F.col("p_size") * 2).alias("playcount")).alias("stats")).alias("artist"))))
        .otherwise("{}").alias("payload")))
    both = track.join(album.withColumnRenamed("album_name", "track_name"), ["artist_name", "track_name"])
    return report(both.join(artist.withColumnRenamed("artist_name", "track_name"), "track_name"))


QUERIES["landed_metadata"] = landed_metadata
SQL["landed_metadata"] = """
SELECT CAST(p_partkey AS VARCHAR) AS track_name, p_brand AS artist_name,
  CAST(CASE WHEN p_size > 10 THEN p_size * 1999 // 1000 ELSE 0 END AS BIGINT) AS track_duration,
  CAST(p_size AS BIGINT) AS album_listeners, CAST(0 AS BIGINT) AS album_playcount,
  CAST(CASE WHEN p_size > 10 THEN p_size ELSE 0 END AS BIGINT) AS artist_listeners,
  CAST(CASE WHEN p_size > 10 THEN p_size * 2 ELSE 0 END AS BIGINT) AS artist_playcount FROM part"""


def landed_artist_details(spark: SparkSession, folder: str) -> DataFrame:
    """Artist payloads of customers: top tag, country by code, type, career dates, ended."""
    customer, nation = tables(spark, folder, "customer", "nation")
    code = F.concat(F.lit("n"), F.col("c_nationkey"))
    tags = F.array(F.struct(F.lit("first").alias("name"), (F.col("c_custkey") % 7).alias("count")),
                   F.struct(F.lit("second").alias("name"), F.lit(3).alias("count")))
    body = F.struct(
        F.when(F.col("c_mktsegment") != "BUILDING", tags).alias("tags"), F.upper(code).alias("country"),
        F.struct(F.when(F.col("c_acctbal") > 0, F.array(code)).alias("iso-3166-1-codes")).alias("area"),
        F.struct(F.when(F.col("c_acctbal") > 5000, "1990").otherwise("1991-13").alias("begin"), F.lit("2001-02").alias("end"),
                 (F.col("c_acctbal") > 1000).alias("ended")).alias("life-span"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Group").alias("type"))
    payloads = customer.select(F.col("c_custkey").cast("string").alias("artist_mbid"), F.to_json(body).alias("payload"))
    names = nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("country"))
    return report(landed.artist_details(payloads, names))


QUERIES["landed_artist_details"] = landed_artist_details
SQL["landed_artist_details"] = f"""
SELECT CAST(c_custkey AS VARCHAR) AS artist_mbid, coalesce(n_name, 'Unknown') AS mb_artist_country,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Group' ELSE '' END AS mb_artist_type,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_custkey % 7 >= 3 THEN 'first' ELSE 'second' END AS mb_artist_main_genre,
  CASE WHEN c_acctbal > 5000 THEN '1990-01-01' ELSE '' END AS mb_artist_career_begin, '2001-02-01' AS mb_artist_career_end,
  {r('CASE WHEN c_acctbal > 1000 THEN 1.0 ELSE 0.0 END')} AS mb_artist_career_ended
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""


def landed_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue payloads of parts with the first genre of their first artist; unmatched parts drop out."""
    part, supplier = tables(spark, folder, "part", "supplier")
    found = F.col("p_size") > 5
    artist = F.concat(F.lit("a"), F.col("p_size"))
    body = F.struct(
        F.when(found, F.concat(F.lit("t"), F.col("p_partkey"))).alias("id"), F.col("p_size").cast("long").alias("popularity"),
        (F.col("p_size") * 1000).cast("long").alias("duration_ms"),
        F.struct(F.col("p_type").alias("name"), F.lit("2020-05").alias("release_date")).alias("album"),
        F.array(F.struct(artist.alias("id"), F.col("p_brand").alias("name"))).alias("artists"))
    tracks = part.select(F.col("p_brand").alias("artist_name"), F.col("p_name").alias("track_name"), F.to_json(body).alias("payload"))
    genres = supplier.select(F.to_json(F.struct(
        F.concat(F.lit("a"), F.col("s_suppkey")).alias("id"),
        F.when(F.col("s_acctbal") > 0, F.array("s_name", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("genres"))).alias("payload"))
    return report(landed.catalog_tracks(tracks, genres))


QUERIES["landed_catalog"] = landed_catalog
SQL["landed_catalog"] = """
SELECT p_brand AS artist_name, p_name AS track_name, 't' || p_partkey AS spotify_track_id, p_type AS spotify_album,
  '2020-05' AS spotify_release_date, CAST(p_size * 1000 AS BIGINT) AS spotify_duration_ms, CAST(p_size AS BIGINT) AS spotify_popularity,
  CASE WHEN s_acctbal > 0 THEN s_name END AS spotify_genres FROM part LEFT JOIN supplier ON p_size = s_suppkey WHERE p_size > 5"""


def _playlist(events: DataFrame) -> DataFrame:
    """Events as playlist pages, one pick to a page; errors have no track."""
    track: Column = F.struct(F.concat(F.lit("t"), F.col("event_id")).alias("id"), F.col("event_type").alias("name"),
                             F.array(F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("name"))).alias("artists"))
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"),
                    F.when(F.col("event_type") != "error", track).alias("track"))
    return events.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))


def landed_favorites(spark: SparkSession, folder: str) -> DataFrame:
    """Picks of playlist pages with the Saturday nearest to the day they were added."""
    fixes = [({"track_name": "view"}, {"track_name": "viewed"})]
    return report(landed.favorites(_playlist(tables(spark, folder, "events")), fixes=fixes))


_NEAREST = ("CASE WHEN (dayofweek(ts) + 1) % 7 <= 3 THEN CAST(ts AS DATE) - CAST((dayofweek(ts) + 1) % 7 AS INT) "
            "ELSE CAST(ts AS DATE) + CAST(7 - (dayofweek(ts) + 1) % 7 AS INT) END")
QUERIES["landed_favorites"] = landed_favorites
SQL["landed_favorites"] = f"""
SELECT 'user ' || user_id AS artist_name, CASE event_type WHEN 'view' THEN 'viewed' ELSE event_type END AS track_name,
  't' || event_id AS spotify_track_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS added_at_utc, CAST({_NEAREST} AS VARCHAR) AS week_saturday_utc,
  CAST(1 AS BIGINT) AS is_week_favorite FROM events WHERE event_type <> 'error'"""


def landed_profile(spark: SparkSession, folder: str) -> DataFrame:
    """User profile payloads of customers: counters, the image of one size, country."""
    customer = tables(spark, folder, "customer")
    images = F.array(F.struct(F.lit("small").alias("size"), F.lit("s.png").alias("#text")),
                     F.struct(F.lit("extralarge").alias("size"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("#text")))
    body = F.struct(F.struct(
        F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("playcount"), F.lit("7").alias("artist_count"),
        F.lit("8").alias("album_count"), F.lit("9").alias("track_count"), images.alias("image"), F.col("c_mktsegment").alias("country")).alias("user"))
    return report(landed.user_profile(customer.select(F.to_json(body).alias("payload"))))


QUERIES["landed_profile"] = landed_profile
SQL["landed_profile"] = """
SELECT c_name AS username, c_custkey AS user_playcount, CAST(7 AS BIGINT) AS user_artist_count, CAST(8 AS BIGINT) AS user_album_count,
  CAST(9 AS BIGINT) AS user_track_count, CASE WHEN c_acctbal > 0 THEN c_name END AS user_image, c_mktsegment AS user_country FROM customer"""

# --- files written and read again ---------------------------------------------------------------


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV in two parts, with tokens for missing names and bad numbers, read again.

    A wanted column that the files lack is left out, and a second table that was never written adds no rows.
    """
    path = session.scratch_path(spark, "csv")
    key = F.col("c_custkey")
    rows = tables(spark, folder, "customer").select(
        "c_custkey", F.when(key % 5 == 0, "N/A").otherwise(F.col("c_name")).alias("c_name"),
        F.when(key % 7 == 0, "abc").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    files.write_csv(rows.filter(key % 2 == 0), path)
    files.write_csv(rows.filter(key % 2 != 0), path, append=True)
    back = files.read_csv(spark, path, ["c_custkey", "c_name", "c_acctbal", "absent"],
                          {"c_custkey": T.LongType(), "c_acctbal": T.DoubleType()}, safe=True)
    return report(back.unionByName(files.optional(spark, f"{path}-absent", back.schema)))


QUERIES["csv_round_trip"] = csv_round_trip
SQL["csv_round_trip"] = f"""
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN {r('c_acctbal')} END AS c_acctbal
FROM customer"""


def json_report(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and their mean balance per segment, written as a JSON report and read again."""
    path = session.scratch_path(spark, "report")
    made = tables(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance"))
    files.write_report(made, path)
    return report(spark.read.schema(made.schema).json(path))


QUERIES["json_report"] = json_report
SQL["json_report"] = f"SELECT c_mktsegment, count(*) AS n, {r('avg(c_acctbal)')} AS balance FROM customer GROUP BY 1"

def loaded_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Events and tracks written as the curated CSV tables and loaded by name; the other five tables are absent."""
    path = session.scratch_path(spark, "inputs")
    events = tables(spark, folder, "events").select(
        F.col("event_id").alias("scrobble_number"), F.concat(F.lit("user "), F.col("user_id")).alias("username"), F.col("event_type").alias("track_name"),
        F.col("ts").alias("date"), F.when(F.col("value") > 50, F.lit("n/a")).otherwise(F.col("event_type")).alias("artist_name"))
    files.write_csv(columns.conform(events, schemas.SCROBBLES), f"{path}/scrobbles.csv")
    files.write_csv(events.select("artist_name", "track_name", F.length("track_name").alias("track_duration")).distinct(), f"{path}/tracks.csv")
    found = files.load_inputs(spark, path, fmt="csv")
    missing = files.load_inputs(spark, f"{path}/none", fmt="csv")
    rows = found["scrobbles"].join(found["tracks"].groupBy("track_name").agg(F.max("track_duration").alias("track_duration")), "track_name")
    return report(rows.groupBy("track_name", "artist_name").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"), F.sum("track_duration").alias("duration"))
                  .withColumns({"tables": F.lit(len(found)), "without_events": F.lit(int(missing is None))}))


QUERIES["loaded_inputs"] = loaded_inputs
SQL["loaded_inputs"] = """
SELECT event_type AS track_name, CASE WHEN value > 50 THEN NULL ELSE event_type END AS artist_name, count(*) AS n, strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS last,
  CAST(sum(length(event_type)) AS BIGINT) AS duration, CAST(2 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS without_events FROM events GROUP BY 1, 2"""

# --- incremental ingest as a stream -------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a landing folder that is read as a stream."""
    schema = tables(spark, folder, "events").schema
    return ingest.watch(spark, folder, schema, "parquet", "events.parquet")


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events streamed into a table that already holds the first half: only later ones are appended, numbered on."""
    path, state = session.scratch_path(spark, "ingest"), session.scratch_path(spark, "state")
    events = tables(spark, folder, "events")
    order = ["ts", "event_id"]
    ingest.append_new_rows(events, path, -1, order, "ts", until="2024-01-15 00:00:00")
    query = ingest.each_batch(_event_stream(spark, folder), state,
                              lambda batch, number: ingest.append_new_rows(batch, path, number, order, "ts")).start()
    query.awaitTermination()
    return report(spark.read.parquet(path).select("scrobble_number", "event_id", "ts", "value"))


QUERIES["stream_ingest"] = stream_ingest
SQL["stream_ingest"] = f"""
SELECT row_number() OVER (ORDER BY ts, event_id) AS scrobble_number, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  {r('value')} AS value FROM events"""


def stream_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Streamed events whose user and type the table lacks are looked up and appended once."""
    path, state = session.scratch_path(spark, "enrich"), session.scratch_path(spark, "state")
    events, keys = tables(spark, folder, "events"), ["user_id", "event_type"]

    def enrich(pending: DataFrame) -> DataFrame:
        return pending.withColumn("title", F.concat_ws(" ", "event_type", "user_id"))

    ingest.append_unseen(events.filter(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")), path, -1, keys, enrich)
    query = ingest.each_batch(_event_stream(spark, folder), state,
                              lambda batch, number: ingest.append_unseen(batch, path, number, keys, enrich)).start()
    query.awaitTermination()
    return report(spark.read.parquet(path))


QUERIES["stream_enrichment"] = stream_enrichment
SQL["stream_enrichment"] = """
SELECT user_id, event_type, event_type || ' ' || user_id AS title, CAST(CASE WHEN min(ts) < TIMESTAMP '2024-01-03' THEN -1 ELSE 0 END AS BIGINT) AS ingest_batch
FROM events GROUP BY user_id, event_type"""


def stream_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Streamed picks merged into stored ones: one per entity and week, the newest wins."""
    path, state = session.scratch_path(spark, "labels"), session.scratch_path(spark, "state")
    keys = ["artist_name", "track_name", schemas.WEEK]

    def store(batch: DataFrame, _number: int = 0) -> None:
        ingest.merge_labels(landed.favorites(_playlist(batch)), path, keys, ["added_at_utc", "spotify_track_id"], schemas.WEEK)

    store(tables(spark, folder, "events").filter(F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    query = ingest.each_batch(_event_stream(spark, folder), state, store).start()
    query.awaitTermination()
    return report(columns.conform(spark.read.parquet(path), schemas.FAVORITES))


QUERIES["stream_labels"] = stream_labels
SQL["stream_labels"] = f"""
WITH e AS (SELECT *, {_NEAREST} AS near FROM events WHERE event_type <> 'error'),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, near ORDER BY date_trunc('second', ts) DESC, 't' || event_id DESC) AS rn FROM e)
SELECT 'user ' || user_id AS artist_name, event_type AS track_name, 't' || event_id AS spotify_track_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS added_at_utc, CAST(near AS VARCHAR) AS week_saturday_utc, CAST(1 AS BIGINT) AS is_week_favorite
FROM n WHERE rn = 1"""


def stream_any_order(spark: SparkSession, folder: str) -> DataFrame:
    """Events landed as files from the newest to the oldest, with some rows twice, one and three files a trigger, stopped half way.

    Every row is in the log once and numbered by its time, however it came.
    """
    events, order = session.cut(tables(spark, folder, "events")), ["ts", "event_id"]
    slices = [F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz"), F.col("ts").between(F.lit("2024-01-14").cast("timestamp_ntz"), F.lit("2024-01-23").cast("timestamp_ntz")),
              F.col("ts").between(F.lit("2024-01-07").cast("timestamp_ntz"), F.lit("2024-01-14").cast("timestamp_ntz")), F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")]
    read = []
    for files in (1, 3):
        landing, path, state = (session.scratch_path(spark, name) for name in ("landing", "log", "state"))

        def store(batch: DataFrame, number: int, path: str = path) -> None:
            ingest.log_rows(batch, path, number, ["event_id"], "ts")

        for half in (slices[:2], slices[2:]):
            for part in half:
                events.filter(part).coalesce(1).write.mode("append").parquet(landing)
            watched = ingest.watch(spark, landing, events.schema, "parquet", "*.parquet", files)
            ingest.each_batch(watched, state, store).start().awaitTermination()
        read.append(ingest.numbered(spark, path, order).withColumn("files", F.lit(files)))
    return report(ordered.union_all(*read).select("files", "scrobble_number", "event_id", "ts"))


QUERIES["stream_any_order"] = stream_any_order
SQL["stream_any_order"] = """
WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS scrobble_number, event_id, ts FROM events)
SELECT files, scrobble_number, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM e, (SELECT unnest([1, 3]) AS files)"""


def stream_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and week from a watermarked seven-day window: the weeks that no row is waited for any more."""
    path, state = session.scratch_path(spark, "weeks"), session.scratch_path(spark, "state")
    counts = ingest.weekly_counts(_event_stream(spark, folder), ["event_type"], "ts")
    query = (counts.writeStream.option("checkpointLocation", state).format("parquet").option("path", path).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return report(spark.read.schema(counts.schema).parquet(path))


QUERIES["stream_weeks"] = stream_weeks
SQL["stream_weeks"] = f"""
WITH e AS (SELECT event_type, {saturday('ts')} AS week FROM events)
SELECT event_type, CAST(week AS VARCHAR) AS week_saturday, count(*) AS n FROM e
WHERE week + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL"""


def versioned_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' newest order per month, merged in three rounds into versions, the oldest rows last; old versions cleaned."""
    path, keys = session.scratch_path(spark, "versions"), ["o_custkey", "month"]
    orders = tables(spark, folder, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderdate", "o_totalprice")
    for part in (F.col("o_orderdate") >= F.lit("1997-01-15"), F.col("o_orderkey") % 2 == 0, F.lit(True)):
        merge.upsert_versions(orders.filter(part), path, keys, ["o_orderdate", "o_orderkey"], "month")
    table = merge.Versioned(spark, path, orders.schema, "month")
    table.clean()
    return report(table.read())


QUERIES["versioned_labels"] = versioned_labels
SQL["versioned_labels"] = f"""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, {r('o_totalprice')} AS o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
