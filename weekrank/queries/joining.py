"""Joins, unions, merges and orderings on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank import schemas, session
from weekrank.functions import dates
from weekrank.operators import columns, joins, merge, ordered, profile, weekly
from weekrank.plans.unified import unify
from weekrank.queries.common import r, report, saturday, tables
from weekrank.streaming import ingest

QUERIES: dict = {}
SQL: dict = {}


def join_metadata_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer facts and with two nation tables; duplicates on the right never add rows."""
    orders, customer, nation, region = tables(spark, folder, "orders", "customer", "nation", "region")
    orders = orders.withColumnRenamed("o_custkey", "c_custkey").withColumnRenamed("o_orderstatus", "status")
    doubled = customer.unionByName(customer.withColumn("c_acctbal", F.col("c_acctbal") - 1))
    wide = joins.attach(orders, doubled, ["c_custkey"], spread_by=["o_orderkey"], newest=["c_acctbal"])
    keyed = nation.withColumnRenamed("n_nationkey", "c_nationkey")
    wide = joins.attach(wide, keyed, ["c_nationkey"], spread_by=["o_orderkey"])
    wide = joins.attach(wide, None, ["c_nationkey"], spread_by=["o_orderkey"])
    wide = joins.attach(wide, region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], spread_by=["o_orderkey"])
    return report(wide.select("o_orderkey", "c_custkey", "status", "c_name", "c_acctbal", "n_name", "r_name"))


QUERIES["join_metadata_unique"] = join_metadata_unique
SQL["join_metadata_unique"] = f"""
SELECT o_orderkey, o_custkey AS c_custkey, o_orderstatus AS status, c_name, {r('c_acctbal')} AS c_acctbal, n_name, r_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region g ON n.n_regionkey = g.r_regionkey"""


def join_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Line items joined to their orders and parts with hot keys cut into pieces."""
    lineitem, orders, part = tables(spark, folder, "lineitem", "orders", "part")
    # The return flag is the hot key: three values for all rows.
    flags = lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("flag_quantity"))
    wide = joins.spread_join(lineitem, flags, ["l_returnflag"], spread_by=["l_orderkey", "l_linenumber"],
                             counts=flags.select("l_returnflag", "n"), weight="n")
    side = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    wide = joins.spread_join(wide, side, ["l_orderkey"], spread_by=["l_linenumber"],
                             counts=joins.key_counts(lineitem, ["l_orderkey"]))
    names = part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    wide = joins.spread_join(wide, names, ["l_partkey"], spread_by=["l_orderkey", "l_linenumber"],
                             counts=joins.key_counts(lineitem, ["l_partkey"]))
    return report(wide.groupBy("l_returnflag", "o_orderpriority", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity") - F.col("flag_quantity")).alias("excess")))


QUERIES["join_spread"] = join_spread
SQL["join_spread"] = f"""
WITH f AS (SELECT l_returnflag AS flag, avg(l_quantity) AS fq FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, o_orderpriority, p_brand, count(*) AS n, {r('sum(l_quantity - fq)')} AS excess
FROM lineitem l JOIN f ON l.l_returnflag = f.flag LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l_returnflag, o_orderpriority, p_brand"""


def join_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Events labelled by user, type and week; a label entered twice counts once, without one it is 0."""
    events = weekly.anchor_week(tables(spark, folder, "events"), "ts")
    big = events.filter(F.col("value") > 200).select("user_id", "event_type", schemas.WEEK,
                                                     F.col("ts").alias("added_at_utc"), F.lit(1).alias("is_week_favorite"))
    keys = ["user_id", "event_type", schemas.WEEK]
    out = joins.attach_labels(events, big.unionByName(big), keys, spread_by=["event_id"])
    return report(out.select("event_id", "is_week_favorite", "added_at_utc"))


QUERIES["join_labels"] = join_labels
SQL["join_labels"] = f"""
WITH e AS (SELECT *, {saturday('ts')} AS week FROM events),
l AS (SELECT user_id, event_type, week, max(ts) AS added FROM e WHERE value > 200 GROUP BY user_id, event_type, week)
SELECT event_id, CAST(added IS NOT NULL AS BIGINT) AS is_week_favorite, strftime(added, '%Y-%m-%d %H:%M:%S') AS added_at_utc
FROM e LEFT JOIN l ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.week = l.week"""


def coalesce_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two sides of a join merged into one column, then ordered source by source."""
    orders, customer = tables(spark, folder, "orders", "customer")
    left = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"),
                         F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("tag_x"))
    right = customer.select("c_custkey", F.col("c_mktsegment").alias("tag_y"), "c_name")
    merged = columns.coalesce_sides(joins.lookup(left, right, ["c_custkey"], spread_by=["o_orderkey"]), "tag")
    return report(columns.order_columns(merged, ["o_orderkey", "tag"], ["c_name"], tail=["c_custkey"]))


QUERIES["coalesce_columns"] = coalesce_columns
SQL["coalesce_columns"] = """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, c_mktsegment) AS tag, c_name,
  o_custkey AS c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def pending_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with an order, without one of the urgent kind."""
    orders = tables(spark, folder, "orders")
    urgent = orders.filter(F.col("o_orderpriority").startswith("1")).select("o_custkey")
    return report(joins.pending_keys(orders, urgent, ["o_custkey"]))


QUERIES["pending_keys"] = pending_keys
SQL["pending_keys"] = """
SELECT DISTINCT o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL)"""


def pending_keys_null(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (segment or nothing, nation) pairs of poor customers that no rich customer has; null equals null."""
    customer = tables(spark, folder, "customer").withColumn(
        "segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    rich = customer.filter("c_acctbal > 9000")
    return report(joins.pending_keys(customer.filter("c_acctbal <= 9000"), rich, ["segment", "c_nationkey"], keep_null=True))


QUERIES["pending_keys_null"] = pending_keys_null
SQL["pending_keys_null"] = """
WITH c AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  c_acctbal FROM customer)
SELECT DISTINCT segment, c_nationkey FROM c WHERE c_acctbal <= 9000
EXCEPT SELECT segment, c_nationkey FROM c WHERE c_acctbal > 9000"""


def first_name(spark: SparkSession, folder: str) -> DataFrame:
    """The first event type of every user."""
    events = tables(spark, folder, "events")
    return report(joins.first_name(events, "user_id", "event_type", "event_id"))


QUERIES["first_name"] = first_name
SQL["first_name"] = "SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def two_pass_match(spark: SparkSession, folder: str) -> DataFrame:
    """Credited brands matched to the parts on the full credit, else on the cut one."""
    part = tables(spark, folder, "part")
    credit = F.when(F.col("p_size") < 25, F.col("p_brand")).when(
        F.col("p_size") < 40, F.concat("p_brand", F.lit(" feat. guest"))).otherwise(F.concat("p_brand", F.lit(" and band")))
    wanted = part.select(credit.alias("artist_name"), F.col("p_type").alias("track_name")).distinct()
    catalog = part.select(F.col("p_brand").alias("artist_name"), F.col("p_type").alias("track_name"), "p_partkey")
    return report(joins.two_pass_match(wanted, catalog, order=["p_partkey"]))


QUERIES["two_pass_match"] = two_pass_match
SQL["two_pass_match"] = """
WITH w AS (SELECT DISTINCT CASE WHEN p_size < 25 THEN p_brand WHEN p_size < 40 THEN p_brand || ' feat. guest'
    ELSE p_brand || ' and band' END AS artist_name, p_type AS track_name FROM part),
c AS (SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_type)
SELECT artist_name, track_name, p_partkey,
  CAST(CASE WHEN p_partkey IS NOT NULL THEN CASE WHEN artist_name LIKE '% feat.%' THEN 2 ELSE 1 END END AS BIGINT) AS match_pass
FROM w LEFT JOIN c ON c.p_brand = replace(artist_name, ' feat. guest', '') AND c.p_type = track_name"""


def lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    """Nation names of customers by lower-case code, Unknown for codes outside the table."""
    customer, nation = tables(spark, folder, "customer", "nation")
    table = nation.filter("n_regionkey > 0").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("country"))
    code = F.concat(F.lit("n"), F.col("c_nationkey"))
    return report(joins.with_lookup(customer.select("c_custkey", "c_nationkey"), code, table, "country", "country_name")
                  .drop("c_nationkey"))


QUERIES["lookup_default"] = lookup_default
SQL["lookup_default"] = """
SELECT c_custkey, coalesce(n_name, 'Unknown') AS country_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 0"""


def unified_table(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as plays, joined to five metadata tables and to labels on canonical keys."""
    lineitem, part, supplier = tables(spark, folder, "lineitem", "part", "supplier")
    names = part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    played = joins.lookup(lineitem, names, ["l_partkey"], spread_by=["l_orderkey", "l_linenumber"])
    events = played.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scrobble_number"), "l_partkey", "l_suppkey",
        F.col("l_shipdate").alias("date"), F.upper("p_brand").alias("artist_name"), F.col("p_name").alias("track_name"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("album_name"),
        F.concat(F.lit("m"), F.length("p_name")).alias("artist_mbid"), "l_quantity")
    brand = part.select(F.concat(F.lit(" "), F.lower("p_brand")).alias("artist_name"), "p_name", "p_size", "p_retailprice")
    artists = brand.groupBy("artist_name").agg(F.max("p_size").alias("artist_listeners"))
    tracks = brand.groupBy("artist_name", F.col("p_name").alias("track_name")).agg(F.max("p_size").alias("track_duration"))
    albums = brand.select("artist_name", F.lit("f ").alias("album_name"), "p_size").groupBy("artist_name", "album_name").agg(
        F.min("p_size").alias("album_listeners"))
    metadata = part.groupBy(F.concat(F.lit("m"), F.length("p_name")).alias("artist_mbid")).agg(
        F.max("p_type").alias("mb_artist_type"))
    catalog = brand.groupBy("artist_name", F.col("p_name").alias("track_name")).agg(
        F.max("p_retailprice").alias("spotify_popularity"), F.max("p_size").alias("track_duration"))
    favorites = events.filter("l_quantity >= 49 and album_name = 'F'").select(
        F.lower("artist_name").alias("artist_name"), "track_name", dates.week_ending_saturday(F.col("date")).alias(schemas.WEEK),
        F.col("date").alias("added_at_utc"), F.lit(1).alias(schemas.LABEL))
    return report(unify(events, artists=artists, tracks=tracks, albums=albums, artist_metadata=metadata, catalog=catalog,
                        favorites=favorites).drop("l_partkey", "l_suppkey", "l_quantity"))


QUERIES["unified_table"] = unified_table
SQL["unified_table"] = f"""
WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS scrobble_number, l_shipdate, upper(p_brand) AS artist_name, p_name AS track_name,
    CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS album_name, 'm' || length(p_name) AS artist_mbid,
    lower(p_brand) AS artist_key, l_quantity, {saturday('l_shipdate')} AS week FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
ar AS (SELECT lower(p_brand) AS k, max(p_size) AS listeners, min(p_size) AS low FROM part GROUP BY 1),
tr AS (SELECT lower(p_brand) AS k, p_name, max(p_size) AS duration, max(p_retailprice) AS price FROM part GROUP BY 1, 2),
mb AS (SELECT 'm' || length(p_name) AS id, max(p_type) AS kind FROM part GROUP BY 1),
fav AS (SELECT artist_key, track_name, week, max(l_shipdate) AS added FROM e WHERE l_quantity >= 49 AND album_name = 'F' GROUP BY 1, 2, 3)
SELECT scrobble_number, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date, artist_name, e.track_name, album_name, artist_mbid,
  e.artist_key, lower(e.track_name) AS track_key, lower(album_name) AS album_key, CAST(listeners AS BIGINT) AS artist_listeners,
  CAST(duration AS BIGINT) AS track_duration, CAST(CASE WHEN album_name = 'F' THEN low END AS BIGINT) AS album_listeners,
  kind AS mb_artist_type, {r('price')} AS spotify_popularity, CAST(e.week AS VARCHAR) AS week_saturday_utc,
  strftime(added, '%Y-%m-%d %H:%M:%S') AS added_at_utc, CAST(added IS NOT NULL AS BIGINT) AS is_week_favorite
FROM e LEFT JOIN ar ON e.artist_key = ar.k LEFT JOIN tr ON e.artist_key = tr.k AND e.track_name = tr.p_name
LEFT JOIN mb ON e.artist_mbid = mb.id
LEFT JOIN fav ON e.artist_key = fav.artist_key AND e.track_name = fav.track_name AND e.week = fav.week"""

# --- unions, slices, merges ---------------------------------------------------------------------

_HALF = "2024-01-15 00:00:00"


def union_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers stacked, absent columns null."""
    part, supplier = tables(spark, folder, "part", "supplier")
    left = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), "p_brand")
    right = supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return report(ordered.union_all(left, right, fill=True))


QUERIES["union_fill"] = union_fill
SQL["union_fill"] = f"""
SELECT p_partkey AS key, p_name AS name, p_brand, CAST(NULL AS DOUBLE) AS s_acctbal FROM part
UNION ALL SELECT s_suppkey, s_name, NULL, {r('s_acctbal')} FROM supplier"""


def ranked_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Orders 50 to 100 of the most expensive ones."""
    orders = tables(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return report(ordered.row_slice(orders, 49, 100, F.desc("o_totalprice"), "o_orderkey"))


QUERIES["ranked_slice"] = ranked_slice
SQL["ranked_slice"] = (f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice FROM orders "
                       "ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 51 OFFSET 49")


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the first half merged with the second half: the newest per user, type and week."""
    events = weekly.anchor_week(tables(spark, folder, "events"), "ts").select(
        "user_id", "event_type", schemas.WEEK, "ts", "event_id", "value")
    stored = events.filter(F.col("ts") < F.lit(_HALF).cast("timestamp_ntz")).drop("value")
    fresh = events.filter(F.col("ts") >= F.lit(_HALF).cast("timestamp_ntz"))
    return report(merge.upsert(stored, fresh, ["user_id", "event_type", schemas.WEEK], ["ts", "event_id"]))


QUERIES["upsert_latest"] = upsert_latest
SQL["upsert_latest"] = f"""
WITH e AS (SELECT *, {saturday('ts')} AS week FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, week ORDER BY ts DESC, event_id DESC) AS rn FROM e)
SELECT user_id, event_type, CAST(week AS VARCHAR) AS week_saturday_utc, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id,
  {r(f"CASE WHEN ts >= TIMESTAMP '{_HALF}' THEN value END")} AS value FROM n WHERE rn = 1"""


def incremental_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events after the newest stored one, up to a bound."""
    events = tables(spark, folder, "events")
    stored = events.filter(F.col("ts") < F.lit(_HALF).cast("timestamp_ntz"))
    return report(ingest.new_rows(events, stored, "ts", "2024-01-25 12:00:00").select("event_id", "ts", "value"))


QUERIES["incremental_rows"] = incremental_rows
SQL["incremental_rows"] = f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r('value')} AS value FROM events
WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{_HALF}') AND ts <= TIMESTAMP '2024-01-25 12:00:00'"""


def high_water_mark(spark: SparkSession, folder: str) -> DataFrame:
    """Next start time and last number of the stored events."""
    return report(profile.high_water_mark(tables(spark, folder, "events"), "ts", "event_id"))


QUERIES["high_water_mark"] = high_water_mark
SQL["high_water_mark"] = (
    "SELECT CAST(floor(epoch(max(ts))) AS BIGINT) + 1 AS from_unix, max(event_id) AS last_number FROM events")


def running_number(spark: SparkSession, folder: str) -> DataFrame:
    """Line items numbered on from 1000 by ship date; many share a date."""
    lineitem = tables(spark, folder, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                        "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return report(ordered.running_number(lineitem, order, "scrobble_number", 1000))


QUERIES["running_number"] = running_number
SQL["running_number"] = f"""
SELECT 1000 + row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS scrobble_number,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  l_suppkey, {r('l_extendedprice')} AS l_extendedprice FROM lineitem"""


def upsert_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """The same upsert against a stored table partitioned by week: two writes, then read back."""
    events = weekly.anchor_week(tables(spark, folder, "events"), "ts").select(
        "user_id", "event_type", F.date_format(schemas.WEEK, "yyyy-MM-dd").alias(schemas.WEEK), "ts", "event_id", "value")
    path = session.scratch_path(spark, "upsert")
    keys, newest = ["user_id", "event_type", schemas.WEEK], ["ts", "event_id"]
    half = F.lit(_HALF).cast("timestamp_ntz")
    merge.upsert_partitions(events.filter(F.col("ts") < half), path, keys, newest, schemas.WEEK, exists=False)
    merge.upsert_partitions(events.filter(F.col("ts") >= half), path, keys, newest, schemas.WEEK, exists=True)
    return report(spark.read.schema(events.schema).parquet(path))


QUERIES["upsert_partitions"] = upsert_partitions
SQL["upsert_partitions"] = SQL["upsert_latest"].replace(
    f"CASE WHEN ts >= TIMESTAMP '{_HALF}' THEN value END", "value")
