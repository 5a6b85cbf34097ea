"""Cleaning, parsing and typing on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas, session
from weekrank.functions import dates, nested, numbers, text
from weekrank.operators import columns, impute, joins
from weekrank.plans.clean import clean_events as clean_plan
from weekrank.queries.common import r, report, tables

QUERIES: dict = {}
SQL: dict = {}


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Part names padded with tabs, no-break spaces and blanks come back trimmed."""
    part = tables(spark, folder, "part")
    padded = F.concat(F.lit("\t  "), F.upper("p_name"), F.lit("  \n"))
    return report(columns.trim_columns(part.select("p_partkey", padded.alias("name")), ["name"]))


QUERIES["clean_text"] = clean_text
SQL["clean_text"] = "SELECT p_partkey, upper(p_name) AS name FROM part"


def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Join keys of differently typed customer and part names, computed on distinct names."""
    customer, part = tables(spark, folder, "customer", "part")
    typed = customer.select(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t x  ")).alias("artist_name"),
                            F.col("c_mktsegment").alias("track_name"))
    other = part.select(F.concat("p_brand", F.lit("   "), "p_name").alias("artist_name"), F.col("p_type").alias("track_name"))
    return report(joins.name_keys(typed.unionByName(other), ["artist_name", "track_name"]))


QUERIES["canonical_keys"] = canonical_keys
SQL["canonical_keys"] = r"""
WITH t AS (SELECT '  ' || upper(c_name) || chr(9) || ' x  ' AS artist_name, c_mktsegment AS track_name FROM customer
  UNION ALL SELECT p_brand || '   ' || p_name, p_type FROM part)
SELECT artist_name, track_name, count(*) AS n, lower(trim(regexp_replace(artist_name, '\s+', ' ', 'g'))) AS artist_key,
  lower(track_name) AS track_key FROM t GROUP BY artist_name, track_name"""


_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ#0123456789")


def unicode_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of customer names, a third of them in full-width letters with no-break spaces: split between the JVM and Python."""
    customer = tables(spark, folder, "customer")
    wide = F.concat(F.lit("\u00a0\u3000"), F.translate(F.upper("c_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ#0123456789", _WIDE), F.lit("\u00a0X\u2003"))
    names = session.cut(customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, wide).when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(" \t"), "c_name", F.lit("  x"))).alias("name")))
    return report(joins.split_keys(names, "name", "key").select("c_custkey", "key"))


QUERIES["unicode_keys"] = unicode_keys
SQL["unicode_keys"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 <> 0 THEN lower(c_name) || ' x' END AS key FROM customer"""


def text_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of the join keys of whole documents in several languages."""
    documents = tables(spark, folder, "documents")
    keyed = documents.select("doc_id", "lang", F.length(text.canonical_key(F.col("text"))).alias("key_length"))
    return report(keyed)


QUERIES["text_keys"] = text_keys


def partial_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates printed as year, month, day, day and time, or badly: standard day, granularity, timestamp."""
    orders = tables(spark, folder, "orders")
    printed = orders.select("o_orderkey", printed_dates().alias("printed"))
    return report(columns.standardise_release(printed.withColumn("day", F.col("printed")), "day", "granularity")
                  .withColumn("normalised", dates.normalise_partial(F.col("printed")))
                  .withColumn("parsed", dates.release_timestamp(F.col("printed"))))


def printed_dates() -> F.Column:
    at, kind = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    return (F.when(kind == "1", F.date_format(at, " yyyy ")).when(kind == "2", F.date_format(at, "yyyy-MM"))
            .when(kind == "3", F.date_format(at, "yyyy-MM-dd")).when(kind == "4", F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(at, "yyyy-'13'-dd")))


PRINTED_SQL = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, ' %Y ') WHEN '2' THEN strftime(o_orderdate, '%Y-%m')
  WHEN '3' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '4' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(o_orderdate, '%Y-13-%d') END"""
QUERIES["partial_dates"] = partial_dates
SQL["partial_dates"] = f"""
WITH p AS (SELECT o_orderkey, {PRINTED_SQL} AS printed, substr(o_orderpriority, 1, 1) AS k, o_orderdate FROM orders)
SELECT o_orderkey, printed,
  CASE k WHEN '1' THEN strftime(o_orderdate, '%Y-01-01') WHEN '2' THEN strftime(o_orderdate, '%Y-%m-01')
    WHEN '3' THEN printed WHEN '4' THEN substr(printed, 1, 10) ELSE printed END AS day,
  CASE k WHEN '1' THEN 'year' WHEN '2' THEN 'month' ELSE 'day' END AS granularity,
  CASE k WHEN '1' THEN strftime(o_orderdate, '%Y-01-01') WHEN '2' THEN strftime(o_orderdate, '%Y-%m-01')
    WHEN '3' THEN printed END AS normalised,
  CASE k WHEN '1' THEN strftime(o_orderdate, '%Y-01-01 00:00:00') WHEN '2' THEN strftime(o_orderdate, '%Y-%m-01 00:00:00')
    WHEN '3' THEN printed || ' 00:00:00' WHEN '4' THEN printed END AS parsed
FROM p"""


def parse_display_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Event times printed as display text, as ISO text or as junk, and read back."""
    events = tables(spark, folder, "events")
    printed = (F.when(F.col("event_type") == "error", "soon").when(F.col("event_type") == "view", dates.iso_text(F.col("ts")))
               .otherwise(F.date_format("ts", dates.DISPLAY_FORMAT)))
    shown = events.select("event_id", "event_type", printed.alias("printed"))
    parsed = dates.parse_display(F.col("printed"))
    return report(shown.select("event_id", "printed", dates.iso_text(parsed).alias("iso"),
                               dates.display_epoch(F.col("printed")).alias("epoch"), F.weekday(parsed).alias("weekday"),
                               F.to_date(parsed).alias("day")))


QUERIES["parse_display_dates"] = parse_display_dates
SQL["parse_display_dates"] = """
WITH p AS (SELECT event_id, event_type, ts, CASE event_type WHEN 'error' THEN 'soon'
    WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%d %b %Y, %H:%M') END AS printed FROM events),
q AS (SELECT *, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN date_trunc('second', ts)
    ELSE date_trunc('minute', ts) END AS tm FROM p)
SELECT event_id, printed, strftime(tm, '%Y-%m-%d %H:%M:%S') AS iso,
  CAST(CASE WHEN event_type NOT IN ('error', 'view') THEN epoch(tm) END AS BIGINT) AS epoch,
  (dayofweek(tm) + 6) % 7 AS weekday, CAST(CAST(tm AS DATE) AS VARCHAR) AS day FROM q"""

# A genre-like list per part: its name, a genre chosen by its type, and a second one chosen by its size.
_GENRES = {"ECONOMY": "garage rock", "SMALL": "k-pop", "MEDIUM": "indie pop", "PROMO": "Hip Hop", "STANDARD": "therapy",
           "LARGE": "post-rock"}


def genre_text() -> F.Column:
    by_type = F.create_map(*[F.lit(x) for pair in _GENRES.items() for x in pair])[F.col("p_type")]
    return F.when(F.col("p_size") < 5, "").otherwise(F.concat_ws(
        ", ", "p_name", by_type, F.when(F.col("p_size") > 30, "rock"), F.when(F.col("p_size") > 40, " Soul ")))


GENRE_SQL = ("CASE WHEN p_size < 5 THEN '' ELSE concat_ws(', ', p_name, CASE p_type "
              + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _GENRES.items())
              + " END, CASE WHEN p_size > 30 THEN 'rock' END, CASE WHEN p_size > 40 THEN ' Soul ' END) END")


def bucket_sql(c: str) -> str:
    arms = []
    for bucket, needles in schemas.GENRE_BUCKETS:
        test = " OR ".join(f"contains({c}, '{n}')" for n in needles)
        arms.append(f"WHEN {test} THEN '{bucket}'")
    return f"CASE {' '.join(arms)} ELSE 'other' END"


def category_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket of every listed genre of every part."""
    part = tables(spark, folder, "part").withColumn("spotify_genres", genre_text())
    items = part.select("p_partkey", F.posexplode(text.split_list(F.col("spotify_genres"))).alias("place", "genre"))
    return report(items.withColumn("bucket", text.bucket_of(F.col("genre"))))


ITEMS_CTE = f"""g AS (SELECT p_partkey, {GENRE_SQL} AS genres FROM part),
s AS (SELECT p_partkey, unnest(list_filter(list_transform(string_split(lower(genres), ','), lambda x: trim(x)), lambda x: x <> '')) AS genre,
  generate_subscripts(list_filter(list_transform(string_split(lower(genres), ','), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM g),
b AS (SELECT p_partkey, genre, pos, {bucket_sql('genre')} AS bucket FROM s)"""
QUERIES["category_buckets"] = category_buckets
SQL["category_buckets"] = f"WITH {ITEMS_CTE} SELECT p_partkey, pos - 1 AS place, genre, bucket FROM b"


def array_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent bucket per part (smallest on ties, unknown for none) and the empty flag."""
    part = tables(spark, folder, "part").withColumn("spotify_genres", genre_text())
    return report(columns.genre_bucket(part).select("p_partkey", "genre_bucket", "genre_missing"))


QUERIES["array_mode"] = array_mode
SQL["array_mode"] = f"""
WITH {ITEMS_CTE}, c AS (SELECT p_partkey, bucket, count(*) AS n FROM b GROUP BY p_partkey, bucket),
m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, bucket) AS rn FROM c)
SELECT p.p_partkey, coalesce(bucket, 'unknown') AS genre_bucket, CAST(bucket IS NULL AS BIGINT) AS genre_missing
FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey AND rn = 1"""


def clean_credit(spark: SparkSession, folder: str) -> DataFrame:
    """Brands credited with guests, cut back to the brand."""
    part = tables(spark, folder, "part")
    guest = (F.when(F.col("p_size") < 10, " feat. ").when(F.col("p_size") < 20, " [live] ")
             .when(F.col("p_size") < 30, " X ").when(F.col("p_size") < 40, " Ft. ").otherwise(" and "))
    credit = F.concat("p_brand", guest, "p_name")
    return report(part.select("p_partkey", credit.alias("credit"), text.clean_credit(credit).alias("artist")))


QUERIES["clean_credit"] = clean_credit
SQL["clean_credit"] = """
WITH c AS (SELECT p_partkey, p_size, p_brand, p_brand || CASE WHEN p_size < 10 THEN ' feat. ' WHEN p_size < 20 THEN ' [live] '
  WHEN p_size < 30 THEN ' X ' WHEN p_size < 40 THEN ' Ft. ' ELSE ' and ' END || p_name AS credit FROM part)
SELECT p_partkey, credit, CASE WHEN p_size < 40 THEN p_brand ELSE credit END AS artist FROM c"""


def numeric_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Balances printed as text, some unreadable, cast leniently and rounded half to even."""
    customer = tables(spark, folder, "customer")
    printed = (F.when(F.col("c_mktsegment") == "BUILDING", "n/a").when(F.col("c_mktsegment") == "MACHINERY", "")
               .otherwise(F.format_string(" %.2f ", "c_acctbal")))
    typed = columns.to_numbers(customer.select("c_custkey", printed.alias("balance")), ["balance"])
    return report(columns.round_counts(typed.withColumn("rounded", F.col("balance")), ["rounded"]))


QUERIES["numeric_clean"] = numeric_clean
SQL["numeric_clean"] = f"""
WITH p AS (SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_acctbal END AS balance FROM customer)
SELECT c_custkey, {r('balance')} AS balance, CAST(round_even(balance, 0) AS BIGINT) AS rounded FROM p"""


def median_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of three line item columns filled with the exact median, with flags."""
    lineitem = tables(spark, folder, "lineitem")
    gaps = lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("price"), F.col("l_discount").alias("discount"))
    return report(impute.fill_medians(gaps, ["quantity", "price", "discount"]))


QUERIES["median_fill"] = median_fill
SQL["median_fill"] = f"""
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS q,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS p, l_discount AS d FROM lineitem),
m AS (SELECT median(q) AS mq, median(p) AS mp, median(d) AS md FROM g)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
  {r('coalesce(q, mq)')} AS quantity, {r('coalesce(p, mp)')} AS price, {r('coalesce(d, md)')} AS discount,
  CAST(q IS NULL AS BIGINT) AS quantity_was_missing, CAST(p IS NULL AS BIGINT) AS price_was_missing,
  CAST(d IS NULL AS BIGINT) AS discount_was_missing FROM g, m"""


def round_half_even(spark: SparkSession, folder: str) -> DataFrame:
    """Half quantities: 0.5 goes to 0, 1.5 to 2, 2.5 to 2."""
    lineitem = tables(spark, folder, "lineitem")
    half = F.col("l_quantity") / 2
    return report(lineitem.groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "rounded", numbers.round_half_even(F.col("half"))))


QUERIES["round_half_even"] = round_half_even
SQL["round_half_even"] = f"""
SELECT {r('l_quantity / 2')} AS half, count(*) AS n, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS rounded
FROM lineitem GROUP BY l_quantity"""


def fill_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Missing text and whole numbers filled by declared type; other columns keep their gaps."""
    documents, labels = tables(spark, folder, "documents", "labels")
    wide = documents.select("doc_id", "lang").join(labels, "doc_id", "left")
    gaps = wide.withColumn("tag", F.when(F.col("quality") == 1, F.col("lang"))).withColumn("raw", F.col("toxic"))
    return report(columns.fill_by_type(gaps, {"tag": "str", "quality": "int64", "toxic": "int32", "absent": "str"}))


QUERIES["fill_by_type"] = fill_by_type
SQL["fill_by_type"] = """
SELECT d.doc_id, lang, CAST(coalesce(quality, 0) AS BIGINT) AS quality, CAST(coalesce(toxic, 0) AS BIGINT) AS toxic,
  coalesce(CASE WHEN quality = 1 THEN lang END, '') AS tag, CAST(toxic AS BIGINT) AS raw
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def bool_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Nullable booleans, booleans as 1.0 / 0.0, first items and capped values."""
    documents, labels = tables(spark, folder, "documents", "labels")
    wide = documents.select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return report(wide.select(
        "doc_id", numbers.bool_or_null(F.col("quality")).alias("good"), numbers.bool_as_double(F.col("quality")).alias("good_number"),
        numbers.flag(F.col("toxic") == 1).alias("toxic_flag"), numbers.capped(F.col("n_chars"), 600).alias("chars_capped")))


QUERIES["bool_casts"] = bool_casts
SQL["bool_casts"] = """
SELECT d.doc_id, CAST(CAST(quality AS BOOLEAN) AS BIGINT) AS good, CAST(coalesce(quality, 0) AS DOUBLE) AS good_number,
  CAST(coalesce(toxic = 1, false) AS BIGINT) AS toxic_flag, least(n_chars, 600) AS chars_capped
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def rename_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Exact-match corrections of one and of two columns, after a column rename."""
    part = tables(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    named = columns.rename(part, {"p_brand": "artist_name", "p_type": "track_name"})
    fixes = [({"track_name": "PROMO"}, {"track_name": "PROMOTION"}),
             ({"track_name": "SMALL", "artist_name": "Brand#4"}, {"track_name": "TINY", "artist_name": "Brand#44"})]
    return report(columns.apply_fixes(named, fixes))


QUERIES["rename_rules"] = rename_rules
SQL["rename_rules"] = """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#4' AND p_type = 'SMALL' THEN 'Brand#44' ELSE p_brand END AS artist_name,
  CASE WHEN p_type = 'PROMO' THEN 'PROMOTION' WHEN p_brand = 'Brand#4' AND p_type = 'SMALL' THEN 'TINY' ELSE p_type END AS track_name
FROM part"""


def conform_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Customers reshaped to a fixed schema: extra columns dropped, absent ones null, types cast."""
    wanted = T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType()),
        T.StructField("c_acctbal", T.StringType()), T.StructField("c_name", T.LongType()),
        T.StructField("c_country", T.StringType())])
    customer = tables(spark, folder, "customer").withColumn("c_acctbal", numbers.round_half_even(F.col("c_acctbal")))
    return report(columns.conform(customer, wanted))


QUERIES["conform_schema"] = conform_schema
SQL["conform_schema"] = """
SELECT c_custkey, c_mktsegment, CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) AS c_acctbal,
  CAST(NULL AS BIGINT) AS c_name, CAST(NULL AS VARCHAR) AS c_country FROM customer"""


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties read from JSON with defaults for what is absent."""
    events = tables(spark, folder, "events")
    shape = T.StructType([T.StructField("k", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    parsed = events.withColumn("d", F.from_json("props", shape))
    return report(parsed.select(
        "event_id", nested.count_or_zero(F.col("d.k")).alias("k"),
        F.coalesce(nested.first_item(F.col("d.tags")), F.lit("none")).alias("tag")))


QUERIES["json_props"] = json_props
SQL["json_props"] = """
SELECT event_id, coalesce(CAST(props::JSON ->> 'k' AS BIGINT), 0) AS k, 'none' AS tag FROM events"""


def _raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with part and supplier facts, as an uncleaned listening table."""
    lineitem, part, supplier = tables(spark, folder, "lineitem", "part", "supplier")
    wide = joins.lookup(lineitem.withColumnRenamed("l_partkey", "p_partkey"),
                        part.withColumn("spotify_genres", genre_text()), ["p_partkey"], spread_by=["l_orderkey", "l_linenumber"])
    wide = joins.lookup(wide.withColumnRenamed("l_suppkey", "s_suppkey"), supplier, ["s_suppkey"],
                        spread_by=["l_orderkey", "l_linenumber"],
                        counts=joins.key_counts(lineitem.withColumnRenamed("l_suppkey", "s_suppkey"), ["s_suppkey"]))
    shown = F.col("l_returnflag")
    return wide.select(
        F.concat(F.lit(" "), "s_name", F.lit("\t")).alias("artist_name"), F.concat(F.lit(" "), "p_name").alias("track_name"),
        F.col("l_orderkey").alias("scrobble_number"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("date"),
        F.when(shown == "A", F.date_format("l_shipdate", "yyyy-MM")).when(shown == "N", F.date_format("l_shipdate", "yyyy"))
        .otherwise("unknown").alias("spotify_release_date"),
        "spotify_genres", F.col("p_size").cast("string").alias("track_duration"),
        F.when(shown == "R", "x").otherwise(F.col("l_quantity").cast("string")).alias("artist_listeners"),
        F.when(shown == "A", F.col("l_tax").cast("string")).alias("spotify_popularity"),
        F.col("p_retailprice").alias("spotify_duration_ms"))


def clean_events(spark: SparkSession, folder: str) -> DataFrame:
    """All cleaning steps in order on a wide event table."""
    return report(clean_plan(_raw_events(spark, folder)))


QUERIES["clean_events"] = clean_events
SQL["clean_events"] = f"""
WITH {ITEMS_CTE}, c AS (SELECT p_partkey, bucket, count(*) AS n FROM b GROUP BY p_partkey, bucket),
m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, bucket) AS rn FROM c),
e AS (SELECT s.s_name, p.p_name, l.*, g.genres, p.p_size, m.bucket,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS lis, CASE WHEN l_returnflag = 'A' THEN l_tax END AS pop
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN g ON g.p_partkey = p.p_partkey LEFT JOIN m ON m.p_partkey = p.p_partkey AND rn = 1),
med AS (SELECT median(lis) AS mlis, median(pop) AS mpop FROM e)
SELECT s_name AS artist_name, p_name AS track_name, l_orderkey AS scrobble_number, CAST(l_linenumber AS BIGINT) AS line,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date,
  CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%Y-%m-01') WHEN 'N' THEN strftime(l_shipdate, '%Y-01-01') END AS spotify_release_date,
  genres AS spotify_genres, CAST(p_size AS DOUBLE) AS track_duration,
  CAST(round_even(coalesce(lis, mlis), 0) AS BIGINT) AS artist_listeners, {r('coalesce(pop, mpop)')} AS spotify_popularity,
  CASE l_returnflag WHEN 'A' THEN 'month' WHEN 'N' THEN 'year' END AS release_date_granularity,
  CAST(l_shipdate IS NULL AS BIGINT) AS date_was_missing, CAST(l_returnflag = 'R' AS BIGINT) AS spotify_release_date_was_missing,
  coalesce(bucket, 'unknown') AS genre_bucket, CAST(bucket IS NULL AS BIGINT) AS genre_missing,
  CAST(lis IS NULL AS BIGINT) AS artist_listeners_was_missing, CAST(pop IS NULL AS BIGINT) AS spotify_popularity_was_missing
FROM e, med"""
