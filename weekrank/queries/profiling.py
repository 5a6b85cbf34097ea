"""Profiling reports on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank import schemas
from weekrank.operators import encode, features, ordered, profile
from weekrank.queries.cleaning import ITEMS_CTE, PRINTED_SQL, genre_text, printed_dates
from weekrank.queries.common import (
    EVENTS_CTE, ORDERS_CTE, SEGMENT, order_events, order_weekly, r, report, tables, week_events,
)
from weekrank.queries.weekly import TABLE_CTE

QUERIES: dict = {}
SQL: dict = {}


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly segments with momentum and history."""
    base = order_weekly(spark, folder)
    return features.add_history_family(features.add_momentum_family(base, entity=SEGMENT), entity=SEGMENT)


# --- table shape --------------------------------------------------------------------------------

def missing_table(spark: SparkSession, folder: str) -> DataFrame:
    """Missing values per column of documents with their labels."""
    documents, labels = tables(spark, folder, "documents", "labels")
    wide = documents.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    return report(profile.missing_table(wide))


_WIDE = "w AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
QUERIES["missing_table"] = missing_table
SQL["missing_table"] = f"WITH {_WIDE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {r(f'1.0 - count({c}) / CAST(count(*) AS DOUBLE)')} AS na_pct, count({c}) AS non_null, "
    f"count(*) - count({c}) AS null FROM w" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic"))
SQL["missing_table"] = SQL["missing_table"].replace("AS column", 'AS "column"').replace("AS null", 'AS "null"')


def schema_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Columns, types and size of the customer table."""
    return report(profile.schema_profile(tables(spark, folder, "customer")))


QUERIES["schema_profile"] = schema_profile
SQL["schema_profile"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM customer"
    for i, (c, t) in enumerate([("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                                ("c_mktsegment", "string")]))


def describe(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of numeric and text columns of orders."""
    orders = tables(spark, folder, "orders")
    return report(profile.describe(orders, ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]))


QUERIES["describe"] = describe
SQL["describe"] = " UNION ALL ".join([
    *[f"SELECT '{c}' AS \"column\", count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
      f"CAST(NULL AS BIGINT) AS freq, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'CAST(min({c}) AS DOUBLE)')} AS min, "
      f"{r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50, {r(f'quantile_cont({c}, 0.75)')} AS p75, "
      f"{r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM orders" for c in ("o_custkey", "o_totalprice")],
    *[f"SELECT '{c}', CAST(sum(n) AS BIGINT), count(*), min_by(v, (-n, v)), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL "
      f"FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY {c})" for c in ("o_orderstatus", "o_orderpriority")]])


def date_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes and span of differently printed order dates."""
    orders = tables(spark, folder, "orders").withColumn("printed", printed_dates())
    return report(profile.date_profile(orders, ["printed", "o_orderdate"]))


QUERIES["date_profile"] = date_profile
SQL["date_profile"] = f"""
WITH p AS (SELECT *, {PRINTED_SQL} AS printed, substr(o_orderpriority, 1, 1) AS k FROM orders),
q AS (SELECT *, CASE k WHEN '1' THEN date_trunc('year', o_orderdate) WHEN '2' THEN date_trunc('month', o_orderdate)
  WHEN '3' THEN o_orderdate WHEN '4' THEN o_orderdate END AS tm FROM p)
SELECT 'printed' AS "column", count(printed) AS non_null, CAST(0 AS BIGINT) AS yyyy_only, count(*) FILTER (WHERE k = '2') AS yyyy_mm,
  count(*) FILTER (WHERE k IN ('3', '5')) AS yyyy_mm_dd, count(*) FILTER (WHERE k = '4') AS datetime,
  count(*) FILTER (WHERE k = '1') AS other_invalid, count(tm) AS parsed_ok, strftime(min(tm), '%Y-%m-%d %H:%M:%S') AS min_parsed,
  strftime(max(tm), '%Y-%m-%d %H:%M:%S') AS max_parsed FROM q
UNION ALL SELECT 'o_orderdate', count(*), 0, 0, 0, count(*), 0, count(*), strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'),
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders"""


def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate line items: whole rows, by order line, by order."""
    lineitem = tables(spark, folder, "lineitem")
    return report(profile.duplicate_counts(lineitem, {
        "exact_row": lineitem.columns, "order_line": ["l_orderkey", "l_linenumber"], "order": ["l_orderkey"]}))


QUERIES["duplicates"] = duplicates
SQL["duplicates"] = " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM lineitem)) AS BIGINT) AS dupe_count"
    for name, c in (("exact_row", "*"), ("order_line", "l_orderkey, l_linenumber"), ("order", "l_orderkey")))


def validity(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of line items that break a rule, in one pass."""
    lineitem = tables(spark, folder, "lineitem")
    played = lineitem.select(
        (F.col("l_quantity") - 10).alias("track_duration"), (F.col("l_discount") - 0.05).cast("string").alias("spotify_duration_ms"),
        (F.col("l_quantity") * 3 - 20).alias("spotify_popularity"), F.col("l_shipdate").alias("date"))
    return report(profile.validity(played, profile.listening_checks("2000-01-01")))


QUERIES["validity"] = validity
SQL["validity"] = """
SELECT 'track_duration_negative' AS metric, count(*) AS n_rows FROM lineitem WHERE l_quantity < 10
UNION ALL SELECT 'spotify_duration_ms_negative', count(*) FROM lineitem WHERE l_discount - 0.05::DOUBLE < 0
UNION ALL SELECT 'spotify_popularity_out_of_range', count(*) FROM lineitem WHERE l_quantity * 3 - 20 < 0 OR l_quantity * 3 - 20 > 100
UNION ALL SELECT 'date_in_future', count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-01'"""


def time_span(spark: SparkSession, folder: str) -> DataFrame:
    """First and last event."""
    return report(profile.time_span(tables(spark, folder, "events"), "ts"))


QUERIES["time_span"] = time_span
SQL["time_span"] = ("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events")

# --- counts and shares --------------------------------------------------------------------------


def value_counts_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 busiest user and event type pairs."""
    return report(profile.top_values(tables(spark, folder, "events"), ["user_id", "event_type"], 20, "scrobbles"))


QUERIES["value_counts_top"] = value_counts_top
SQL["value_counts_top"] = ("SELECT user_id, event_type, count(*) AS scrobbles FROM events GROUP BY user_id, event_type "
                           "ORDER BY scrobbles DESC, user_id, event_type LIMIT 20")


def top_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean number of events over the 100 busiest users."""
    return report(profile.top_mean(tables(spark, folder, "events"), ["user_id"], 100))


QUERIES["top_mean"] = top_mean
SQL["top_mean"] = (f"SELECT {r('avg(n)')} AS mean_count FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id "
                   "ORDER BY n DESC, user_id LIMIT 100)")


def genre_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each listed genre occurs."""
    part = tables(spark, folder, "part").withColumn("spotify_genres", genre_text())
    return report(profile.value_counts(profile.list_items(part, "spotify_genres"), "genre"))


QUERIES["genre_counts"] = genre_counts
SQL["genre_counts"] = f"WITH {ITEMS_CTE} SELECT genre, count(*) AS count FROM b GROUP BY genre"


def bucket_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each bucket occurs."""
    part = tables(spark, folder, "part").withColumn("spotify_genres", genre_text())
    return report(profile.bucket_counts(part, "spotify_genres"))


QUERIES["bucket_counts"] = bucket_counts
SQL["bucket_counts"] = f"WITH {ITEMS_CTE} SELECT bucket, count(*) AS count FROM b GROUP BY bucket"


def bucket_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct genres with their bucket."""
    part = tables(spark, folder, "part").withColumn("spotify_genres", genre_text())
    return report(profile.bucket_mapping(part, "spotify_genres"))


QUERIES["bucket_mapping"] = bucket_mapping
SQL["bucket_mapping"] = f"WITH {ITEMS_CTE} SELECT DISTINCT genre, bucket FROM b"


def weekly_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events per week; events without a readable time are a group of their own."""
    events = week_events(spark, folder).withColumn(
        schemas.WEEK, F.when(F.col("event_type") != "error", F.col(schemas.WEEK)))
    return report(profile.weekly_activity(events))


QUERIES["weekly_activity"] = weekly_activity
SQL["weekly_activity"] = (f"WITH {EVENTS_CTE} SELECT CAST(CASE WHEN event_type <> 'error' THEN week END AS VARCHAR) AS week_saturday_utc, "
                          "count(*) AS scrobbles FROM ev GROUP BY 1")


def mean_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean number of events per week."""
    return report(profile.mean_of(profile.weekly_activity(week_events(spark, folder)), "scrobbles", "mean_scrobbles"))


QUERIES["mean_activity"] = mean_activity
SQL["mean_activity"] = (f"WITH {EVENTS_CTE} SELECT {r('avg(n)')} AS mean_scrobbles FROM (SELECT week, count(*) AS n FROM ev GROUP BY week)")


def label_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of large orders per week."""
    return report(profile.label_rate(order_events(spark, folder)))


QUERIES["label_rate"] = label_rate
SQL["label_rate"] = (f"WITH {ORDERS_CTE} SELECT CAST(week AS VARCHAR) AS week_saturday_utc, {r('avg(label)')} AS favorite_rate FROM oe GROUP BY week")


def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per quality class, unlabelled ones included."""
    documents, labels = tables(spark, folder, "documents", "labels")
    return report(profile.class_balance(documents.select("doc_id").join(labels, "doc_id", "left"), "quality"))


QUERIES["class_balance"] = class_balance
SQL["class_balance"] = (f"WITH {_WIDE} SELECT CAST(quality AS BIGINT) AS quality, count(*) AS count, "
                        f"{r('count(*) / CAST((SELECT count(*) FROM w) AS DOUBLE)')} AS share FROM w GROUP BY quality")


def class_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Positives, negatives, rate and class weight of large orders."""
    return report(profile.class_weight(order_events(spark, folder)))


QUERIES["class_weight"] = class_weight
SQL["class_weight"] = (f"WITH {ORDERS_CTE} SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, "
                       f"{r('avg(label)')} AS pos_rate, {r('count(*) FILTER (WHERE label = 0) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE)')} AS pos_weight FROM oe")


def mean_label_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the weeks of the share of labelled segments."""
    return report(profile.mean_of(profile.label_rate(order_weekly(spark, folder)), "favorite_rate", "mean_favorite_rate"))


QUERIES["mean_label_rate"] = mean_label_rate
SQL["mean_label_rate"] = f"""
WITH {TABLE_CTE}, k AS (SELECT avg(is_week_favorite) AS rate FROM w GROUP BY week) SELECT {r('avg(rate)')} AS mean_favorite_rate FROM k"""


def weekday_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of events per weekday for large and for other events."""
    events = tables(spark, folder, "events").withColumn("is_week_favorite", (F.col("value") > 100).cast("int"))
    return report(profile.weekday_share(events, "ts"))


QUERIES["weekday_share"] = weekday_share
SQL["weekday_share"] = f"""
WITH d AS (SELECT unnest(range(7)) AS position), c AS (SELECT dayofweek(ts) AS p, count(*) FILTER (WHERE value > 100) AS f,
  count(*) FILTER (WHERE value <= 100) AS n FROM events GROUP BY 1)
SELECT position, (['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'])[position + 1] AS weekday,
  {r('coalesce(f, 0) / CAST(sum(f) OVER () AS DOUBLE)')} AS share_favorite, {r('coalesce(n, 0) / CAST(sum(n) OVER () AS DOUBLE)')} AS share_rest
FROM d LEFT JOIN c ON position = p"""


def positive_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    """Per week: orders of labelled segments against the mean and maximum of the others, beside the label rate."""
    return report(profile.positive_vs_rest(order_weekly(spark, folder), measure="scrobbles_week", label="is_week_favorite"))


QUERIES["positive_vs_rest"] = positive_vs_rest
SQL["positive_vs_rest"] = f"""
WITH {TABLE_CTE} SELECT CAST(week AS VARCHAR) AS week_saturday_utc, max(scrobbles_week) FILTER (WHERE is_week_favorite = 1) AS fav_plays,
  {r('avg(scrobbles_week) FILTER (WHERE is_week_favorite = 0)')} AS avg_nonfav_plays,
  max(scrobbles_week) FILTER (WHERE is_week_favorite = 0) AS max_nonfav_plays, {r('avg(is_week_favorite)')} AS favorite_rate
FROM w GROUP BY week HAVING count(*) FILTER (WHERE is_week_favorite = 1) > 0 AND count(*) FILTER (WHERE is_week_favorite = 0) > 0"""


def newness_share(spark: SparkSession, folder: str) -> DataFrame:
    """New and returning segments among the labelled weeks."""
    return report(profile.newness_share(_history(spark, folder)))


QUERIES["newness_share"] = newness_share
SQL["newness_share"] = f"""
WITH {TABLE_CTE}, c AS (SELECT CASE WHEN first_seen_week = 1 THEN 'first_seen' ELSE 'seen_before' END AS first_seen_flag,
  count(*) AS favorite_count FROM t WHERE is_week_favorite = 1 GROUP BY 1)
SELECT first_seen_flag, favorite_count, {r('favorite_count / CAST(sum(favorite_count) OVER () AS DOUBLE)')} AS favorite_share FROM c"""

# --- distributions ------------------------------------------------------------------------------


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Price histogram of line items per status; prices past the top are left out."""
    return report(profile.histogram(tables(spark, folder, "lineitem"), "l_extendedprice", 0, 90000, 18, by=["l_linestatus"]))


QUERIES["histogram"] = histogram
SQL["histogram"] = f"""
WITH b AS (SELECT unnest(range(18)) AS bin), s AS (SELECT DISTINCT l_linestatus FROM lineitem),
c AS (SELECT l_linestatus, least(CAST(floor(l_extendedprice / 5000) AS BIGINT), 17) AS bin, count(*) AS n FROM lineitem
  WHERE l_extendedprice BETWEEN 0 AND 90000 GROUP BY 1, 2)
SELECT s.l_linestatus, b.bin, CAST(b.bin * 5000 + 2500 AS DOUBLE) AS center, coalesce(n, 0) AS count,
  {r('coalesce(n, 0) * 100.0 / sum(n) OVER (PARTITION BY s.l_linestatus)')} AS percent
FROM s CROSS JOIN b LEFT JOIN c ON c.l_linestatus = s.l_linestatus AND c.bin = b.bin"""


_LIFTED = ["scrobbles_week", "scrobbles_last_fri_sat", "scrobbles_saturday", "momentum_4w_ratio", "prior_scrobbles_all_time"]


def lift_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Label rate by orders of the week and of its last days, momentum and prior orders, in one pass."""
    table = _history(spark, folder)
    return report(profile.lift_tables(table, {f: schemas.LIFT_BINS[f] for f in _LIFTED}).drop("low", "high"))


def _lift_sql(feature: str) -> str:
    edges = schemas.LIFT_BINS[feature]
    rows = ", ".join(f"({i}, {a}, {'1e300' if b == float('inf') else b})" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    return (f"SELECT CAST(bin AS BIGINT) AS bin, {r('avg(is_week_favorite)')} AS favorite_rate, count(is_week_favorite) AS count, "
            f"'{feature}' AS feature FROM (VALUES {rows}) AS e(bin, low, high) LEFT JOIN t ON {feature} >= low AND {feature} < high GROUP BY bin")


QUERIES["lift_bins"] = lift_bins
SQL["lift_bins"] = f"WITH {TABLE_CTE} " + " UNION ALL ".join(map(_lift_sql, _LIFTED))

# --- correlation and information ----------------------------------------------------------------

_NUMERIC = ["scrobbles_week", "unique_days_week", "last_scrobble_gap_days", "prior_scrobbles_all_time", "prior_weeks_with_scrobbles"]


def pearson(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of weekly numbers with the label."""
    return report(profile.pearson_with_label(_history(spark, folder), _NUMERIC))


QUERIES["pearson"] = pearson
SQL["pearson"] = f"WITH {TABLE_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'corr({c}, is_week_favorite)')} AS correlation FROM t" for c in _NUMERIC)


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k_{c}"


_RANKS = f"{TABLE_CTE}, k AS (SELECT {', '.join(_rank_sql(c) for c in _NUMERIC)} FROM t)"
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr(k_{a}, k_{b})')} AS spearman FROM k"
    for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:])


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of all pairs of weekly numbers."""
    return report(profile.spearman(_history(spark, folder), _NUMERIC))


QUERIES["spearman"] = spearman
SQL["spearman"] = f"WITH {_RANKS} {_PAIRS}"


def high_corr_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of weekly numbers that say nearly the same."""
    return report(profile.high_correlation_pairs(_history(spark, folder), _NUMERIC, 0.8))


QUERIES["high_corr_pairs"] = high_corr_pairs
SQL["high_corr_pairs"] = f"WITH {_RANKS} SELECT * FROM ({_PAIRS}) WHERE abs(spearman) >= 0.8"


def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rank of every distinct order price and customer."""
    return report(ordered.average_ranks(tables(spark, folder, "orders"), ["o_totalprice", "o_custkey"]))


QUERIES["average_ranks"] = average_ranks
SQL["average_ranks"] = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {r(f'CAST({c} AS DOUBLE)')} AS value, count(*) OVER (PARTITION BY {c}) AS n, "
    f"CAST(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS DOUBLE) AS rank FROM orders"
    for c in ("o_totalprice", "o_custkey"))


def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    """Information of each one-hot order priority about the label."""
    events = order_events(spark, folder)
    encoder = encode.fit_one_hot(events, "o_orderpriority", 1, "priority")
    return report(profile.mutual_information(encoder.fit_transform(events), encoder.names))


QUERIES["mutual_information"] = mutual_information
SQL["mutual_information"] = f"""
WITH {ORDERS_CTE}, f AS (SELECT DISTINCT o_orderpriority AS p FROM orders),
j AS (SELECT p, CAST(o_orderpriority = p AS INT) AS x, label AS y, count(*) AS n FROM oe CROSS JOIN f GROUP BY 1, 2, 3),
m AS (SELECT *, CAST(sum(n) OVER (PARTITION BY p) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY p, x) AS DOUBLE) AS nx,
  CAST(sum(n) OVER (PARTITION BY p, y) AS DOUBLE) AS ny FROM j)
SELECT 'priority__' || p AS feature, {r('sum(n / t * ln(n * t / (nx * ny)))')} AS mi,
  CAST(sum(CASE WHEN x = 1 THEN n ELSE 0 END) AS BIGINT) AS support, {r('sum(CASE WHEN x = 1 THEN n ELSE 0 END) / max(t)')} AS prevalence
FROM m GROUP BY p"""
