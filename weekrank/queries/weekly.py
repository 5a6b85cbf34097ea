"""Weekly tables, weekly features and the modelling view on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank import schemas, session
from weekrank.functions import dates
from weekrank.operators import columns, features, joins, ordered, weekly
from weekrank.plans import weekly_table as plans
from weekrank.queries.common import (
    CUSTOMER, EVENT_ENTITY, EVENTS_CTE, ORDERS_CTE, SEGMENT, WEEKLY_COLUMNS, order_events, order_weekly, r, report,
    saturday, tables, week_events, weekly_cte,
)

QUERIES: dict = {}
SQL: dict = {}


def _keys(entity) -> str:
    return ", ".join(entity)


def weekly_base(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, active days, end-of-week counts and last-event gap per user, event type and week."""
    return report(weekly.weekly_base(week_events(spark, folder), entity=EVENT_ENTITY, ts="ts", carry=[]))


QUERIES["weekly_base"] = weekly_base
SQL["weekly_base"] = (
    f"WITH {EVENTS_CTE}, {weekly_cte('w', 'ev', EVENT_ENTITY, 'ts')} SELECT user_id, event_type, {WEEKLY_COLUMNS} FROM w")


def weekly_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Dense rank of every user and event type inside its week."""
    base = session.cut(weekly.weekly_base(week_events(spark, folder), entity=EVENT_ENTITY, ts="ts", carry=[]))
    ranked = features.add_week_rank(base, entity=EVENT_ENTITY)
    return report(ranked.select(*EVENT_ENTITY, schemas.WEEK, "scrobbles_week", "within_week_rank_by_scrobbles"))


QUERIES["weekly_rank"] = weekly_rank
SQL["weekly_rank"] = (
    f"WITH {EVENTS_CTE}, {weekly_cte('w', 'ev', EVENT_ENTITY, 'ts')} SELECT user_id, event_type, "
    "CAST(week AS VARCHAR) AS week_saturday_utc, scrobbles_week, "
    "dense_rank() OVER (PARTITION BY week ORDER BY scrobbles_week DESC) AS within_week_rank_by_scrobbles FROM w")


def weekly_label_carry(spark: SparkSession, folder: str) -> DataFrame:
    """Label (missing for small values) and the attributes of the last event per group."""
    events = week_events(spark, folder).withColumn(
        "label", F.when(F.col("value") >= 5, (F.col("value") > 150).cast("int")))
    base = weekly.weekly_base(events, entity=EVENT_ENTITY, ts="ts", label="label", carry=["value", "props"],
                              tie_break=["event_id"])
    return report(base.select(*EVENT_ENTITY, schemas.WEEK, "label", "value", "props"))


QUERIES["weekly_label_carry"] = weekly_label_carry
SQL["weekly_label_carry"] = f"""
WITH {EVENTS_CTE}, last AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, week ORDER BY ts DESC, event_id DESC) AS rn FROM ev),
lab AS (
  SELECT user_id, event_type, week,
    CAST(coalesce(max(CASE WHEN value >= 5 THEN CASE WHEN value > 150 THEN 1 ELSE 0 END END), 0) AS BIGINT) AS label
  FROM ev GROUP BY user_id, event_type, week)
SELECT last.user_id, last.event_type, CAST(last.week AS VARCHAR) AS week_saturday_utc, label, {r('value')} AS value, props
FROM last JOIN lab ON last.user_id = lab.user_id AND last.event_type = lab.event_type AND last.week = lab.week
WHERE rn = 1"""


def weekly_given_week(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly base with a week that does not come from the event time: the week of the order's shipping."""
    lineitem, part = tables(spark, folder, "lineitem", "part")
    events = joins.lookup(lineitem.withColumnRenamed("l_partkey", "p_partkey"), part.select("p_partkey", "p_brand"),
                          ["p_partkey"], spread_by=["l_orderkey", "l_linenumber"])
    shifted = events.withColumn(schemas.WEEK, F.date_add(dates.week_ending_saturday(F.col("l_shipdate")),
                                                         F.when(F.col("l_returnflag") == "R", 7).otherwise(0)))
    base = weekly.weekly_base(shifted, entity=("p_brand", "l_linestatus"), ts="l_shipdate", carry=[],
                              week_from_ts=False)
    return report(base)


QUERIES["weekly_given_week"] = weekly_given_week
SQL["weekly_given_week"] = (
    f"WITH li AS (SELECT l.*, p.p_brand, CAST({saturday('l_shipdate')} + CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END "
    "AS DATE) AS week FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey), "
    f"{weekly_cte('w', 'li', ('p_brand', 'l_linestatus'), 'l_shipdate')} "
    f"SELECT p_brand, l_linestatus, {WEEKLY_COLUMNS} FROM w")


def _history_sql(entity, select: str, cte: str = "") -> str:
    return (f"WITH {ORDERS_CTE}, {weekly_cte('w', 'oe', entity, 'o_orderdate', 'label')}{cte} "
            f"SELECT {_keys(entity)}, CAST(week AS VARCHAR) AS week_saturday_utc, scrobbles_week, {select} FROM w "
            f"WINDOW e AS (PARTITION BY {_keys(entity)} ORDER BY week), "
            f"b AS (PARTITION BY {_keys(entity)} ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def weekly_prev(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the previous and the previous four active weeks per customer and priority."""
    base = order_weekly(spark, folder, CUSTOMER)
    out = features.add_previous(features.add_previous(base, 1, entity=CUSTOMER), 4, entity=CUSTOMER)
    return report(out.select(*CUSTOMER, schemas.WEEK, "scrobbles_week", "scrobbles_prev_1w", "scrobbles_prev_4w"))


_PREV1 = "CAST(coalesce(lag(scrobbles_week) OVER e, 0) AS BIGINT)"
_PREV4 = ("CAST(coalesce(sum(scrobbles_week) OVER (PARTITION BY {k} ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0)"
          " AS BIGINT)")
QUERIES["weekly_prev"] = weekly_prev
SQL["weekly_prev"] = _history_sql(
    CUSTOMER, f"{_PREV1} AS scrobbles_prev_1w, {_PREV4.format(k=_keys(CUSTOMER))} AS scrobbles_prev_4w")


def weekly_prev_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the previous four calendar weeks."""
    out = features.add_previous(order_weekly(spark, folder, CUSTOMER), 4, entity=CUSTOMER, calendar=True)
    return report(out.select(*CUSTOMER, schemas.WEEK, "scrobbles_week", "scrobbles_prev_4w"))


QUERIES["weekly_prev_calendar"] = weekly_prev_calendar
SQL["weekly_prev_calendar"] = _history_sql(CUSTOMER, (
    f"CAST(coalesce(sum(scrobbles_week) OVER (PARTITION BY {_keys(CUSTOMER)} ORDER BY week "
    "RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING), 0) AS BIGINT) AS scrobbles_prev_4w"))


def weekly_momentum(spark: SparkSession, folder: str) -> DataFrame:
    """Week-over-week change and four-week momentum per segment and priority."""
    out = features.add_momentum_family(order_weekly(spark, folder), entity=SEGMENT)
    return report(out.select(*SEGMENT, schemas.WEEK, "scrobbles_week", "scrobbles_prev_1w", "scrobbles_prev_4w",
                             "week_over_week_change", "momentum_4w_ratio"))


_P4 = _PREV4.format(k=_keys(SEGMENT))
_MOMENTUM = (
    f"{_PREV1} AS scrobbles_prev_1w, {_P4} AS scrobbles_prev_4w, scrobbles_week - {_PREV1} AS week_over_week_change, "
    f"{r(f'scrobbles_week / (1.0 + CAST({_P4} AS DOUBLE))')} AS momentum_4w_ratio")
QUERIES["weekly_momentum"] = weekly_momentum
SQL["weekly_momentum"] = _history_sql(SEGMENT, _MOMENTUM)


def weekly_history(spark: SparkSession, folder: str) -> DataFrame:
    """Prior orders, prior active weeks and weeks since the first order per customer and priority."""
    base = order_weekly(spark, folder, CUSTOMER)
    out = features.add_prior_weeks(features.add_prior_total(base, entity=CUSTOMER), entity=CUSTOMER)
    out = features.add_weeks_since_first(out, entity=CUSTOMER)
    return report(out.select(*CUSTOMER, schemas.WEEK, "scrobbles_week", "prior_scrobbles_all_time",
                             "prior_weeks_with_scrobbles", "weeks_since_first_scrobble"))


def _history(k: str) -> str:
    return ("CAST(coalesce(sum(scrobbles_week) OVER b, 0) AS BIGINT) AS prior_scrobbles_all_time, "
            "CAST(coalesce(sum(CASE WHEN scrobbles_week > 0 THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS prior_weeks_with_scrobbles, "
            f"CAST((week - min(week) OVER (PARTITION BY {k})) // 7 AS BIGINT) AS weeks_since_first_scrobble")


QUERIES["weekly_history"] = weekly_history
SQL["weekly_history"] = _history_sql(CUSTOMER, _history(_keys(CUSTOMER)))


def weekly_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """1 in the first week a customer orders with a priority."""
    out = features.add_first_seen(features.add_prior_total(order_weekly(spark, folder, CUSTOMER), entity=CUSTOMER))
    return report(out.select(*CUSTOMER, schemas.WEEK, "scrobbles_week", "first_seen_week"))


QUERIES["weekly_first_seen"] = weekly_first_seen
SQL["weekly_first_seen"] = _history_sql(
    CUSTOMER, "CAST(coalesce(sum(scrobbles_week) OVER b, 0) = 0 AS BIGINT) AS first_seen_week")

# --- release dates: each order's date printed in a shape that depends on its priority -----------


def _release_text(c: str) -> F.Column:
    first, at = F.substring("o_orderpriority", 1, 1), F.col(c)
    return (F.when(first == "1", F.date_format(at, "yyyy")).when(first == "2", F.date_format(at, "yyyy-MM"))
            .when(first == "3", F.date_format(at, "yyyy-MM-dd")).when(first == "4", F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
            .otherwise("unknown"))


_RELEASE_SQL = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%Y') WHEN '2' THEN strftime(o_orderdate, '%Y-%m') "
    "WHEN '3' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '4' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') "
    "ELSE 'unknown' END")
_RELEASE_TS_SQL = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN date_trunc('year', o_orderdate) WHEN '2' THEN date_trunc('month', o_orderdate) "
    "WHEN '3' THEN date_trunc('day', o_orderdate) WHEN '4' THEN o_orderdate END")


def _order_releases(spark: SparkSession, folder: str) -> DataFrame:
    return order_events(spark, folder).withColumn("spotify_release_date", _release_text("o_orderdate"))


def release_recency(spark: SparkSession, folder: str) -> DataFrame:
    """Days since the earliest release per customer and priority, and the 28-day flag."""
    events = _order_releases(spark, folder)
    base = weekly.weekly_base(events, entity=CUSTOMER, ts="o_orderdate", carry=[])
    lookup = weekly.release_lookup(events, entity=CUSTOMER)
    out = features.add_release_family(base, entity=CUSTOMER, lookup=lookup)
    return report(out.select(*CUSTOMER, schemas.WEEK, "days_since_release", "released_within_28d"))


def _days_sql(week: str, release: str) -> str:
    return f"(epoch_us(CAST({week} AS TIMESTAMP)) - epoch_us(CAST({release} AS TIMESTAMP))) / 86400000000.0"


QUERIES["release_recency"] = release_recency
SQL["release_recency"] = f"""
WITH {ORDERS_CTE}, {weekly_cte('w', 'oe', CUSTOMER, 'o_orderdate')},
rel AS (SELECT {_keys(CUSTOMER)}, min({_RELEASE_TS_SQL}) AS rel FROM oe GROUP BY {_keys(CUSTOMER)}),
d AS (SELECT w.c_name, w.o_orderpriority, w.week, {_days_sql('w.week', 'rel')} AS d
  FROM w LEFT JOIN rel ON w.c_name = rel.c_name AND w.o_orderpriority = rel.o_orderpriority)
SELECT c_name, o_orderpriority, CAST(week AS VARCHAR) AS week_saturday_utc, {r('d')} AS days_since_release,
  CAST(coalesce(d >= 0 AND d <= 28, false) AS BIGINT) AS released_within_28d FROM d"""


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly feature table of segments; catalogue attributes come from the latest order of a week."""
    events = _order_releases(spark, folder).withColumns({
        "spotify_popularity": F.col("c_acctbal"), "artist_listeners": F.col("o_totalprice")})
    return plans.weekly_table(events, entity=SEGMENT, ts="o_orderdate", tie_break=["o_orderkey"],
                              carry=["spotify_release_date", "spotify_popularity", "artist_listeners"])


TABLE_CTE = f"""{ORDERS_CTE}, {weekly_cte('w', 'oe', SEGMENT, 'o_orderdate', 'label')},
lst AS (SELECT *, {_RELEASE_SQL} AS rel_text, {_RELEASE_TS_SQL} AS rel_ts,
  row_number() OVER (PARTITION BY {_keys(SEGMENT)}, week ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM oe),
j AS (SELECT w.*, rel_text AS spotify_release_date, c_acctbal AS spotify_popularity, o_totalprice AS artist_listeners,
    min(rel_ts) OVER (PARTITION BY w.c_mktsegment, w.o_orderpriority) AS rel
  FROM w JOIN lst ON w.c_mktsegment = lst.c_mktsegment AND w.o_orderpriority = lst.o_orderpriority AND w.week = lst.week AND rn = 1),
f AS (SELECT *, dense_rank() OVER (PARTITION BY week ORDER BY scrobbles_week DESC) AS within_week_rank_by_scrobbles,
    {_MOMENTUM}, {_history(_keys(SEGMENT))}, {_days_sql('week', 'rel')} AS days
  FROM j WINDOW e AS (PARTITION BY {_keys(SEGMENT)} ORDER BY week),
    b AS (PARTITION BY {_keys(SEGMENT)} ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CAST(prior_scrobbles_all_time = 0 AS BIGINT) AS first_seen_week,
    CAST(coalesce(days >= 0 AND days <= 28, false) AS BIGINT) AS released_within_28d FROM f)"""
_FEATURES_SQL = (
    "within_week_rank_by_scrobbles, scrobbles_prev_1w, scrobbles_prev_4w, week_over_week_change, momentum_4w_ratio, "
    "prior_scrobbles_all_time, first_seen_week, released_within_28d, ")


def core_features(spark: SparkSession, folder: str) -> DataFrame:
    """The complete weekly feature table."""
    return report(feature_table(spark, folder))


QUERIES["core_features"] = core_features
SQL["core_features"] = (
    f"WITH {TABLE_CTE} SELECT {_keys(SEGMENT)}, {WEEKLY_COLUMNS}, spotify_release_date, "
    f"{r('spotify_popularity')} AS spotify_popularity, {r('artist_listeners')} AS artist_listeners, {_FEATURES_SQL} "
    f"prior_weeks_with_scrobbles, weeks_since_first_scrobble, {r('days')} AS days_since_release FROM t")

_VIEW_START = "1996-01-06"


def model_view(spark: SparkSession, folder: str) -> DataFrame:
    """The modelling view: label period, filled release age, leaky and redundant columns gone."""
    return report(plans.model_view(session.cut(feature_table(spark, folder)), _VIEW_START))


_VIEW_CTE = (
    f"{TABLE_CTE}, p AS (SELECT * FROM t WHERE week >= DATE '{_VIEW_START}'), "
    "v AS (SELECT *, CAST(days IS NULL AS BIGINT) AS days_since_release_was_missing, "
    "coalesce(days, (SELECT median(days) FROM p)) AS days_since_release FROM p)")
QUERIES["model_view"] = model_view
SQL["model_view"] = (
    f"WITH {_VIEW_CTE} SELECT {_keys(SEGMENT)}, {WEEKLY_COLUMNS}, spotify_release_date, "
    f"{r('spotify_popularity')} AS spotify_popularity, {_FEATURES_SQL} {r('days_since_release')} AS days_since_release, "
    "days_since_release_was_missing FROM v")


def select_xy(spark: SparkSession, folder: str) -> DataFrame:
    """Model inputs in their fixed order (absent ones 0) and the label."""
    view = plans.model_view(session.cut(feature_table(spark, folder)), _VIEW_START)
    keyed = columns.with_defaults(view, schemas.CORE_FEATURES)
    x, _ = columns.split_features_label(keyed)
    return report(columns.drop_identifiers(keyed).select(*x.columns, schemas.LABEL))


QUERIES["select_xy"] = select_xy
_as_double = "".join(f"{r(f'CAST({c} AS DOUBLE)')} AS {c}, " for c in schemas.CORE_FEATURES if c != "track_duration")
SQL["select_xy"] = (
    f"WITH {_VIEW_CTE} SELECT {_as_double} CAST(0 AS DOUBLE) AS track_duration, released_within_28d, is_week_favorite FROM v")

# --- weeks, flags, hygiene ----------------------------------------------------------------------


def nearest_week(spark: SparkSession, folder: str) -> DataFrame:
    """Both week anchors of every event: the Saturday on or after, and the nearest one."""
    events = tables(spark, folder, "events")
    return report(events.select("event_id", dates.nearest_saturday(F.col("ts")).alias("nearest"),
                                dates.week_ending_saturday(F.col("ts")).alias("week_saturday_utc"),
                                dates.weekday_name(F.col("ts")).alias("weekday")))


QUERIES["nearest_week"] = nearest_week
SQL["nearest_week"] = f"""
SELECT event_id, CAST(CASE WHEN k <= 3 THEN d - CAST(k AS INT) ELSE d + CAST(7 - k AS INT) END AS VARCHAR) AS nearest,
  CAST({saturday('ts')} AS VARCHAR) AS week_saturday_utc, dayname(ts) AS weekday
FROM (SELECT *, CAST(ts AS DATE) AS d, (dayofweek(ts) + 1) % 7 AS k FROM events)"""


def date_missing_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Missing flags of two date columns, one of them unknown for open orders."""
    orders = tables(spark, folder, "orders").withColumn(
        "closed_at", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    flagged = columns.missing_flags(orders, ["o_orderdate", "closed_at"])
    return report(flagged.select("o_orderkey", "closed_at", "o_orderdate_was_missing", "closed_at_was_missing"))


QUERIES["date_missing_flags"] = date_missing_flags
SQL["date_missing_flags"] = """
SELECT o_orderkey, strftime(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END, '%Y-%m-%d %H:%M:%S') AS closed_at,
  CAST(o_orderdate IS NULL AS BIGINT) AS o_orderdate_was_missing,
  CAST((CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END) IS NULL AS BIGINT) AS closed_at_was_missing FROM orders"""


def dedupe_drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct user, event type and day of the larger events; rows without a value drop out first."""
    events = tables(spark, folder, "events").withColumn("large", F.when(F.col("value") > 100, F.col("value")))
    kept = columns.drop_missing(events, ["large"])
    return report(kept.select("user_id", "event_type", F.to_date("ts").alias("day")).distinct())


QUERIES["dedupe_drop_nulls"] = dedupe_drop_nulls
SQL["dedupe_drop_nulls"] = (
    "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE value > 100")


def export_order(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly base in export order: the place of every row."""
    base = weekly.in_week_order(order_weekly(spark, folder), entity=SEGMENT).withColumn("_at", F.monotonically_increasing_id())
    return report(ordered.running_number(session.cut(base), ["_at"], "place").select("place", *SEGMENT, schemas.WEEK))


QUERIES["export_order"] = export_order
SQL["export_order"] = (
    f"WITH {ORDERS_CTE}, {weekly_cte('w', 'oe', SEGMENT, 'o_orderdate', 'label')} SELECT row_number() OVER (ORDER BY week, {_keys(SEGMENT)}) AS place, "
    f"{_keys(SEGMENT)}, CAST(week AS VARCHAR) AS week_saturday_utc FROM w")


def shared_features(spark: SparkSession, folder: str) -> DataFrame:
    """The features that a table and a poorer one share, with their sums over both."""
    table = session.cut(feature_table(spark, folder))
    poorer = table.drop("momentum_4w_ratio", "days_since_release", "released_within_28d").withColumn("genre__x", F.lit(1))
    names = columns.common_features(table, poorer)
    both = columns.with_defaults(table, names).select(names).unionAll(columns.with_defaults(poorer, names).select(names))
    return report(both.agg(*[F.sum(c).alias(c) for c in names]).unpivot([], names, "feature", "total").withColumn("total", F.round("total", 2)))


QUERIES["shared_features"] = shared_features
_SHARED = [c for c in schemas.CORE_FEATURES if c not in ("track_duration", "momentum_4w_ratio", "days_since_release")]
SQL["shared_features"] = f"WITH {TABLE_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(2 * sum(coalesce(CAST({c} AS DOUBLE), 0)), 2) AS total FROM t" for c in _SHARED)
