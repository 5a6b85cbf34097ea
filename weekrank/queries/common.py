"""Shared pieces of the registered queries: inputs, output types and SQL fragments of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import session
from weekrank.operators import joins, weekly


def tables(spark: SparkSession, folder: str, *names: str):
    """The named tables, with the session sized for them."""
    found = [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]
    session.configure(spark, *found)
    return found[0] if len(found) == 1 else found


def report(df: DataFrame) -> DataFrame:
    """Plain output types: whole numbers as bigint, doubles to 6 places, dates and times as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


# --- inputs -------------------------------------------------------------------------------------

EVENT_ENTITY = ("user_id", "event_type")
SEGMENT = ("c_mktsegment", "o_orderpriority")
CUSTOMER = ("c_name", "o_orderpriority")
LABEL_PRICE = 450000


def week_events(spark: SparkSession, folder: str) -> DataFrame:
    return weekly.anchor_week(tables(spark, folder, "events"), "ts")


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer as timed events; large orders carry the label."""
    orders, customer = tables(spark, folder, "orders", "customer")
    wide = joins.lookup(orders.withColumnRenamed("o_custkey", "c_custkey"), customer, ["c_custkey"],
                        spread_by=["o_orderkey"]).dropna(subset=["c_name"])
    labelled = wide.withColumn("is_week_favorite", (F.col("o_totalprice") > LABEL_PRICE).cast("int"))
    return weekly.anchor_week(labelled, "o_orderdate")


def order_weekly(spark: SparkSession, folder: str, entity=SEGMENT, carry=()) -> DataFrame:
    return weekly.weekly_base(order_events(spark, folder), entity=entity, ts="o_orderdate", carry=carry,
                              tie_break=["o_orderkey"])


# --- SQL fragments ------------------------------------------------------------------------------

def r(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def saturday(ts: str) -> str:
    return f"(CAST({ts} AS DATE) + CAST((6 - dayofweek({ts})) % 7 AS INT))"


EVENTS_CTE = f"ev AS (SELECT *, {saturday('ts')} AS week FROM events)"
ORDERS_CTE = (
    f"oe AS (SELECT o.*, c.c_name, c.c_mktsegment, c.c_acctbal, c.c_nationkey, {saturday('o_orderdate')} AS week, "
    f"CASE WHEN o_totalprice > {LABEL_PRICE} THEN 1 ELSE 0 END AS label "
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)")


def weekly_cte(name: str, source: str, entity, ts: str, label: str = "0", extra: str = "") -> str:
    keys = ", ".join(entity)
    return (
        f"{name} AS (SELECT {keys}, week, count(*) AS scrobbles_week, count(DISTINCT CAST({ts} AS DATE)) AS unique_days_week, "
        f"count(*) FILTER (WHERE dayofweek({ts}) IN (5, 6)) AS scrobbles_last_fri_sat, "
        f"count(*) FILTER (WHERE dayofweek({ts}) = 6) AS scrobbles_saturday, "
        f"(epoch_us(CAST(week AS TIMESTAMP) + INTERVAL 86399 SECOND) - epoch_us(max({ts}))) / 86400000000.0 "
        f"AS last_scrobble_gap_days, CAST(coalesce(max({label}), 0) AS BIGINT) AS is_week_favorite{extra} "
        f"FROM {source} GROUP BY {keys}, week)")


WEEKLY_COLUMNS = (
    "CAST(week AS VARCHAR) AS week_saturday_utc, CAST(week AS VARCHAR) || ' 00:00:00' AS week_saturday_dt, "
    "scrobbles_week, unique_days_week, scrobbles_last_fri_sat, scrobbles_saturday, "
    f"{r('last_scrobble_gap_days')} AS last_scrobble_gap_days, is_week_favorite")
