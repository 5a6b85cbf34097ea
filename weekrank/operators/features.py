"""Weekly features: competition inside a week, momentum, history, release recency.

All entity windows share one specification, hence one shuffle and one sort. An entity has at most one
row per week, so the largest window partition is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekrank import schemas
from weekrank.functions import dates, numbers
from weekrank.operators import joins

MEASURE = "scrobbles_week"


def _need(df: DataFrame, *columns: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}: compute them first")


def _history(entity: Sequence[str], week: str):
    return W.partitionBy(*entity).orderBy(week)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def _ranked_levels(df: DataFrame, week: str, measure: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The distinct (week, measure) pairs with their row counts, and the same pairs with their rank."""
    levels = df.groupBy(week, measure).agg(F.count(F.lit(1)).alias("n"))
    rank = F.dense_rank().over(W.partitionBy(week).orderBy(F.desc(measure)))
    return levels, levels.withColumn(name, rank.cast("long"))


def add_week_rank(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK,
                  measure: str = MEASURE, name: str = "within_week_rank_by_scrobbles",
                  source: DataFrame | None = None) -> DataFrame:
    """Dense rank inside the week, highest first.

    Only the distinct (week, measure) pairs are ranked: a week with N events has at most sqrt(2N)
    different counts, so no task sorts a whole week. The ranks are joined back with the hot pairs
    (many entities with one event) spread. `source` names a table with the same rows that is cheaper
    to read for the pairs than `df`.
    """
    levels, ranked = _ranked_levels(df if source is None else source, week, measure, name)
    return joins.spread_join(df, ranked, [week, measure], spread_by=entity, counts=levels, weight="n")


def add_previous(df: DataFrame, window: int, *, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK_TS,
                 measure: str = MEASURE, name: str | None = None, calendar: bool = False) -> DataFrame:
    """Sum over the entity's previous `window` active weeks (or calendar weeks), 0 when there are none."""
    if window < 1:
        raise ValueError("window must be at least 1")
    if calendar:
        number = F.floor(F.datediff(F.col(week), F.lit("1970-01-03").cast("date")) / F.lit(7.0)).cast("long")
        frame = W.partitionBy(*entity).orderBy(number).rangeBetween(-window, -1)
        value = F.sum(measure).over(frame)
    elif window == 1:
        value = F.lag(measure, 1).over(_history(entity, week))
    else:
        value = F.sum(measure).over(_history(entity, week).rowsBetween(-window, -1))
    return df.withColumn(name or f"scrobbles_prev_{window}w", _or_zero(value))


def add_change(df: DataFrame, measure: str = MEASURE) -> DataFrame:
    _need(df, "scrobbles_prev_1w")
    return df.withColumn("week_over_week_change", F.col(measure) - F.col("scrobbles_prev_1w"))


def add_momentum(df: DataFrame, window: int = 4, measure: str = MEASURE, name: str | None = None) -> DataFrame:
    previous = f"scrobbles_prev_{window}w"
    _need(df, previous)
    ratio = F.col(measure) / (F.lit(1.0) + F.col(previous).cast("double"))
    return df.withColumn(name or f"momentum_{window}w_ratio", ratio)


def add_prior_total(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK_TS,
                    measure: str = MEASURE) -> DataFrame:
    before = _history(entity, week).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("prior_scrobbles_all_time", _or_zero(F.sum(measure).over(before)))


def add_prior_weeks(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK_TS,
                    measure: str = MEASURE) -> DataFrame:
    before = _history(entity, week).rowsBetween(W.unboundedPreceding, -1)
    active = (F.col(measure) > 0).cast("int")
    return df.withColumn("prior_weeks_with_scrobbles", _or_zero(F.sum(active).over(before)))


def add_first_seen(df: DataFrame) -> DataFrame:
    _need(df, "prior_scrobbles_all_time")
    return df.withColumn("first_seen_week", (F.col("prior_scrobbles_all_time") == 0).cast("int"))


def add_weeks_since_first(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY,
                          week: str = schemas.WEEK_TS) -> DataFrame:
    # Same specification as the other history windows; the running minimum is the first week.
    first = F.min(week).over(_history(entity, week).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("weeks_since_first_scrobble", dates.whole_weeks_between(F.col(week), first))


def add_days_since_release(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK_TS,
                           release: str = "spotify_release_date", lookup: DataFrame | None = None) -> DataFrame:
    """Days from the entity's earliest release to the week (negative before it, null when unknown).

    Without a separate lookup the release date is on the weekly rows themselves: a window on the
    entity, sharing the history shuffle, replaces the join.
    """
    if lookup is None and release in df.columns:
        first = F.min("_release").over(W.partitionBy(*entity))
        staged = df.withColumn("_release", dates.release_timestamp(F.col(release))).withColumn("_release", first)
    elif lookup is None:
        return df.withColumn("days_since_release", F.lit(None).cast("double"))
    else:
        side = lookup.select(*entity, F.col("release_dt").alias("_release"))
        # No spreading: an entity has at most one weekly row per week, so no key is hot.
        staged = df.join(side, list(entity), "left")
    return staged.withColumn("days_since_release", dates.days_between(F.col(week), F.col("_release"))).drop("_release")


def add_released_within(df: DataFrame, days: int = 28) -> DataFrame:
    _need(df, "days_since_release")
    return df.withColumn(f"released_within_{days}d", numbers.flag(F.col("days_since_release").between(0, days)))


# --- families -----------------------------------------------------------------------------------

def add_momentum_family(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY,
                        week: str = schemas.WEEK_TS) -> DataFrame:
    both = add_previous(add_previous(df, 1, entity=entity, week=week), 4, entity=entity, week=week)
    return both.transform(add_change).transform(add_momentum, 4)


def add_history_family(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY,
                       week: str = schemas.WEEK_TS) -> DataFrame:
    total = add_prior_total(df, entity=entity, week=week)
    return (add_prior_weeks(total, entity=entity, week=week).transform(add_first_seen)
            .transform(add_weeks_since_first, entity=entity, week=week))


def add_release_family(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK_TS,
                       lookup: DataFrame | None = None) -> DataFrame:
    return add_days_since_release(df, entity=entity, week=week, lookup=lookup).transform(add_released_within, 28)


def core_features(weekly: DataFrame, *, entity: Sequence[str] = schemas.ENTITY,
                  week_key: str = schemas.WEEK) -> DataFrame:
    """All weekly features on a weekly base table.

    The base is read twice (history windows, rank levels); pass a stored table or
    `session.cut(weekly)` so that the events are not aggregated twice.
    """
    out = add_momentum_family(weekly, entity=entity)
    out = add_history_family(out, entity=entity)
    out = add_release_family(out, entity=entity)
    out = add_week_rank(out, entity=entity, week=week_key, source=weekly)
    return out.select(*weekly.columns, "within_week_rank_by_scrobbles",
                      *[c for c in out.columns if c not in weekly.columns and c != "within_week_rank_by_scrobbles"])

