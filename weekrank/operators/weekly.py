"""From single events to one row per entity and Saturday-ended week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank import schemas
from weekrank.functions import dates
from weekrank.operators.columns import present

FRIDAY, SATURDAY = 4, 5


def anchor_week(df: DataFrame, ts: str = "date", week: str = schemas.WEEK) -> DataFrame:
    return df.withColumn(week, dates.week_ending_saturday(dates.to_utc(F.col(ts)))) if ts in df.columns else df


def weekly_base(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY, ts: str = "date", week: str = schemas.WEEK,
                label: str = schemas.LABEL, carry: Sequence[str] = schemas.CARRIED_COLUMNS,
                tie_break: Sequence[str] = ("scrobble_number",), week_from_ts: bool = True) -> DataFrame:
    """Counts, active days, end-of-week counts, last-event gap, label and carried attributes per entity-week.

    One `groupBy`: everything is combined map-side, so a hot entity or week costs one row per task.
    When the week was derived from `ts` (`week_from_ts`), the days of a group are days of one week
    and are counted as bits of a mask; otherwise by an exact distinct count. Rows with a missing key
    drop out. Carried attributes come as a whole from the group's last event; an event without a time
    sorts last, ties go to the highest `tie_break`.
    """
    keys = [*entity, week]
    at = dates.to_utc(F.col(ts))
    carried = present(df, carry)
    day = F.weekday(at)
    days = (F.coalesce(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), day))), F.lit(0)) if week_from_ts
            else F.count_distinct(F.to_date(at)))
    aggregates = [
        F.count(F.lit(1)).alias("scrobbles_week"),
        days.cast("long").alias("unique_days_week"),
        F.count_if(day.isin(FRIDAY, SATURDAY)).alias("scrobbles_last_fri_sat"),
        F.count_if(day == SATURDAY).alias("scrobbles_saturday"),
        F.max(at).alias("_last"),
        (F.coalesce(F.max(label), F.lit(0)) if label in df.columns else F.lit(0)).cast("int").alias(label),
    ]
    if carried:
        order = F.struct(at.isNull(), at, *present(df, tie_break))
        aggregates.append(F.max_by(F.struct(*carried), order).alias("_carried"))
    grouped = df.dropna(subset=keys).groupBy(*keys).agg(*aggregates)
    return grouped.select(
        *keys, dates.to_utc(F.col(week)).alias(schemas.WEEK_TS),
        "scrobbles_week", "unique_days_week", "scrobbles_last_fri_sat", "scrobbles_saturday",
        dates.days_between(dates.week_end(F.col(week)), F.col("_last")).alias("last_scrobble_gap_days"),
        label, *[F.col("_carried")[c].alias(c) for c in carried],
    )


def in_week_order(weekly: DataFrame, entity: Sequence[str] = schemas.ENTITY, week: str = schemas.WEEK_TS) -> DataFrame:
    """Export order; a range sort, for sinks only."""
    return weekly.orderBy(week, *entity)


def release_lookup(df: DataFrame, *, entity: Sequence[str] = schemas.ENTITY,
                   release: str = "spotify_release_date") -> DataFrame:
    """Earliest readable release time per entity."""
    parsed = df.dropna(subset=list(entity)).select(*entity, dates.release_timestamp(F.col(release)).alias("_at"))
    # Filtered after the aggregate: a filter before it would read each date twice.
    return parsed.groupBy(*entity).agg(F.min("_at").alias("release_dt")).dropna(subset=["release_dt"])
