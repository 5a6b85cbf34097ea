"""The cleaning steps in their fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank import schemas
from weekrank.operators import columns, impute, joins


def _genre_bucket(df: DataFrame, column: str = "spotify_genres") -> DataFrame:
    """Bucket and missing flag, found once per distinct genre list."""
    if column not in df.columns:
        return df
    found = joins.by_distinct(df, [column], columns.genre_bucket)
    return found.withColumns({"genre_bucket": F.coalesce("genre_bucket", F.lit("unknown")),
                              "genre_missing": F.coalesce("genre_missing", F.lit(1))})


def clean_events(df: DataFrame) -> DataFrame:
    """Trim, standardise the release date, flag missing dates, bucket genres, cast, fill, round, drop.

    The release date is standardised before the flags, so that an unreadable one counts as missing.
    The medians need one pass of their own over the numeric columns.
    """
    typed = (df.transform(columns.trim_columns, schemas.TEXT_COLUMNS)
             .transform(columns.standardise_release)
             .transform(columns.missing_flags, schemas.DATE_COLUMNS)
             .transform(_genre_bucket)
             .transform(columns.to_numbers, schemas.NUMERIC_COLUMNS))
    return (typed.transform(impute.fill_medians, schemas.MEDIAN_COLUMNS)
            .transform(columns.round_counts, schemas.COUNT_COLUMNS)
            .transform(columns.drop_columns, schemas.UNUSED_COLUMNS))
