"""Projections, column hygiene and row filters (schema-level work; no shuffle)."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas
from weekrank.functions import dates, numbers, text


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in columns if c in have]


# --- projections --------------------------------------------------------------------------------

def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_leaky(df: DataFrame) -> DataFrame:
    """Without the global counters that know more than the week."""
    return df.drop(*schemas.LEAKY_COLUMNS)


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*schemas.IDENTIFIER_COLUMNS)


def drop_redundant(df: DataFrame) -> DataFrame:
    return df.drop(*schemas.REDUNDANT_COLUMNS)


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def feature_columns(df: DataFrame, core: Sequence[str] = schemas.CORE_FEATURES) -> list[str]:
    """Allow-list of model inputs that exist in `df`, in a fixed order."""
    return present(df, core) + columns_like(df, "released_within_", "d") + columns_like(df, "genre__")


def common_features(*frames: DataFrame) -> list[str]:
    """Feature names every split has, sorted."""
    return sorted(set.intersection(*(set(feature_columns(df)) for df in frames)))


def split_features_label(df: DataFrame, label: str = schemas.LABEL) -> tuple[DataFrame, DataFrame]:
    return df.select(*feature_columns(df)), df.select(label)


def order_columns(df: DataFrame, *sources: Sequence[str], tail: Sequence[str] = ()) -> DataFrame:
    """Columns source by source, each once; join leftovers (`_x`, `_y`) go, the rest comes last."""
    kept = [c for c in df.columns if not c.endswith(("_x", "_y"))]
    wanted = [c for source in (*sources, tail) for c in source if c in kept]
    return df.select(*dict.fromkeys([*wanted, *kept]))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the given columns and types: missing ones null, others dropped, bad cells null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def coalesce_sides(df: DataFrame, column: str) -> DataFrame:
    """Merge `column_x` and `column_y` into `column`, the left one first."""
    sides = present(df, [f"{column}_x", f"{column}_y"])
    return df.withColumn(column, F.coalesce(*[F.col(c) for c in sides])).drop(*sides) if sides else df


def with_label(df: DataFrame, label: str = schemas.LABEL, value: int = 0) -> DataFrame:
    """Constant label where the column is absent."""
    return df if label in df.columns else df.withColumn(label, F.lit(value).cast("int"))


def with_defaults(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Every listed column as a double without gaps; absent ones are added."""
    have = set(df.columns)
    filled = {
        c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(default)) if c in have else F.lit(default)
        for c in columns
    }
    return df.withColumns(filled)


def with_category(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(default))


def apply_fixes(df: DataFrame, fixes=schemas.TITLE_FIXES) -> DataFrame:
    """Exact-match corrections: (columns to match, columns to set), later rules see earlier results."""
    for match, change in fixes:
        hit = F.lit(True)
        for column, value in match.items():
            hit = hit & F.col(column).eqNullSafe(value)
        df = df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in change.items()})
    return df


def fill_by_type(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Missing text becomes "", missing whole numbers become 0."""
    fills: dict = {c: "" for c in present(df, types) if types[c] == "str"}
    fills |= {c: 0 for c in present(df, types) if types[c] in ("int", "int32", "int64")}
    return df.fillna(fills) if fills else df


# --- cleaning steps -----------------------------------------------------------------------------

def trim_columns(df: DataFrame, columns: Sequence[str] = schemas.TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: text.trim_all(F.col(c).cast("string")) for c in present(df, columns)})


def standardise_release(df: DataFrame, column: str = "spotify_release_date",
                        granularity: str = "release_date_granularity") -> DataFrame:
    if column not in df.columns:
        return df
    raw = F.col(column).cast("string")
    return df.withColumns({column: dates.release_day(raw), granularity: dates.release_granularity(raw)})


def missing_flags(df: DataFrame, columns: Sequence[str] = schemas.DATE_COLUMNS) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in present(df, columns)})


def genre_bucket(df: DataFrame, column: str = "spotify_genres", rules=None, bucket: str = "genre_bucket",
                 missing: str = "genre_missing") -> DataFrame:
    """Most frequent bucket over a row's comma list (smallest on ties) and an empty-list flag."""
    if column not in df.columns:
        return df
    # Staged, so that the array is built once although the mode reads it several times.
    staged = df.withColumn("_parts", text.split_list(F.col(column))).withColumn(
        "_buckets", F.transform("_parts", lambda part: text.bucket_of(part, rules)))
    return staged.withColumns({
        bucket: F.coalesce(text.array_mode(F.col("_buckets")), F.lit("unknown")),
        missing: (F.size("_parts") == 0).cast("int"),
    }).drop("_parts", "_buckets")


def to_numbers(df: DataFrame, columns: Sequence[str] = schemas.NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: numbers.to_number(F.col(c)) for c in present(df, columns)})


def round_counts(df: DataFrame, columns: Sequence[str] = schemas.COUNT_COLUMNS) -> DataFrame:
    return df.withColumns({c: numbers.round_half_even(numbers.to_number(F.col(c))) for c in present(df, columns)})


# --- row filters --------------------------------------------------------------------------------

def with_week_timestamp(df: DataFrame, typed: str = schemas.WEEK_TS, named: str = schemas.WEEK) -> DataFrame:
    """Typed week column, filled from the named week where it cannot be read."""
    sources = [dates.to_utc(F.col(c)) for c in present(df, [typed, named])]
    if not sources:
        raise KeyError(f"expected column {typed!r} or {named!r}")
    return df.withColumn(typed, F.coalesce(*sources))


def label_start(value: str | None = schemas.LABEL_START) -> str:
    """The configured first label week, or the default when it is no date."""
    try:
        return datetime.date.fromisoformat(str(value)[:10]).isoformat()
    except ValueError:
        return schemas.LABEL_START


def label_period(df: DataFrame, start: str | None = schemas.LABEL_START, week: str = schemas.WEEK_TS) -> DataFrame:
    return df.filter(F.col(week) >= F.lit(label_start(start)).cast("timestamp"))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def between_times(df: DataFrame, ts: Column, after=None, until=None) -> DataFrame:
    """Rows in the half-open span (after, until]; an absent bound does not filter."""
    if after is not None:
        df = df.filter(ts > F.lit(after).cast("timestamp"))
    if until is not None:
        df = df.filter(ts <= F.lit(until).cast("timestamp"))
    return df
