"""Median imputation with missing flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank import schemas
from weekrank.operators import ordered
from weekrank.operators.columns import present


def fill_medians(df: DataFrame, columns: Sequence[str] = schemas.MEDIAN_COLUMNS) -> DataFrame:
    """Flag and fill the gaps of each column with its exact median (an empty column stays empty)."""
    found = ordered.medians(df, present(df, columns))
    return fill_values(df, found)


def fill_values(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Flag and fill with known values, so that a fitted median can be applied to other data."""
    changes = {}
    for c, value in values.items():
        changes[f"{c}_was_missing"] = F.col(c).isNull().cast("int")
        changes[c] = F.coalesce(F.col(c).cast("double"), F.lit(value).cast("double"))
    return df.withColumns(changes) if changes else df


def fill_days_since_release(df: DataFrame, column: str = "days_since_release", fitted: float | None = None) -> DataFrame:
    """Median fill of the release age; the median comes from the whole table unless one is given."""
    if column not in df.columns:
        return df
    return fill_values(df, {column: fitted}) if fitted is not None else fill_medians(df, [column])
