"""Clean events to the weekly feature table and its modelling view."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weekrank import schemas, session
from weekrank.operators import columns, features, impute, weekly


def weekly_table(events: DataFrame, **settings) -> DataFrame:
    """Weekly base with all features. The base is stored once, since the features read it twice."""
    base = session.cut(weekly.weekly_base(events, **settings))
    return features.core_features(base, entity=settings.get("entity", schemas.ENTITY),
                                  week_key=settings.get("week", schemas.WEEK))


def model_view(table: DataFrame, start: str | None = schemas.LABEL_START, fitted_age: float | None = None) -> DataFrame:
    """Label period only (cut after the history features), filled release age, leaky and redundant columns out.

    The median of the release age is a pass of its own: give a stored table, so that the features are
    not computed for it again.
    """
    period = columns.label_period(columns.with_week_timestamp(table), start)
    filled = impute.fill_days_since_release(period, fitted=fitted_age)
    return filled.transform(columns.drop_leaky).transform(columns.drop_redundant)
