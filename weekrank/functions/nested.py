"""Expressions on arrays and structs of landed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_item(c: Column) -> Column:
    return F.get(c, F.lit(0))


def top_by_count(c: Column, name: str = "name", count: str = "count") -> Column:
    """Name of the entry with the highest count, the first one on ties."""
    placed = F.transform(c, lambda item, at: F.struct(
        (-F.coalesce(item[count], F.lit(0))).alias("order"), at.alias("at"), item[name].alias("name")))
    return F.array_min(placed)["name"]


def text_of(c: Column, attribute: str, value: str, text: str = "#text") -> Column:
    """Text of the first entry whose attribute has the value; empty text counts as missing."""
    return F.nullif(first_item(F.filter(c, lambda item: item[attribute] == value))[text], F.lit(""))


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("long"))
