"""Order-based results over a whole table without a one-task window: running totals, ranks, quantiles.

All of them follow one plan. Rows are range-partitioned by the order, each partition is summed, the
few partition sums (one row per partition) become offsets, and a running total inside each partition
is shifted by its offset. The placed rows are checkpointed, so that the sums and the running totals
see the same placement even when executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekrank import session


def running_totals(df: DataFrame, order: Column | str, sums: Sequence[str], group: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Add `<c>_through`, the running total of each column of `sums` up to and including the row, and
    `<c>_total`, the total of the group.

    `df` has one row per (group, order): aggregate first, so that a hot value is a single row.
    """
    key = F.col(order) if isinstance(order, str) else order
    key = key.desc() if descending else key.asc()
    group = list(group)
    placed = session.cut(df.repartitionByRange(*[F.col(g) for g in group], key)
                         .withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_in_{c}") for c in sums])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = parts.select(
        *group, "_part", *[F.coalesce(F.sum(f"_in_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_in_{c}").over(whole).alias(f"{c}_total") for c in sums])
    so_far = W.partitionBy(*group, "_part").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumns({f"{c}_through": F.sum(c).over(so_far) for c in sums})
    # One row per partition (and per group inside it): bounded by the shuffle width.
    joined = local.join(F.broadcast(offsets), [*group, "_part"])
    return joined.withColumns({f"{c}_through": F.col(f"{c}_through") + F.col(f"_off_{c}") for c in sums}).drop(
        "_part", *[f"_off_{c}" for c in sums])


def running_number(df: DataFrame, order: Sequence[Column | str], name: str = "scrobble_number",
                   start: int = 0) -> DataFrame:
    """Number the rows from start + 1 in a total order, whatever the size of a day or a tie."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # High bits: partition; low 33 bits: place in the sorted partition.
    placed = session.cut(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.lit(start) + F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn(name, number.cast("long")).drop("_at", "_part", "_off")


def value_counts_long(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(column, value, n) over several numeric columns in one pass; missing values are left out."""
    typed = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot([F.col(g) for g in group], list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy(*group, "column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, columns: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per column, one result per fraction.

    Built on counted values rather than on `percentile`, whose buffer holds every distinct value
    of a column in one task.
    """
    spread = running_totals(value_counts_long(df, columns), "value", ["n"], ["column"])

    def at(row: Column) -> Column:
        return F.min(F.when(F.col("n_through") > row, F.col("value")))

    aggregates = []
    for name, fraction in fractions.items():
        place = (F.col("n_total") - 1) * F.lit(float(fraction))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        aggregates.append((low + (high - low) * share).alias(name))
    return spread.groupBy("column").agg(*aggregates)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column (one number per column reaches the driver)."""
    if not columns:
        return {}
    found = {row["column"]: row["median"] for row in quantiles(df, columns, {"median": 0.5}).collect()}
    return {c: found.get(c) for c in columns}


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, rank) with tied values sharing their mean rank."""
    spread = running_totals(value_counts_long(df, columns), "value", ["n"], ["column"])
    return spread.select("column", "value", "n",
                         (F.col("n_through") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def union_all(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """Stack tables by column name; with `fill`, absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    other = right.select(F.struct(*right.columns).alias("_s")).scalar()
    return left.withColumn("_s", other).select(*left.columns, "_s.*")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a total order (each task keeps n rows only)."""
    return df.orderBy(*order).limit(n)


def row_slice(df: DataFrame, start: int, stop: int, *order: Column | str) -> DataFrame:
    """Rows start..stop-1 of a total order."""
    return df.orderBy(*order).offset(start).limit(stop - start)
