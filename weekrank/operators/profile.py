"""Profiling reports: missing values, duplicates, distributions, lift, correlation, information."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weekrank import schemas, session
from weekrank.functions import dates, numbers, text
from weekrank.operators import joins, ordered
from weekrank.operators.columns import conform

WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _count() -> Column:
    return F.count(F.lit(1))


def _whole_table_share(c: str) -> Column:
    """Share of a column's total. For reports of a few rows: the window has one partition."""
    return F.col(c) / F.sum(c).over(W.partitionBy())


# --- table shape --------------------------------------------------------------------------------

def schema_profile(df: DataFrame) -> DataFrame:
    """Column names and types with the table's row and column counts."""
    fields = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
                       for i, (c, t) in enumerate(df.dtypes)])
    counted = df.agg(_count().alias("n_rows")).withColumn("field", F.explode(fields))
    return counted.select("field.*", "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def missing_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null share, non-null and null counts per column, in one aggregate."""
    columns = list(columns or df.columns)
    counted = df.agg(_count().alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    long = counted.unpivot(["_rows"], columns, "column", "non_null")
    null = F.col("_rows") - F.col("non_null")
    return long.select("column", (null / F.col("_rows")).alias("na_pct"), "non_null", null.alias("null"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: count; for numbers mean, std, min, exact quartiles, max; for others distinct, top and its count.

    Values of the non-numeric columns are counted once per (column, value); nothing is collected.
    """
    columns = list(columns or df.columns)
    numeric = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.NumericType)]
    other = [c for c in columns if c not in numeric]
    reports = []
    if numeric:
        moments = df.agg(*[
            F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                     F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
            for c in numeric
        ]).unpivot([], numeric, "column", "m").select("column", "m.*")
        quartiles = ordered.quantiles(df, numeric, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
        reports.append(moments.join(F.broadcast(quartiles), "column", "left"))  # one row per column
    if other:
        as_text = df.select(*[F.col(c).cast("string").alias(c) for c in other])
        counts = as_text.unpivot([], other, "column", "value").groupBy("column", "value").agg(_count().alias("n"))
        seen = F.col("value").isNotNull()
        # Highest count first, then the smallest text.
        rank = F.struct((-F.col("n")).alias("order"), F.col("value").alias("value"))
        shape = counts.groupBy("column").agg(
            F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"),
            F.min(F.when(seen, rank)).alias("_top"))
        reports.append(shape.select("column", "count", "unique", F.col("_top.value").alias("top"),
                                    (-F.col("_top.order")).alias("freq")))
    wanted = T.StructType([
        T.StructField("column", T.StringType()), T.StructField("count", T.LongType()),
        T.StructField("unique", T.LongType()), T.StructField("top", T.StringType()),
        T.StructField("freq", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    ])
    return conform(ordered.union_all(*reports, fill=True), wanted)


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: how many values match each date shape, how many parse, earliest and latest."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    value = F.col("value")
    parsed = dates.parse_text(value)
    shapes = {name: value.rlike(pattern) for name, pattern in dates.DATE_PATTERNS.items()}
    known = value.rlike("|".join(f"(?:{p})" for p in dates.DATE_PATTERNS.values()))
    return long.groupBy("column").agg(
        F.count(value).alias("non_null"), *[F.count_if(hit).alias(name) for name, hit in shapes.items()],
        F.count_if(~known).alias("other_invalid"), F.count(parsed).alias("parsed_ok"),
        F.min(parsed).alias("min_parsed"), F.max(parsed).alias("max_parsed"))


def duplicate_counts(df: DataFrame, checks: dict[str, Sequence[str]]) -> DataFrame:
    """Rows beyond the first of each distinct row (or key), per named check."""
    reports = [
        df.groupBy(*columns).agg(_count().alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dupe_count"))
        .select(F.lit(name).alias("check"), "dupe_count")
        for name, columns in checks.items()
    ]
    return ordered.union_all(*reports)


def validity(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each named rule, counted in one pass."""
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in checks.items()])
    return counted.unpivot([], list(checks), "metric", "n_rows")


def listening_checks(now) -> dict[str, Column]:
    """The validity rules of the listening table; `now` is passed in, so that reruns agree."""
    popularity = numbers.to_number(F.col("spotify_popularity"))
    return {
        "track_duration_negative": numbers.to_number(F.col("track_duration")) < 0,
        "spotify_duration_ms_negative": numbers.to_number(F.col("spotify_duration_ms")) < 0,
        "spotify_popularity_out_of_range": (popularity < 0) | (popularity > 100),
        "date_in_future": dates.to_utc(F.col("date")) > F.lit(now).cast("timestamp"),
    }


def time_span(df: DataFrame, ts: str = schemas.WEEK_TS) -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


# --- counts and shares --------------------------------------------------------------------------

def value_counts(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    return df.groupBy(*columns).agg(_count().alias(name))


def top_values(df: DataFrame, columns: Sequence[str], n: int, name: str = "count") -> DataFrame:
    """The n most frequent values, ties in value order."""
    return ordered.top(value_counts(df, *columns, name=name), n, F.desc(name), *columns)


def top_mean(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Mean count over the n most frequent values."""
    return top_values(df, columns, n).agg(F.avg("count").alias("mean_count"))


def list_items(df: DataFrame, column: str, item: str = "genre", separator: str = ",") -> DataFrame:
    """One row per part of a separated list."""
    return df.select(F.explode(text.split_list(F.col(column), separator)).alias(item))


def bucket_counts(df: DataFrame, column: str, rules=None) -> DataFrame:
    """Counts per bucket. Parts are counted first, so the rules run once per distinct part."""
    parts = value_counts(list_items(df, column), "genre", name="n")
    return parts.groupBy(text.bucket_of(F.col("genre"), rules).alias("bucket")).agg(F.sum("n").alias("count"))


def bucket_mapping(df: DataFrame, column: str, rules=None) -> DataFrame:
    """Distinct parts with their bucket."""
    return list_items(df, column).distinct().withColumn("bucket", text.bucket_of(F.col("genre"), rules))


def weekly_activity(df: DataFrame, week: str = schemas.WEEK) -> DataFrame:
    """Events per week (a missing week is a group of its own)."""
    return value_counts(df, week, name="scrobbles")


def mean_of(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.avg(column).alias(name))


def label_rate(df: DataFrame, label: str = schemas.LABEL, week: str = schemas.WEEK) -> DataFrame:
    return df.groupBy(week).agg(F.avg(label).alias("favorite_rate"))


def class_balance(df: DataFrame, label: str = schemas.LABEL) -> DataFrame:
    """Rows and share per class (missing labels count as a class)."""
    return value_counts(df, label).withColumn("share", _whole_table_share("count"))


def class_weight(df: DataFrame, label: str = schemas.LABEL) -> DataFrame:
    """Positives, negatives, positive rate and the negative-to-positive weight."""
    positive, negative = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    counted = df.agg(positive.alias("n_pos"), negative.alias("n_neg"))
    return counted.withColumns({
        "pos_rate": F.try_divide(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")),
        "pos_weight": F.try_divide(F.col("n_neg"), F.col("n_pos")),
    })


def weekday_share(df: DataFrame, ts: str = "date", label: str = schemas.LABEL) -> DataFrame:
    """Share of plays per weekday, Sunday first, for favourites and for the rest (0 for a silent day)."""
    days = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(d).alias("weekday")) for i, d in enumerate(WEEKDAYS)])
    favourite = numbers.flag(F.col(label) == 1)
    counts = df.select(favourite.alias("_fav"), dates.weekday_name(dates.to_utc(F.col(ts))).alias("weekday")).dropna(
        subset=["weekday"]).groupBy("_fav", "weekday").agg(_count().alias("n"))
    # At most 14 counts: both sides of the shares fit in one row per weekday.
    wide = counts.groupBy("weekday").pivot("_fav", [1, 0]).agg(F.sum("n"))
    wide = wide.select("weekday", F.col("1").alias("n_fav"), F.col("0").alias("n_rest"))
    week = df.sparkSession.range(1).select(F.explode(days).alias("d")).select("d.*")
    filled = week.join(F.broadcast(wide), "weekday", "left").fillna(0, ["n_fav", "n_rest"])
    total = W.partitionBy()

    def share(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c), F.sum(c).over(total)), F.lit(0.0))

    return filled.select("position", "weekday", share("n_fav").alias("share_favorite"), share("n_rest").alias("share_rest"))


def positive_vs_rest(weekly: DataFrame, *, week: str = schemas.WEEK, measure: str = "plays",
                     label: str = "is_fav") -> DataFrame:
    """Per week: plays of the favourite, mean and maximum of the others, label rate; weeks that have both."""
    fav = F.when(F.col(label) == 1, F.col(measure))
    rest = F.when(F.col(label) == 0, F.col(measure))
    out = weekly.dropna(subset=[week]).groupBy(week).agg(F.max(fav).alias("fav_plays"), F.avg(rest).alias("avg_nonfav_plays"),
                                  F.max(rest).alias("max_nonfav_plays"), F.avg(label).alias("favorite_rate"))
    return out.dropna(subset=["fav_plays", "avg_nonfav_plays"])


def join_by_week(left: DataFrame, right: DataFrame, week: str = schemas.WEEK) -> DataFrame:
    """Inner join of two per-week reports."""
    return left.join(right, week, "inner")


def newness_share(weekly: DataFrame, label: str = schemas.LABEL, flag: str = "first_seen_week") -> DataFrame:
    """New and returning entities among the positives (1 in the flag means new)."""
    group = F.when(F.col(flag) == 1, "first_seen").otherwise("seen_before")
    counts = weekly.filter(F.col(label) == 1).groupBy(group.alias("first_seen_flag")).agg(
        _count().alias("favorite_count"))
    return counts.withColumn("favorite_share", _whole_table_share("favorite_count"))


# --- distributions ------------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, low: float, high: float, bins: int,
              by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram: every bin with centre, count and percent; the last bin is closed.

    Values outside [low, high] and missing values are left out.
    """
    value = numbers.to_number(F.col(column))
    width = (high - low) / bins
    place = F.least(F.floor((value - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(value.between(low, high)).groupBy(*by, place.alias("bin")).agg(_count().alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        # One row per group and bin: the groups of a report are few.
        frame = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = frame.join(counts, [*by, "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy(*by))
    return filled.select(
        *by, "bin", (F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)).alias("center"), F.col("n").alias("count"),
        F.coalesce(F.try_divide(F.col("n") * F.lit(100.0), total), F.lit(0.0)).alias("percent"))


def lift_tables(df: DataFrame, edges: dict[str, Sequence[float]], label: str = schemas.LABEL) -> DataFrame:
    """Label rate and label count per feature and half-open bin [a, b), for all features in one pass.

    Empty bins stay, values past the edges do not.
    """
    pairs = {f: list(zip(map(float, e[:-1]), map(float, e[1:]))) for f, e in edges.items()}

    def place(feature: str) -> Column:
        value, out = F.col(feature).cast("double"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(pairs[feature]):
            out = F.when((value >= a) & (value < b), F.lit(i)).otherwise(out)
        return out.alias(feature)

    long = df.select(F.col(label).alias("_label"), *[place(f) for f in pairs]).unpivot("_label", list(pairs), "feature", "bin")
    counts = long.filter("bin IS NOT NULL").groupBy("feature", "bin").agg(F.avg("_label").alias("favorite_rate"), F.count("_label").alias("count"))
    frame = df.sparkSession.createDataFrame([(f, i, a, b) for f, bins in pairs.items() for i, (a, b) in enumerate(bins)],
                                            "feature string, bin int, low double, high double")
    # One row per feature and bin.
    return frame.join(F.broadcast(counts), ["feature", "bin"], "left").fillna(0, ["count"])


def lift_bins(df: DataFrame, feature: str, label: str = schemas.LABEL, edges: Sequence[float] | None = None) -> DataFrame:
    """The lift table of one feature."""
    return lift_tables(df, {feature: edges or schemas.LIFT_BINS[feature]}, label).drop("feature")


# --- correlation and information ----------------------------------------------------------------

def pearson_with_label(df: DataFrame, columns: Sequence[str], label: str = schemas.LABEL) -> DataFrame:
    """Correlation of each column with the label over rows that have both, in one aggregate.

    NaN where the column or the label is the same in all of them; null with fewer than two such rows.
    """
    def value(column: str) -> Column:
        a, b = F.col(column).cast("double"), F.col(label).cast("double")
        x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        # `corr` divides by this product itself and fails on 0.
        spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
        return F.when(F.count(x) > 1, F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread)))

    row = df.agg(*[value(c).alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", "correlation")


def spearman(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Rank correlation of every column pair over the rows that have both values.

    Each pair is reduced to counted (a, b) combinations; ties share their mean rank, and the
    correlation of the ranks is taken with the counts as weights. With a threshold, only pairs at
    or above it in absolute value are kept.
    """
    pairs = list(combinations(columns, 2))
    number = {pair: i for i, pair in enumerate(pairs)}
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(number[p]).alias("pair"), F.col(p[0]).alias("a"), F.col(p[1]).alias("b"))
                      for p in pairs])
    joint = typed.select(F.explode(cells).alias("c")).select("c.*").dropna()
    # Read by both rank tables and by the final sums.
    joint = session.cut(joint.groupBy("pair", "a", "b").agg(_count().alias("n")))

    def ranks(side: str) -> DataFrame:
        counts = joint.groupBy("pair", side).agg(F.sum("n").alias("n"))
        totals = ordered.running_totals(counts, side, ["n"], ["pair"])
        mean_rank = F.col("n_through") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
        return totals.select("pair", side, mean_rank.alias(f"rank_{side}"))

    # One value (often 0) may be in a third of the combinations: both joins spread their hot keys.
    weighted = joins.spread_join(joint, ranks("a"), ["pair", "a"], spread_by=["b"], how="inner")
    weighted = joins.spread_join(weighted, ranks("b"), ["pair", "b"], spread_by=["a"], how="inner",
                                 counts=joint.groupBy("pair", "b").agg(_count().alias("n")))
    n, x, y = F.col("n").cast("double"), F.col("rank_a"), F.col("rank_b")
    # Ranks average (N + 1) / 2, so centring them keeps the sums well conditioned.
    sums = weighted.groupBy("pair").agg(F.sum(n).alias("rows"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"))
    centred = weighted.join(F.broadcast(sums), "pair")  # one row per pair of columns
    dx, dy = x - F.col("sx") / F.col("rows"), y - F.col("sy") / F.col("rows")
    out = centred.groupBy("pair").agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"),
                                      F.sum(n * dy * dy).alias("yy"))
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    names = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")) for a, b in pairs])
    named = out.select(names[F.col("pair")].alias("p"), value.alias("spearman")).select("p.*", "spearman")
    return named if threshold is None else named.filter(F.abs("spearman") >= threshold)


def high_correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    return spearman(df, columns, threshold)


def mutual_information(df: DataFrame, columns: Sequence[str], label: str = schemas.LABEL) -> DataFrame:
    """Mutual information (nats) of 0/1 columns with the label, with support and prevalence."""
    y = F.col(label).cast("int")
    ones = {c: F.col(f"`{c}`") == 1 for c in columns}
    row = df.agg(_count().alias("_n"), F.count_if(y == 1).alias("_pos"), *[
        F.struct(F.count_if(hit).alias("x"), F.count_if(hit & (y == 1)).alias("xy")).alias(c)
        for c, hit in ones.items()])
    long = row.unpivot(["_n", "_pos"], list(columns), "feature", "m")
    n, pos, x, xy = F.col("_n"), F.col("_pos"), F.col("m.x"), F.col("m.xy")

    def term(joint: Column, a: Column, b: Column) -> Column:
        share = joint / n
        return F.when(joint > 0, share * F.ln(share / ((a / n) * (b / n)))).otherwise(F.lit(0.0))

    mi = (term(xy, x, pos) + term(x - xy, x, n - pos) + term(pos - xy, n - x, pos)
          + term(n - x - pos + xy, n - x, n - pos))
    return long.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"), x.alias("support"),
                       (x / n).alias("prevalence"))


def high_water_mark(df: DataFrame, ts: str = "date", number: str = "scrobble_number") -> DataFrame:
    """One second after the newest event (epoch seconds) and the highest running number."""
    newest = F.max(dates.to_utc(F.col(ts)))
    return df.agg((F.unix_timestamp(newest) + 1).alias("from_unix"), F.coalesce(F.max(number), F.lit(0)).alias("last_number"))

