"""Joins: metadata lookups that survive hot keys, canonical-key lookups, pending keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekrank import schemas, session
from weekrank.functions import text

def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the given (total) order.

    Spark trims every map partition to one row per key before the shuffle (window group limit),
    so a hot key costs one row per task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the newest by the given columns (missing counts as oldest)."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in newest])


def same(pairs) -> Column:
    """Null-safe equality of column pairs whose names are all different."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key in `n`; combined map-side, so a hot key is one row per task."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, spread_by: Sequence[str],
                counts: DataFrame | None = None, weight: str | None = None, how: str = "left",
                null_safe: bool = False, parts: int | None = None) -> DataFrame:
    """Equi-join in which hot left keys are cut into pieces; keeps the columns of both sides.

    With `parts` shuffle partitions (the session's number by default) a key is hot when it holds more
    than 1/parts of the left rows, and it is cut so that no piece holds more: a key with a third of
    all rows becomes a third of all partitions. There are fewer than `parts` hot keys, so their list
    is a safe broadcast. Left rows go to a piece by a hash of `spread_by`, right rows to every piece;
    all other keys stay whole. Rows with a null key are spread too. `right` holds few rows per key.

    `counts` has the left rows per key in `n`. Counting reads `left` again, so give counts taken from
    the table the keys come from when `left` is itself a join. `weight` names the column of `right`
    that repeats this number (it is dropped), so that the right side needs no marking join.
    """
    on = list(on)
    counts = key_counts(left, on) if counts is None else counts
    parts = session.shuffle_width(left.sparkSession) if parts is None else parts
    total = counts.agg(F.sum("n")).scalar()

    def pieces_of(n: Column) -> Column:
        return F.when(n * parts > total, F.ceil(n * F.lit(float(parts)) / total).cast("int"))

    hot = counts.filter(F.col("n") * parts > total).select(
        *[F.col(c).alias(f"_hot_{c}") for c in on], pieces_of(F.col("n")).alias("_pieces"))

    def marked(side: DataFrame) -> DataFrame:
        pairs = [(c, f"_hot_{c}") for c in on]
        return side.join(F.broadcast(hot), same(pairs), "left").drop(*[b for _, b in pairs])

    piece = F.pmod(F.xxhash64(*spread_by), F.col("_pieces").cast("long")).cast("int")
    salted_left = marked(left).withColumn("_salt", F.coalesce(piece, F.lit(0))).drop("_pieces")
    known = right.withColumn("_pieces", pieces_of(F.col(weight))) if weight else marked(right)
    every = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    extra = [c for c in right.columns if c not in on and c != weight]
    salted_right = known.select(*[F.col(c).alias(f"_r_{c}") for c in on], *extra, F.explode(every).alias("_r_salt"))
    pairs = [(c, f"_r_{c}") for c in on]
    keys = same(pairs) if null_safe else reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in pairs])
    joined = salted_left.join(salted_right, keys & (F.col("_salt") == F.col("_r_salt")), how)
    return joined.drop("_salt", "_r_salt", *[f"_r_{c}" for c in on])


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], *, spread_by: Sequence[str],
           counts: DataFrame | None = None) -> DataFrame:
    """Left join to a side with at most one row per key; the row count of `left` stays.

    A side whose files are below the broadcast limit is left to Catalyst, which broadcasts it; a
    larger one goes through `spread_join`. Either way the left columns come first, in their order.
    """
    names = [*left.columns, *[c for c in right.columns if c not in on]]
    joined = (left.join(right, list(on), "left") if session.fits_broadcast(right)
              else spread_join(left, right, on, spread_by=spread_by, counts=counts))
    return joined.select(*[F.col(f"`{c}`") for c in names])


def by_distinct(df: DataFrame, columns: Sequence[str], derive: Callable[[DataFrame], DataFrame],
                spread_by: Sequence[str] = ()) -> DataFrame:
    """Add columns that depend on a few values only: derived once per distinct value, then looked up.

    For costly expressions on repetitive columns. The distinct values are stored, so their size is
    known: a small table is broadcast, a large one goes through `spread_join`. Rows with a null in
    `columns` get null.
    """
    values = df.select(*columns).dropna().distinct()
    return lookup(df, session.cut(derive(values)), columns, spread_by=list(spread_by) or df.columns)


def attach(left: DataFrame, right: DataFrame | None, on: Sequence[str], *, spread_by: Sequence[str],
           newest: Sequence[str] = (), counts: DataFrame | None = None,
           skip: Sequence[str] = ("artist_name", "track_name", "album_name")) -> DataFrame:
    """Metadata join: one right row per key, columns the left side already has are not taken.

    An absent table, or one without the keys, leaves `left` as it is.
    """
    if right is None or not set(on) <= set(right.columns):
        return left
    order = list(newest) or [c for c in right.columns if c not in on]
    extra = [c for c in right.columns if c not in on and c not in skip and c not in left.columns]
    usable = right.dropna(subset=list(on))
    one = first_per_key(usable, on, [F.col(c).desc_nulls_last() if newest else F.col(c).asc_nulls_last()
                                     for c in order]) if order else usable.distinct()
    return lookup(left, one.select(*on, *extra), on, spread_by=spread_by, counts=counts)


def attach_labels(left: DataFrame, labels: DataFrame | None, on: Sequence[str], *, spread_by: Sequence[str],
                  label: str = schemas.LABEL, added: str = "added_at_utc", counts: DataFrame | None = None) -> DataFrame:
    """Label join: the newest label per key, 0 where there is none; never adds rows."""
    if labels is None or not set(on) <= set(labels.columns):
        return left
    kept = labels.select(*[c for c in [*on, label, added] if c in labels.columns])
    one = latest_per_key(kept.dropna(subset=list(on)), on, [c for c in (added, label) if c in kept.columns])
    out = lookup(left, one, on, spread_by=spread_by, counts=counts)
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(0)).cast("int")) if label in out.columns else out


# --- canonical keys -----------------------------------------------------------------------------

KEY_NAMES = {"artist_name": "artist_key", "track_name": "track_key", "album_name": "album_key"}


def with_keys(df: DataFrame, names: dict[str, str] = KEY_NAMES) -> DataFrame:
    """Canonical keys beside the name columns. For tables that hold few rows per name."""
    return df.withColumns({key: text.canonical_key(F.col(c).cast("string"))
                           for c, key in names.items() if c in df.columns})


def split_keys(df: DataFrame, name: str, key: str) -> DataFrame:
    """Adds the canonical key of `name` by a split plan: ASCII and null names in the JVM, each other name once in Python.

    The rows are read twice, once for each side; give a stored table. Rows with other names meet their keys by a join.
    """
    value = F.col(f"`{name}`").cast("string")
    plain = F.coalesce(text.is_ascii(value), F.lit(True))
    native = df.filter(plain).withColumn(key, text.ascii_key(value))
    others = df.filter(~plain).withColumn("_name", value)
    keyed = by_distinct(others, ["_name"], lambda d: d.withColumn(key, text.unicode_key(F.col("_name"))), spread_by=df.columns)
    return native.unionByName(keyed.drop("_name"))


def name_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct name combinations with their keys and `n`, the number of rows of each."""
    return with_keys(key_counts(df, columns), {c: KEY_NAMES[c] for c in columns if c in KEY_NAMES})


# --- unmatched and two-pass matches -------------------------------------------------------------

def pending_keys(candidates: DataFrame, known: DataFrame | None, keys: Sequence[str],
                 keep_null: bool = False) -> DataFrame:
    """Distinct candidate keys without a row in `known` (with `keep_null`, null equals null)."""
    wanted = candidates.select(*keys).distinct()
    if not keep_null:
        wanted = wanted.dropna(subset=list(keys))
    if known is None:
        return wanted
    seen = known.select(*[F.col(k).alias(f"_seen_{k}") for k in keys]).distinct()
    if keep_null:
        return wanted.join(seen, same([(k, f"_seen_{k}") for k in keys]), "left_anti")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_seen_{k}") for k in keys])
    return wanted.join(seen, on, "left_anti")


def first_name(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The earliest name seen for each id."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.min_by(name, order).alias(name))


def two_pass_match(wanted: DataFrame, catalog: DataFrame, *, artist: str = "artist_name", track: str = "track_name",
                   order: Sequence[str]) -> DataFrame:
    """Match on the full artist credit, else on the cut credit; the first catalog row of each.

    `wanted` holds distinct (artist, track); the result adds the catalog's other columns and
    `match_pass` (1, 2 or null).
    """
    extra = [c for c in catalog.columns if c not in (artist, track)]
    found = first_per_key(catalog.dropna(subset=[artist, track]), [artist, track], list(order)).select(
        F.col(artist).alias("_artist"), F.col(track).alias("_track"), *extra)
    exact = wanted.join(found, (F.col(artist) == F.col("_artist")) & (F.col(track) == F.col("_track")), "left")
    hit = exact.filter(F.col("_artist").isNotNull()).withColumn("match_pass", F.lit(1))
    residue = exact.filter(F.col("_artist").isNull()).select(*wanted.columns)
    credit = text.clean_credit(F.col(artist))
    retry = residue.withColumn("_cut", F.when(credit != F.col(artist), credit))
    second = retry.join(found, (F.col("_cut") == F.col("_artist")) & (F.col(track) == F.col("_track")), "left")
    second = second.withColumn("match_pass", F.when(F.col("_artist").isNotNull(), F.lit(2))).drop("_cut")
    return hit.unionByName(second).drop("_artist", "_track")


# --- fixed lookups ------------------------------------------------------------------------------

def iso_countries(spark: SparkSession) -> DataFrame:
    """Country codes and English names known to the Java locale data (about 250 rows)."""
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    rows = [(code, locale("", code).getDisplayCountry(english)) for code in locale.getISOCountries()]
    return spark.createDataFrame(rows, "code string, country string")


def with_lookup(df: DataFrame, code: Column, table: DataFrame, value: str, out: str, default: str = "Unknown",
                key: str = "code") -> DataFrame:
    """Name of a code from a table small enough to send everywhere, matched case-blind."""
    pairs = table.select(F.upper(F.col(key)).alias("_code"), F.col(value).alias("_value"))
    pairs = first_per_key(pairs, ["_code"], ["_value"])
    asked = df.withColumn("_asked", F.upper(code))
    joined = asked.join(pairs, F.col("_asked") == F.col("_code"), "left")
    return joined.withColumn(out, F.coalesce("_value", F.lit(default))).drop("_asked", "_code", "_value")
