"""Text expressions: trimming, join keys, credits and ordered category rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas

# The characters that count as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_all(c: Column) -> Column:
    """Strip every kind of Unicode white space from both ends (a native trim, no pattern)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def _collapse(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), f"[{WHITE_SPACE}]+", " ")


def _fold_unicode(c: Column) -> Column:
    """NFKC and case folding, which Spark has no expression for."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda name: " ".join(unicodedata.normalize("NFKC", name).split()).casefold(),
                         na_action="ignore")

    return F.pandas_udf(fold, T.StringType())(c)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def ascii_key(c: Column) -> Column:
    """The canonical key of an ASCII name, without Python."""
    return F.lower(_collapse(c))


def unicode_key(c: Column) -> Column:
    """The canonical key of any name, in Python."""
    return _fold_unicode(c)


def canonical_key(c: Column) -> Column:
    """Key on which differently typed names meet: NFKC, trimmed, single-spaced, case-folded.

    Every row passes through Arrow, ASCII names as null. Call it on distinct names (see `operators.joins.name_keys`), or
    split the rows first (`operators.joins.split_keys`).
    """
    ascii_only = is_ascii(c)
    return F.coalesce(F.when(ascii_only, ascii_key(c)), unicode_key(F.when(~ascii_only, c)))


def clean_credit(c: Column) -> Column:
    """Cut an artist credit at the first rule that matches, in rule order; any Unicode blank counts as one."""
    cuts = [F.when(c.rlike(f"(?U){cut}"), trim_all(F.regexp_replace(c, rf"(?sU){cut}.*$", ""))) for cut in schemas.CREDIT_CUTS]
    return F.coalesce(*cuts, trim_all(c))


def bucket_of(c: Column, rules=None, default: str = "other") -> Column:
    """First bucket one of whose needles occurs in the lower-cased text."""
    text = trim_all(F.lower(c))
    out = F.lit(default)
    for bucket, needles in reversed(rules or schemas.GENRE_BUCKETS):
        found = text.rlike("|".join(re.escape(needle) for needle in needles))
        out = F.when(found, F.lit(bucket)).otherwise(out)
    return out


def split_list(c: Column, separator: str = ",") -> Column:
    """Lower-cased, trimmed, non-empty parts of a separated list; null gives an empty array."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), re.escape(separator)), trim_all)
    return F.filter(parts, lambda part: part != "")


def array_mode(c: Column) -> Column:
    """Most frequent element, the smallest on ties; null for an empty array."""
    ranked = F.transform(
        F.array_distinct(c),
        lambda item: F.struct((-F.size(F.filter(c, lambda other: other == item))).alias("n"), item.alias("item")),
    )
    return F.array_min(ranked)["item"]
