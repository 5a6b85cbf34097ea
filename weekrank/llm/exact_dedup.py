"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Rows are grouped by length, then by a hash of their first
characters, and only where such a group holds several rows is the full content hashed. The lengths and first characters
of all texts are counted in one pass. The groups that hold several rows are marked in a bitmap of a fixed number of bits,
so the second pass tells from a broadcast of a proven size which rows to hash in full; two groups on one bit only mean
that a row is hashed for nothing. Rows then meet by their full SHA-256, without their texts; large groups are dealt in pieces.

A null text counts as empty. Of equal texts the rows with the largest doc_id stay: rows that repeat one doc_id stay or go
together, and a row without doc_id stays only if no equal row has one. Other columns, whatever their names, are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekrank.llm import common
from weekrank.operators import joins

PREFIX = 256  # characters whose hash splits the groups of equal length
BITS = common.BITS  # bits that mark groups of several rows
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null as empty. Texts without other letters take the fast way to the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, *LOWER))


def survivors(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """doc_id, text, length and `shared`: whether another row may have the same length and first characters."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = whole.withColumns({"length": F.octet_length("text"), "prefix": F.xxhash64(normalised(F.substring("text", 1, prefix)))})
    several = keyed.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = common.with_bit(keyed, common.bitmap(several, ["length", "prefix"], BITS), ["length", "prefix"], BITS, "shared")
    return marked.select("doc_id", "text", "length", "shared")


def dedup(docs: DataFrame, prefix: int = PREFIX, digests: bool = False) -> DataFrame:
    """doc_id, keep_id (doc_id of the row that stays), group_size, kept and text_sha256 of every row.

    text_sha256 is null for rows that never had to be hashed in full, unless `digests` asks for all of them.
    """
    rows = survivors(docs, prefix)
    full = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    hashed = rows.select("doc_id", "shared", F.unhex(full if digests else F.when(F.col("shared"), full)).alias("sha"),
                         F.monotonically_increasing_id().alias("tag"))
    store = common.stored(hashed)
    shared = store.df.filter("shared")
    groups = common.stored(shared.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = joins.spread_join(shared, groups.df.withColumn("group_size", F.col("n")), ["sha"], spread_by=["tag"],
                            counts=groups.df.select("sha", "n"), weight="n")
    alone = store.df.filter("NOT shared").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    met = met.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
                           "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    return met.select(*columns).unionAll(alone.select(*columns))
