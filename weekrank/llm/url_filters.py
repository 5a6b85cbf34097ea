"""URL filters: a cascade of Bloom filters that is exact over the corpus's own keys.

Level 0 holds the listed keys. Level 1 holds those keys of the corpus (the universe) that level 0 wrongly accepts,
level 2 the listed keys that level 1 wrongly accepts, and so on until nothing is left. A key of the universe is listed
if and only if the first level that rejects it has an odd number (or, where all accept it, if the number of levels is
odd). The bits of all levels are set and looked up on the executors; only the filters themselves, whose size
follows the list and not the corpus, are sent everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank.llm import common
from weekrank.llm.words import mix

CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPREAD = 0x9E3779B97F4A7C15


@dataclass
class Level:
    words: np.ndarray  # the bits, 64 to a word
    hashes: int

    def accepts(self, one: np.ndarray, two: np.ndarray, number: int) -> np.ndarray:
        out = np.ones(len(one), bool)
        for at in _positions(one, two, number, self.hashes, len(self.words) * 64):
            out &= ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def _positions(one: np.ndarray, two: np.ndarray, number: int, hashes: int, bits: int):
    """The bits of each key by double hashing; every level has hashes of its own."""
    salt = np.uint64(number * SPREAD % 2**64)
    one, two = mix(one + salt), mix(two ^ salt) | np.uint64(1)
    for i in range(hashes):
        yield (one + np.uint64(i) * two) % np.uint64(bits)


def _hash_columns(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("one"), F.xxhash64(F.lit("second"), key).alias("two")]


def _u64(series: pd.Series) -> np.ndarray:
    return series.to_numpy(np.int64).view(np.uint64)


class Cascade:
    """Exact membership of universe keys in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, going = np.zeros(len(one), bool), np.arange(len(one))
        for number, level in enumerate(self.levels):
            yes = level.accepts(one[going], two[going], number)
            out[going[~yes]] = number % 2 == 1
            going = going[yes]
        out[going] = len(self.levels) % 2 == 1
        return out

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; false for null."""
        cascade = self

        @F.pandas_udf("boolean")
        def listed(one: pd.Series, two: pd.Series) -> pd.Series:
            return pd.Series(cascade.listed(_u64(one), _u64(two)))

        return F.coalesce(key.isNotNull() & listed(*_hash_columns(F.coalesce(key, F.lit("")))), F.lit(False))


def _level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A filter over hashed keys; its bits are set in the tasks and joined by word, so none holds them all."""
    bits = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = max(1, round(-math.log2(rate)))

    def positions(batches):
        for frame in batches:
            at = np.unique(np.concatenate(list(_positions(_u64(frame["one"]), _u64(frame["two"]), number, hashes, bits)))).astype(np.int64)
            yield pd.DataFrame({"word": at >> 6, "bit": (at & 63).astype(np.int32)})

    rows = keys.mapInPandas(positions, "word long, bit int").groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("value")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = _u64(rows["value"])
    return Level(words, hashes)


def build(listed: DataFrame, universe: DataFrame, rate: float = 0.01) -> Cascade:
    """Cascade for the key column `key` of both tables; null keys are left out.

    The universe needs no distinct keys: they are dropped after level 0 has thrown out nearly all of them.
    """
    one = common.stored(listed.dropna(subset=["key"]).distinct().select("key", *_hash_columns(F.col("key"))))
    count, levels, used = one.df.count(), [], [one]
    if not count:
        one.drop()
        return Cascade([Level(np.zeros(1, np.uint64), 1)])
    inside, outside = one.df, None
    while True:
        levels.append(_level(inside.select("one", "two"), count, rate if len(levels) == 0 else 0.5, len(levels)))
        if len(levels) > 64:
            raise RuntimeError("two different keys have the same 128-bit hash")
        if outside is None:  # what level 0 accepts of the universe, without the listed keys
            other = universe.dropna(subset=["key"]).select("key", *_hash_columns(F.col("key")))
            other = _accepted(other, levels[-1], 0).distinct().join(one.df.select("key"), "key", "left_anti")
        else:
            other = _accepted(outside, levels[-1], len(levels) - 1)
        kept = common.stored(other)
        used.append(kept)
        count = kept.df.count()
        if not count:
            break
        inside, outside = kept.df, inside
    for table in used:
        table.drop()
    return Cascade(levels)


def _accepted(keys: DataFrame, level: Level, number: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def accepts(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(level.accepts(_u64(one), _u64(two), number))

    return keys.filter(accepts("one", "two"))


# --- hosts, paths and rules -----------------------------------------------------------------------

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a url; both empty for null or where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *CAPITALS)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(rules: DataFrame) -> DataFrame:
    cut = F.instr("rule", "/")
    return rules.dropna().select(
        "verdict", F.translate(F.substring("rule", F.lit(1), cut - 1), *CAPITALS).alias("host"),
        F.substring("rule", cut, F.length("rule")).alias("path")).filter(cut > 0).withColumn("key", F.concat("host", "path"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and verdict to every page.

    `rules` has `rule` (host and path as one text) and `verdict` (allow or block); rules with a null or without a
    `/` are left out, and of repeated rules block wins. A rule fits its host and all subdomains where the url's path
    starts with the rule's path. A url without a rule gets `default`. The keys that a url can meet are its last
    1..n host labels with its first characters, for the few (labels, length) shapes that rules have; all those keys
    are the universe of two cascades: one over all rules, one over the blocking ones.
    """
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    listed = common.stored(_parts(rules).groupBy("key", "host", "path").agg(F.min(F.when(
        F.col("verdict") == "block", 0).otherwise(1)).alias("allowed")))
    shapes = listed.df.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size")).distinct().collect()
    host, path = host_and_path(F.col(url))
    parted = pages.select(*columns, host.alias("host"), path.alias("path"))

    def key(labels: int, size: int) -> Column:
        suffix = F.substring_index("host", ".", -labels)
        return F.when((F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= size),
                      F.concat(suffix, F.substring("path", 1, size)))

    keys = [key(*shape) for shape in sorted(map(tuple, shapes))]
    if not keys:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = parted.select(F.explode(F.array_compact(F.array(*keys))).alias("key"))
    member = build(listed.df.select("key"), universe)
    blocked = build(listed.df.filter("allowed = 0").select("key"), listed.df.select("key"))
    names = [f"_fit{i}" for i in range(len(keys))]
    fits = parted.withColumns(dict(zip(names, keys)))
    fits = fits.withColumns({f"{n}_in": member.contains(F.col(n)) for n in names})
    longest = F.array_max(F.array(*[F.when(F.col(f"{n}_in"), F.struct(
        F.length(n).alias("size"), F.lit(shape[0]).alias("labels"), F.col(n).alias("key")))
        for n, shape in zip(names, sorted(map(tuple, shapes)))]))["key"]
    ruled = fits.withColumn("rule", longest).drop(*names, *[f"{n}_in" for n in names])
    return ruled.withColumn("verdict", F.when(F.col("rule").isNull(), default).when(
        blocked.contains(F.col("rule")), "block").otherwise("allow"))
