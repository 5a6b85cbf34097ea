"""MinHash near-dedup with DartMinHash: a sparse weighted signature from hashed darts, banded, verified and grouped.

Every element of a text's weighted set throws darts at fixed places: cell by cell of (weight, rank), a number of darts
that follows Poisson(1), each with a weight place, a rank and a coordinate, all hashed from the element and the cell. A
dart counts if its weight place is below the weight of the element. The earliest dart of each coordinate is the
signature; two sets agree in a coordinate with the probability of their weighted Jaccard similarity. Only ranks up to
about k ln k / (total weight) are needed to fill k coordinates, so a text throws about k ln k darts whatever its length.

Sets with the same elements are one set. Sets that share a band are linked to the first and the last set of that band,
links are verified on the sets themselves, and linked sets are one group. A band of four sets or more that this leaves
in several groups is searched without its ends: its sets are compared by exact prefixes of their shingles, the rare ones
first, so that every pair from the threshold on is verified or already linked. A text of fewer words than a shingle is one
shingle; a text without words is in no group but its own. A row without an id takes part with its text.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekrank.llm import common, words

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5  # a pair at 0.8 shares no band once in 15,000 times
KEY_SETS = 1000  # sets of one shingle that a piece of a hot one holds
PIECE = 512 * 1024  # text bytes whose shingles and darts a task holds at once
BITS = 2048  # bits of a set's shingles


def _poisson(h: np.ndarray) -> np.ndarray:
    """Poisson(1) numbers from uniform hashes."""
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    return np.searchsorted(steps, (h >> np.uint64(11)) / float(1 << 53), "right")


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) / float(1 << 53)


def signatures(elements: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k hashes of the earliest darts of each set; `at` are the offsets of the sets. Empty sets get zeros."""
    sets = len(at) - 1
    out = np.zeros((sets, k), np.uint64)
    totals = np.add.reduceat(np.append(weights, 0.0), at[:-1]) * (np.diff(at) > 0) if sets else np.zeros(0)
    owner = np.repeat(np.arange(sets), np.diff(at))
    limit = (k * math.log(k) + 3 * k) / np.maximum(totals, 1e-12)
    open_sets, low = totals > 0, np.zeros(sets)
    best = np.full((sets, k), np.inf)
    while open_sets.any():
        use = np.flatnonzero(open_sets[owner])
        # Cells of one unit of weight and one unit of rank.
        heights = np.ceil(weights[use]).astype(np.int64)
        first = np.floor(low[owner[use]]).astype(np.int64)
        widths = np.ceil(limit[owner[use]]).astype(np.int64) - first
        cells = heights * widths
        which = np.repeat(use, cells)
        number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        up, right = number // np.repeat(widths, cells), np.repeat(first, cells) + number % np.repeat(widths, cells)
        cell = words.mix(elements[which] ^ words.mix((up.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1)))
        n = _poisson(cell)
        dart = words.mix(np.repeat(cell, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64) * words.BASE)
        source, up, right = np.repeat(which, n), np.repeat(up, n), np.repeat(right, n)
        rank = right + _unit(words.mix(dart ^ words.GRAM))
        keep = (up + _unit(words.mix(dart + words.GRAM)) < weights[source]) & (rank < limit[owner[source]]) & (rank >= low[owner[source]])
        dart, source, rank = dart[keep], source[keep], rank[keep]
        slot = owner[source] * k + (words.mix(dart + words.BASE) % np.uint64(k)).astype(np.int64)
        by = np.lexsort((dart, rank, slot))
        slot, dart, rank = slot[by], dart[by], rank[by]
        head = np.ones(len(slot), bool)
        head[1:] = slot[1:] != slot[:-1]
        slot, dart, rank = slot[head], dart[head], rank[head]
        better = rank < best.ravel()[slot]
        out.ravel()[slot[better]], best.ravel()[slot[better]] = dart[better], rank[better]
        open_sets &= np.isinf(best).any(axis=1)
        low, limit = np.where(open_sets, limit, low), np.where(open_sets, limit * 2, limit)
    return out


def sets_of(texts: pa.Array, size: int):
    """Distinct shingle hashes of each text and the offsets."""
    data, offsets = common.flat(texts)
    hashes, _, _, at = words.hashed(data, offsets, True)
    starts, grams = words.grams(hashes, at, size)
    owner = np.searchsorted(at, starts, "right") - 1
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < size))
    grams = np.concatenate([grams, words.window_hashes(hashes, at[short], at[short + 1], words.GRAM)])
    owner = np.concatenate([owner, short])
    by = np.lexsort((grams, owner))
    grams, owner = grams[by], owner[by]
    new = np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(at)))


def _names(grams: np.ndarray, at: np.ndarray) -> pa.Array:
    """64-bit names of the sets; null for one without words."""
    return pa.array(words.window_hashes(grams, at[:-1], at[1:], words.BASE).view(np.int64), mask=np.diff(at) == 0)


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, the 64-bit name of the set (null without words) and its band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in common.cut(batches, most=PIECE):
            grams, at = sets_of(batch.column(2), size)
            sign = signatures(grams, np.ones(len(grams)), at, BANDS * ROWS)
            order = np.arange(1, ROWS + 1, dtype=np.uint64) * words.BASE
            band = words.mix((words.mix(sign.reshape(-1, BANDS, ROWS) + order)).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            ends = np.arange(len(at)) * BANDS
            ends = ends if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _names(grams, at), common.grouped(band.view(np.int64).ravel(), ends, pa.int64())],
                                             ["doc_id", "text_key", "name", "bands"])
        common.release()

    keyed = docs.select("doc_id", common.text_key().alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, name long, bands array<long>")


def shingles(docs: DataFrame, rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """name and grams of the sets named in `wanted`, read again from their texts.

    Rows (doc_id, text_key, name) of other sets are told apart by a bitmap of the wanted texts before anything is read or shuffled.
    """
    texts = rows.join(wanted, "name").groupBy("name").agg(F.min("text_key").alias("text_key")).select("text_key")
    keyed = docs.select(common.text_key().alias("text_key"), "text")
    some = common.with_bit(keyed, common.bitmap(texts, ["text_key"], common.BITS), ["text_key"], common.BITS, "wanted").filter("wanted").select("text")

    def run(batches):
        for batch in common.cut(batches, most=PIECE):
            grams, at = sets_of(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([_names(grams, at), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))], ["name", "grams"])
        common.release()

    found = some.mapInArrow(run, "name long, grams array<long>").filter("name IS NOT NULL")
    # Copies leave a task once. Other texts with a wanted one's bit go with the join.
    return found.groupBy("name").agg(F.first("grams").alias("grams")).join(wanted, "name", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) whose sets have at least that Jaccard similarity."""
    wide = pairs.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("name").alias("b"), F.col("grams").alias("y")), "b")

    def check(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = both >= similar * (len(u) + len(v) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        common.release()
    return wide.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(name, root) of every name in `links` (a, b): the smallest name it is connected with.

    Every round looks at each name's neighbours and then at the root of its root, and is stored; it ends when nothing
    changes.
    """
    both = common.stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = common.stored(both.df.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("name")).alias("root")))
    while True:
        near = both.df.join(now.df.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("root").alias("seen"))
        step = now.df.join(near, "name").select("name", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = now.df.select(F.col("name").alias("root"), F.col("root").alias("further"))
        new = common.stored(step.join(jump, "root", "left").select("name", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        now.drop()
        changed = not new.df.filter("old <> root").isEmpty()
        now = new
        if not changed:
            both.drop()
            return now.df.select("name", "root")


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """key, name, root, size and `lead` of the rarest shingles of each set.

    Two sets that reach the similarity share a shingle that is in the prefix of the larger (equal sizes: larger name) one
    and among the `lead` ones of the other, whose prefix is shorter as their union is no smaller than twice its part.
    """
    each = sets.select("name", "root", F.size("grams").alias("size"), F.explode("grams").alias("key"))
    rare = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Shingles of one set only are the rarest: they fill the prefix first, but nothing can meet there.
    kept = each.join(rare, "key").groupBy("name", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    alone = F.col("size") - F.size("keys")

    def most(share: float):
        # Rounded up a little: a prefix that is one too long loses nothing.
        return F.floor(F.col("size") * (1 - share) + 1 + 1e-6).cast("int") - alone

    wide = kept.withColumns({"wide": most(similar), "short": most(2 * similar / (1 + similar))}).filter("wide > 0")
    return wide.select("name", "root", "size", "short", F.posexplode(F.slice("keys", F.lit(1), F.col("wide"))).alias("at", "k")).select(
        F.col("k.key").alias("key"), "name", "root", "size", (F.col("at") < F.col("short")).alias("lead"))


def _with_bits(sets: DataFrame) -> DataFrame:
    """name, the bits that the set's shingles fall on as longs b0, b1 and so on, and `spare`: shingles less bits."""
    names = [f"b{i}" for i in range(BITS // 64)]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flags = np.zeros((len(sizes), BITS), bool)
                flags[np.repeat(np.arange(len(sizes)), sizes), words.mix(part.column(1).flatten().to_numpy().view(np.uint64)) % np.uint64(BITS)] = True
                bits = np.packbits(flags, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes - flags.sum(axis=1)), *map(pa.array, np.ascontiguousarray(bits.T))], ["name", "spare", *names])
        common.release()
    return sets.select("name", "grams").mapInArrow(run, "name long, spare long, " + ", ".join(f"{n} long" for n in names))


def _reachable(similar: float):
    """Whether two sets can reach the similarity: they have at most the bits in common and the spare shingles of one."""
    both = reduce(add, [F.bit_count(F.col(f"x_b{i}").bitwiseAND(F.col(f"y_b{i}"))) for i in range(BITS // 64)])
    return (both + F.least("x_spare", "y_spare")) * (1 + similar) >= (F.col("x_size") + F.col("y_size")) * similar - 1e-6


def _rest(sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of sets with different roots that can reach the similarity (all that do are among them).

    A key with many sets is dealt in pieces: the sets outside its most frequent root meet all sets of the key. Pairs whose
    bits show that they are too different are left out there.
    """
    found = common.stored(_prefixes(sets, similar))
    kinds = found.df.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = kinds.groupBy("key").agg(F.sum("n").alias("all"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    keys = common.stored(keys.select("key", "main", F.ceil(F.col("all") / KEY_SETS).cast("long").alias("parts")))
    mine = common.stored(found.df.join(keys.df, "key").join(_with_bits(sets), "name")).df
    odd = mine.filter("root <> main").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")))
    every = mine.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x, y = (d.select("key", "part", "main", *[F.col(c).alias(f"{side}_{c}") for c in ("name", "root", "size", "lead", "spare", *[f"b{i}" for i in range(BITS // 64)])]) for d, side in ((odd, "x"), (every, "y")))
    smaller = F.struct(F.col("x_size"), F.col("x_name")) < F.struct(F.col("y_size"), F.col("y_name"))
    able = F.least("x_size", "y_size") >= F.greatest("x_size", "y_size") * (similar - 1e-9)
    once = (F.col("y_root") == F.col("main")) | (F.col("x_name") < F.col("y_name"))  # both sets are among the odd ones
    leads = F.when(smaller, F.col("x_lead")).otherwise(F.col("y_lead"))
    pairs = x.drop("main").join(y, ["key", "part"]).filter((F.col("x_root") != F.col("y_root")) & once & able & leads & _reachable(similar))
    return pairs.select(F.least("x_name", "y_name").alias("a"), F.greatest("x_name", "y_name").alias("b")).distinct()


def _whole(near: DataFrame, links: DataFrame, root: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(name, root) as in `root`, after the bands that are in several groups are searched for the pairs without an end."""
    names = near.filter("n > 3").select("band", "key", "name").join(root, "name", "left").select(
        "band", "key", "name", F.coalesce("root", "name").alias("root"))
    names = common.stored(names)
    split = names.df.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "key")
    rest = names.df.join(split, ["band", "key"]).groupBy("name").agg(F.first("root").alias("root"))
    rest = common.stored(rest.join(sets.select("name", "grams"), "name"))
    names.drop()
    if rest.df.isEmpty():
        return root
    more = common.stored(_verified(_rest(rest.df, similar), sets, similar))
    rest.drop()
    return root if more.df.isEmpty() else components(links.unionByName(more.df))


def _members(docs: DataFrame, size: int, similar: float) -> DataFrame:
    """doc_id, text_key and the class (a set's name; null without words) of every row."""
    rows = common.stored(described(docs, size))
    names = rows.df.filter("name IS NOT NULL").dropDuplicates(["name"]).select("name", "bands")
    keyed = common.stored(names.select("name", F.posexplode("bands").alias("band", "key")))
    ends = common.stored(keyed.df.groupBy("band", "key").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high"))
    near = common.stored(keyed.df.join(ends.df, ["band", "key"]))
    keyed.drop()
    ends.drop()
    sets = common.stored(shingles(docs, rows.df.select("doc_id", "text_key", "name"), near.df.select("name").distinct(), size))
    # First one link a set, to the smallest name it shares a band with: that joins most of a large group.
    first = near.df.filter("name <> low").groupBy("name").agg(F.min("low").alias("a")).select("a", F.col("name").alias("b"))
    first = common.stored(_verified(first, sets.df, similar))
    # Then, where a band still holds several groups, each set with the ends of the band that are in other groups.
    rooted = near.df.join(common.stored(components(first.df)).df, "name", "left").withColumn("root", F.coalesce("root", "name"))
    rooted = common.stored(rooted)
    several = rooted.df.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("root", "name").alias("low_root"),
                                                   F.max_by("root", "name").alias("high_root")).filter("r0 < r1").drop("r0", "r1")
    still = rooted.df.join(several, ["band", "key"])
    ends = F.array(F.when(F.col("root") != F.col("low_root"), F.struct(F.col("low").alias("a"), F.col("name").alias("b"))),
                   F.when(F.col("root") != F.col("high_root"), F.struct(F.col("name").alias("a"), F.col("high").alias("b"))))
    pairs = still.select(F.explode(F.array_compact(ends)).alias("p")).select("p.*").distinct()
    links = common.stored(first.df.unionByName(_verified(pairs, sets.df, similar)))
    first.drop()
    rooted.drop()
    root = common.stored(_whole(near.df, links.df, components(links.df), sets.df, similar))
    links.drop()
    sets.drop()
    near.drop()
    return rows.df.select("doc_id", "text_key", "name").join(root.df, "name", "left").select(
        "doc_id", "text_key", F.coalesce("root", "name").alias("class"))


def groups(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, text_key and class_id of every row: the smallest id of its group of near-duplicates (its own id if alone).

    Repeated rows are in one group. A row without words is alone; its class is its id.
    """
    member = _members(docs, size, similar)
    first = member.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return member.join(first, "class", "left").select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The documents without near-duplicates: the row with the smallest id of each group stays, and only once.

    A row without an id counts as last; of different texts with one id the one with the smaller hash stays. All rows
    without words stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    member = common.stored(_members(docs, size, similar).filter("class IS NOT NULL").groupBy("doc_id", "text_key", "class").agg(F.count(F.lit(1)).alias("n")))
    best = member.df.groupBy("class").agg(F.min(order).alias("best"))
    own, n, lost, again, key, id_ = (common.free_name(docs, c) for c in ("own", "n", "lost", "again", "key", "id"))
    marks = member.df.join(best, "class").select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key),
        (~(F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key")))).alias(lost),
        (F.col("n") > 1).alias(again)).filter(F.col(lost) | F.col(again))
    keyed = docs.withColumn(own, common.text_key())
    kept = keyed.join(marks, keyed["doc_id"].eqNullSafe(marks[id_]) & (keyed[own] == marks[key]), "left").filter(F.col(lost).isNull() | ~F.col(lost))
    # Rows that are there several times: the first of each stays.
    once = Window.partitionBy("doc_id", own).orderBy(F.lit(0))
    return kept.withColumn(n, F.row_number().over(once)).filter(F.col(lost).isNull() | (F.col(n) == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])
