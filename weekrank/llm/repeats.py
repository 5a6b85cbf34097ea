"""Windows of text units (bytes or words) that occur again, found over shards of documents.

1. Every window has a minimiser, a short gram at a place that depends on nothing but the window. Grams that occur
   once cannot belong to a repeated window; their windows go no further.
2. Consecutive windows with one minimiser form a stretch. Equal stretches are one row with the earliest place, its
   owner: at every later place all its windows are repeats.
3. Different stretches with the same gram may still share windows. Their bytes are read from the shards of their owners
   and meet in a group of grams (by hash), where
   `resolve` finds which windows of the owner's place occur earlier elsewhere. A gram with more than HOT_STRETCHES of
   them is not gathered: its windows are dealt by their own hash, and the earliest place of each is taken in Spark.
4. The repeated ranges go back to the shards of their documents.

A document without an id counts as later than all others. Rows with the same id are one document: none of them is
earlier than the other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank.llm import common, shards, words
from weekrank.operators import joins

LAST = np.iinfo(np.int64).max
GROUP_BYTES = 512 * 1024  # about as many bytes of different stretches are resolved together
HOT_STRETCHES = 2_000  # different stretches of one gram that one task takes at most


class Units:
    """How a text is cut: `values` of all units, offsets of the texts, and the bytes of each unit range."""

    def __init__(self, window: int, gram: int, in_words: bool):
        self.window, self.gram, self.in_words = window, gram, in_words

    def read(self, table: pa.Table):
        data, offsets = common.flat(shards.texts_of(table))
        if not self.in_words:
            return data, offsets, data, None, None
        values, starts, ends, at = words.hashed(data, offsets, False)
        return values, at, data, starts, ends

    def contents(self, table: pa.Table, row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> list[bytes]:
        """The bytes of the stretches of so many windows from `start` on, in units of the text in `row`."""
        data, at = common.flat(shards.texts_of(table))
        starts = None
        if self.in_words:
            starts, ends, at = words.spans(data, at, words.BLANK_WORDS)
        first = at[row] + start
        stop = first + windows + self.window - 1
        low, high = (first, stop) if starts is None else (starts[first], ends[stop - 1])
        return [data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())]

    def stretches(self, values: np.ndarray, at: np.ndarray):
        """First and last window start of each stretch, and the hash of its gram."""
        if len(values) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        positions, hashes = words.grams(values, at, self.gram)
        first, last, chosen = words.runs(*words.anchors(hashes, positions, at, self.gram, self.window))
        return first, last, hashes[chosen]


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy().astype(np.int64)


def _hot_ranges(owners: DataFrame, units: Units, by_start: bool):
    """(h, k, earlier) as from `resolve`, for stretches of hot grams: each window meets its equals by its hash only."""
    def windows_of(batches):
        for batch in batches:
            data, offsets = common.flat(batch.column("content").cast(pa.large_binary()).view(pa.large_string()))
            values, at = (data, offsets) if not units.in_words else words.hashed(data, offsets, False)[::3]
            counts = np.maximum(np.diff(at) - units.window + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), counts)
            o = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            first = at[row] + o
            x, y = (words.window_hashes(values, first, first + units.window, base).view(np.int64) for base in (words.BASE, words.GRAM))
            h, k, doc, start = (batch.column(c).to_numpy()[row] for c in ("h", "k", "own_doc", "own_start"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, k, x, y, doc, start + o if by_start else np.zeros(len(o), np.int64), o.astype(np.int32))],
                                             ["h", "k", "x", "y", "doc", "start", "o"])

    every = common.stored(owners.select("h", "k", "own_doc", "own_start", "content").mapInArrow(
        windows_of, "h long, k long, x long, y long, doc long, start long, o int"))
    first = every.df.groupBy("h", "x", "y").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = common.stored(first)
    # Windows that are there once stay where they are: a bitmap of the others tells them apart before the join.
    keys = ["h", "x", "y"]
    some = common.with_bit(every.df, common.bitmap(first.df, keys, common.BITS), keys, common.BITS, "again").filter("again").drop("again")
    later = joins.spread_join(some, first.df.select("h", "x", "y", "first"), keys, spread_by=["k", "o"],
                              counts=first.df.select("h", "x", "y", "n"), how="inner").filter(F.struct("doc", "start") > F.col("first"))
    out = common.stored(later.groupBy("h", "k").agg(F.sort_array(F.collect_list("o")).alias("earlier")))
    every.drop()
    first.drop()
    return out


def find(store: DataFrame, units: Units, resolve, by_start: bool) -> common.Stored:
    """Stored (shard, row, first, last): ranges of window starts, in units of their text, that are repeats.

    `resolve(contents, docs, starts, grams)` gets different stretches (bytes), the document and start of their owner,
    and returns for each the window offsets that occur earlier elsewhere. With `by_start` a place earlier in the same
    document is earlier too.
    """
    def grams_of(shard, table):
        values, at, *_ = units.read(table)
        _, _, h = units.stretches(values, at)
        keys, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2), pa.int32()),
                                          pa.array(np.full(len(keys), shard), pa.int64())], ["h", "n", "shard"])

    seen = common.stored(shards.each(store, grams_of, "h long, n int, shard long"))
    again = seen.df.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    known = common.stored(seen.df.select("h", "shard").join(again, "h"))
    seen.drop()

    def stretches_of(table: pa.Table, rows: pa.Table) -> pa.Table:
        values, at, *_ = units.read(table)
        first, last, h = units.stretches(values, at)
        keep = np.isin(h.view(np.int64), rows.column("h").to_numpy())
        first, last, h = first[keep], last[keep], h[keep]
        row = np.searchsorted(at, first, "right") - 1
        k = words.window_hashes(values, first, last + units.window, words.BASE)  # with the gram's hash: 128 bits
        shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
        return pa.table({"h": h.view(np.int64), "k": k.view(np.int64), "doc": ids_of(table)[row], "start": first - at[row],
                         "windows": (last - first + 1).astype(np.int32), "shard": np.full(len(h), shard, np.int64), "row": row.astype(np.int32)})

    found = common.stored(shards.each_with(store, known.df, stretches_of, "h long, k long, doc long, start long, windows int, shard long, row int"))
    known.drop()
    leads = found.df.groupBy("h", "k").agg(F.min(F.struct("doc", "start", "shard", "row", "windows")).alias("own"))
    owners = common.stored(leads.select("h", "k", F.col("own.doc").alias("own_doc"), F.col("own.start").alias("own_start"), "own.shard", "own.row", "own.windows"))
    several = owners.df.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = common.stored(several.withColumn("hot", F.col("n") > HOT_STRETCHES))
    # Hot grams go by content, so that none of them is in one task; their counts cut the join too.
    shared = joins.spread_join(owners.df, several.df.select("h", "hot"), ["h"], spread_by=["k"], counts=several.df.select("h", "n"), how="inner")

    def contents_of(table: pa.Table, rows: pa.Table) -> pa.Table:
        content = units.contents(table, *[rows.column(c).to_numpy() for c in ("row", "own_start", "windows")])
        return rows.select(["h", "k", "own_doc", "own_start", "hot"]).append_column("content", pa.array(content, pa.binary()))

    # Bytes are read only now, of the owners that have something to be compared with.
    shared = common.stored(shards.each_with(store, shared, contents_of, "h long, k long, own_doc long, own_start long, hot boolean, content binary"))
    hot = None if several.df.filter("hot").isEmpty() else _hot_ranges(shared.df.filter("hot"), units, by_start)
    size = shared.df.filter("NOT hot").agg(F.sum(F.octet_length("content"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))

    def resolved(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        contents = table.column("content").to_pylist()
        ranges = resolve(contents, table.column("own_doc").to_numpy(), table.column("own_start").to_numpy(), table.column("h").to_numpy())
        common.release()
        return pa.table({"h": table.column("h"), "k": table.column("k"), "earlier": pa.array(ranges, pa.list_(pa.int32()))})

    partly = common.stored(shared.df.filter("NOT hot").drop("hot").groupBy(F.pmod("h", F.lit(groups)).alias("g")).applyInArrow(
        resolved, "h long, k long, earlier array<int>").filter(F.size("earlier") > 0))
    own = F.col("doc") == F.col("own_doc")
    if by_start:
        own = own & (F.col("start") == F.col("own_start"))
    found_earlier = partly.df if hot is None else partly.df.unionByName(hot.df)
    owner = owners.df.select("h", "k", "own_doc", "own_start").join(found_earlier, ["h", "k"], "left")
    rows = found.df.join(owner, ["h", "k"])
    start = F.col("start")
    ranges = F.when(own, F.transform("earlier", lambda o: F.struct((start + o).alias("first"), (start + o).alias("last")))).otherwise(
        F.array(F.struct(start.alias("first"), (start + F.col("windows") - 1).alias("last"))))
    out = common.stored(rows.select("shard", "row", F.explode(ranges).alias("r")).select("shard", "row", "r.first", "r.last"))
    partly.drop()
    shared.drop()
    if hot is not None:
        hot.drop()
    several.drop()
    owners.drop()
    found.drop()
    return out


def gone(table: pa.Table, rows: pa.Table, units: Units, at: np.ndarray) -> np.ndarray:
    """Mask of the units that lie in a repeated window."""
    base = at[rows.column("row").to_numpy()]
    return words.covered(int(at[-1]), base + rows.column("first").to_numpy(), base + rows.column("last").to_numpy() + units.window)


def earlier_than_own(classes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each window, whether another one of its class is at an earlier (document, start)."""
    by = np.lexsort((start, doc, classes))
    c, d, s = classes[by], doc[by], start[by]
    head = np.ones(len(by), bool)
    head[1:] = c[1:] != c[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    out = np.zeros(len(by), bool)
    out[by] = (d != d[lead]) | (s != s[lead])
    return out
