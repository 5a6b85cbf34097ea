"""Benchmark decontamination: an FM-index per training shard, searched backwards for all test phrases.

A shard is a piece of the documents that a task reads (about 8 MB of text). Its index holds only stretches of words
that the test phrases use at all, as no other word can be part of an occurrence; an unused word ends a stretch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank.llm import common, words
from weekrank.llm.suffixes import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 * 1024 * 1024  # of test texts that are searched in one pass over the documents
SHARD_BYTES = 8 * 1024 * 1024

COLUMNS = "n_words long, spans array<struct<first: long, last: long>>, items array<string>"


@dataclass
class Phrases:
    """Distinct windows of the test items: symbols (right-aligned), lengths, and their items in rows."""

    vocabulary: np.ndarray  # sorted word hashes; symbol i + 1 is vocabulary[i]
    windows: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list


def phrases_of(ids: list, texts: list, window: int = WINDOW) -> Phrases:
    """Windows of `window` consecutive words; an item of fewer words is one window, an item of none has none."""
    data, offsets = common.flat(pa.array(texts, pa.string()))
    hashes, _, _, at = words.hashed(data, offsets, True)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    names, rows, lengths, owners = sorted(set(ids)), [], [], []
    number = {name: i for i, name in enumerate(names)}
    for i, name in enumerate(ids):
        own = symbols[at[i]:at[i + 1]] + 1
        size = min(window, len(own))
        if size:
            part = np.lib.stride_tricks.sliding_window_view(own, size)
            rows.append(np.pad(part, ((0, 0), (window - size, 0))))
            lengths.append(np.full(len(part), size))
            owners.append(np.full(len(part), number[name]))
    if not rows:
        none = np.zeros(0, np.int64)
        return Phrases(vocabulary, np.zeros((0, window), np.int64), none, np.zeros(1, np.int64), none, names)
    windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
    item_at = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
    return Phrases(vocabulary, windows, (windows > 0).sum(axis=1), item_at, pairs[:, 1], names)


def search_shard(texts: pa.Array, phrases: Phrases):
    """Byte spans of the words, word offsets of the texts, mask of hit words, and (text, item) pairs."""
    data, offsets = common.flat(texts)
    hashes, starts, ends, at = words.hashed(data, offsets, True)
    hit, pairs = np.zeros(len(hashes), bool), np.zeros((0, 2), np.int64)
    if not len(hashes) or not len(phrases.windows):
        return data, starts, ends, offsets, at, hit, pairs
    vocabulary = phrases.vocabulary
    found = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[found] == hashes)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.ones(len(known), bool)  # a stretch ends at an unused word and at the end of a text
    new[1:] = (np.diff(known) > 1) | (np.diff(text_of[known]) > 0)
    stretch = np.cumsum(new) - 1
    sizes = np.bincount(stretch) if len(known) else np.zeros(0, np.int64)
    keep = sizes[stretch] >= phrases.lengths.min() if len(known) else np.zeros(0, bool)
    known, stretch = known[keep], stretch[keep]
    if not len(known):
        return data, starts, ends, offsets, at, hit, pairs
    place = np.arange(len(known)) + np.unique(stretch, return_inverse=True)[1]  # one gap symbol between stretches
    gap = len(vocabulary) + 1
    text, back = np.full(place[-1] + 1, gap), np.zeros(place[-1] + 1, np.int64)
    text[place], back[place] = found[known] + 1, known
    index = FMIndex(text, gap)
    which, low, high = index.search(phrases.windows, phrases.lengths)
    word = back[index.locate(low, high)]
    which = np.repeat(which, high - low)
    hit = words.covered(len(hashes), word, word + phrases.lengths[which])
    owner = np.unique(np.stack([text_of[word], which], axis=1), axis=0)
    counts = phrases.item_at[owner[:, 1] + 1] - phrases.item_at[owner[:, 1]]
    first = np.repeat(phrases.item_at[owner[:, 1]] - np.cumsum(counts) + counts, counts)
    item = phrases.items[first + np.arange(counts.sum())]
    pairs = np.unique(np.stack([np.repeat(owner[:, 0], counts), item], axis=1), axis=0)
    return data, starts, ends, offsets, at, hit, pairs


def hit_runs(hit: np.ndarray, at: np.ndarray):
    """Runs of hit words inside each text: word starts, word ends and the text of each run."""
    bounds = np.zeros(len(hit) + 1, bool)
    bounds[at] = True
    before = np.concatenate([[False], hit[:-1]]) & ~bounds[:-1] if len(hit) else hit
    after = np.concatenate([hit[1:], [False]]) & ~bounds[1:] if len(hit) else hit
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    return first, last, np.searchsorted(at, first, "right") - 1


def _answers(found, phrases: Phrases) -> list[pa.Array]:
    _, _, _, _, at, hit, pairs = found
    first, last, text = hit_runs(hit, at)
    ends = np.searchsorted(text, np.arange(len(at)))
    spans = pa.StructArray.from_arrays([pa.array(first - at[text]), pa.array(last - at[text])], ["first", "last"])
    names = pa.array(phrases.names, pa.string()).take(pa.array(pairs[:, 1]))
    item_ends = np.searchsorted(pairs[:, 0], np.arange(len(at)))
    return [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
            pa.ListArray.from_arrays(pa.array(item_ends, pa.int32()), names)]


def without_hits(found) -> pa.Array:
    """The texts without the bytes from the first to the last word of each hit run."""
    data, starts, ends, offsets, at, hit, _ = found
    first, last, _ = hit_runs(hit, at)
    gone = words.covered(len(data), starts[first], ends[last - 1])
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(left), pa.py_buffer(data[~gone].tobytes())).cast(pa.string())


def blocks_of(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text",
              block_bytes: int = BLOCK_BYTES):
    """The test items as `Phrases`, in blocks of a bounded size, one after the other."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).dropna()
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == k).toPandas()
        yield phrases_of(part["item"].tolist(), part["text"].tolist(), window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_key, n_words, hit spans (first and last + 1 word) and the sorted items found in each document.

    A null or empty text has no words. Items with a null id or text take no part; repeated items count once.
    Repeated rows give repeated results. All documents are searched for all items; a test set of more than
    `block_bytes` is searched in several passes, whose spans are merged.
    """
    docs = docs.select("doc_id", common.text_key().alias("text_key"), "text")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, {COLUMNS}"

    def one(phrases: Phrases):
        def search(batches):
            for batch in common.cut(batches, most=SHARD_BYTES):
                found = search_shard(batch.column(2), phrases)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_answers(found, phrases)],
                                                 ["doc_id", "text_key", "n_words", "spans", "items"])
                del found
            common.release()
        return docs.mapInArrow(search, out)

    passes = [one(phrases) for phrases in blocks_of(benchmark, window, block_bytes=block_bytes)]
    if len(passes) == 1:
        return passes[0]
    # A row that is there k times comes k times from every pass.
    both = passes[0]
    for more in passes[1:]:
        both = both.unionByName(more)
    merged = both.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / len(passes)).cast("int").alias("times"),
        F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = F.aggregate("spans", F.slice("spans", 1, 0), lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"),
            F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(done, F.array(x))))
    return merged.withColumn("spans", F.when(F.size("spans") > 0, joined).otherwise(F.col("spans"))).select(
        "doc_id", "text_key", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "times")).alias("_")).drop("_")


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every hit stretch cut out of `text`; all other columns and rows stay.

    All texts are judged as they came in: passes over the blocks of a large test set only mark runs of words, and the last
    one cuts all of them.
    """
    columns, at, marks = docs.columns, docs.columns.index("text"), "runs"
    while marks in columns:
        marks += "_"
    schema = docs.schema
    passes = list(blocks_of(benchmark, window, block_bytes=block_bytes))
    for number, phrases in enumerate(passes, 1):
        def marked(batch, phrases=phrases, known=number > 1, last=number == len(passes)):
            data, starts, ends, offsets, words_at, hit, pairs = search_shard(batch.column(at), phrases)
            if known:
                lists = batch.column(len(columns))
                base = np.repeat(words_at[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
                bounds = (lists.flatten().to_numpy(zero_copy_only=False) + base).reshape(-1, 2)
                hit = hit | words.covered(len(hit), bounds[:, 0], bounds[:, 1])
            parts = [batch.column(i) for i in range(len(columns))]
            if last:
                cut = without_hits((data, starts, ends, offsets, words_at, hit, pairs))
                parts[at] = pa.array([None if x is None else y for x, y in zip(parts[at].to_pylist(), cut.to_pylist())], pa.string()) if parts[at].null_count else cut
                return pa.RecordBatch.from_arrays(parts, columns)
            first, stop, text = hit_runs(hit, words_at)
            runs = np.stack([first - words_at[text], stop - words_at[text]], axis=1).ravel()
            return pa.RecordBatch.from_arrays([*parts, common.grouped(runs, 2 * np.searchsorted(text, np.arange(len(words_at))), pa.int64())], [*columns, marks])

        def search(batches, marked=marked):
            for batch in common.cut(batches, "text", SHARD_BYTES):
                yield marked(batch)
            common.release()
        docs = docs.mapInArrow(search, schema if number == len(passes) else T.StructType([*schema.fields, T.StructField(marks, T.ArrayType(T.LongType()))]))
    return docs
