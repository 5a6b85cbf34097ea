"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier in the corpus are removed.

The stretches of text that may repeat at all are gathered in shards by their minimiser (see `repeats`), so that equal
strings are in the same shard whatever document they come from. Each shard gets a suffix array by Larsson-Sadakane
refinement and common prefixes by Kasai's rule; suffixes that share 100 bytes are one string, whose earliest place
stays. Suffix positions are assigned to their stretches, and ranges to their documents, by binary search.

A null text counts as empty. Repeated rows (same id and text) do not remove each other; a row without an id counts as
last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weekrank.llm import common, repeats, shards
from weekrank.llm.suffixes import WORD, common_prefixes, packed, suffix_array

LENGTH, GRAM = 100, 32
SHARD_BYTES = 1024 * 1024  # every byte is a unit with a window of its own


def resolve(contents: list, docs: np.ndarray, starts: np.ndarray, grams: np.ndarray, length: int = LENGTH) -> list:
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    order, place = suffix_array(packed(data), WORD)
    shared = common_prefixes(data, order, place, length)
    classes = np.zeros(len(data), np.int64)
    classes[order] = np.cumsum(shared < length)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    stretch = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (ends - sizes)[stretch] + offset
    hit = repeats.earlier_than_own(classes[at], docs[stretch], starts[stretch] + offset)
    cuts = np.searchsorted(stretch[hit], np.arange(len(sizes) + 1))
    found = offset[hit]
    return [found[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]


def _units(length: int) -> repeats.Units:
    return repeats.Units(length, max(1, min(GRAM, length // 3)), False)


def _ranges(docs: DataFrame, length: int):
    store = shards.stored(docs, SHARD_BYTES)
    ranges = repeats.find(store.df, _units(length), lambda *a: resolve(*a, length), True)
    return store, ranges


def cut_out(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray):
    left = np.concatenate([[0], np.cumsum(~mask)])[offsets]
    return data[~mask], left


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    units = _units(length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    store, ranges = _ranges(docs.select("doc_id", "text"), length)

    def clean(table: pa.Table, rows: pa.Table) -> pa.Table:
        _, at, data, *_ = units.read(table)
        mask = repeats.gone(table, rows, units, at)
        before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
        inner = at[:-1][at[:-1] < len(mask)]
        before[inner] = False
        heads = np.concatenate([[0], np.cumsum(mask & ~before)])
        kept, left = cut_out(data, at, mask)
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(at), "n_removed": np.diff(at) - np.diff(left), "n_spans": np.diff(heads[at]),
                         "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept.tobytes())]).cast(pa.binary())})

    return shards.each_with(store.df, ranges.df, clean, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeated bytes cut out of `text`; a character that is only partly repeated stays.

    All rows and columns stay; a null text stays null.
    """
    units = _units(length)
    columns = docs.columns
    store, ranges = _ranges(docs, length)

    def clean(table: pa.Table, rows: pa.Table) -> pa.Table:
        _, at, data, *_ = units.read(table)
        mask = repeats.gone(table, rows, units, at)
        letter = np.cumsum((data & 0xC0) != 0x80)  # a character goes only as a whole
        if len(data):
            whole = np.bincount(letter, weights=~mask)[letter] == 0
            mask = mask & whole
        kept, left = cut_out(data, at, mask)
        text = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept.tobytes())).cast(pa.string())
        old = shards.texts_of(table)
        if old.null_count:
            text = pa.array([None if o is None else t for o, t in zip(old.to_pylist(), text.to_pylist())], pa.string())
        return table.set_column(columns.index("text"), "text", text)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return shards.each_with(store.df, ranges.df, clean, fields)
