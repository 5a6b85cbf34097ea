"""Substring dedup with repeated-phrase automata: words in a 50-word window that starts in an earlier document go.

Candidates come from minimisers (see `repeats`). In each group of grams the windows that stand in stretches of more
than one document are confirmed as recurring passages and compiled into Aho-Corasick automata over word numbers; all
stretches of all documents that share these grams stream through the automaton of their group, which names every
occurrence of every passage. The earliest document of a passage keeps it.

A null text has no words. Repeated rows (same id) do not remove each other; a row without an id counts as last.
"""

from __future__ import annotations


import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weekrank.llm import common, repeats, shards, words

WINDOW, GRAM = 50, 20
PACK = 2_000  # stretches, or those of one gram, behind one automaton


def resolve(contents: list, docs: np.ndarray, starts: np.ndarray, grams: np.ndarray, window: int = WINDOW) -> list:
    out = [[] for _ in contents]
    by = np.argsort(grams, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(grams[by]) != 0])) if len(by) else by
    packs, part = [], []
    for group in np.split(by, heads[1:]):
        if part and len(part) + len(group) > PACK:
            packs.append(part)
            part = []
        part.extend(group.tolist())
    if part:
        packs.append(part)
    for pack in packs:
        texts, number = [], {}
        for i in pack:
            texts.append(tuple(number.setdefault(w, len(number)) for w in contents[i].split()))
        lowest: dict = {}
        recurring = set()
        for i, text in zip(pack, texts):
            for at in range(len(text) - window + 1):
                key = text[at:at + window]
                doc = int(docs[i])
                had = lowest.get(key)
                if had is None:
                    lowest[key] = doc
                elif had != doc:
                    recurring.add(key)
                    lowest[key] = min(had, doc)
        if not recurring:
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in recurring:
            automaton.add_word(key, lowest[key])
        automaton.make_automaton()
        for i, text in zip(pack, texts):
            doc = int(docs[i])
            out[i] = [end - window + 1 for end, first in automaton.iter(text) if first < doc]
    return out




def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every document."""
    units = repeats.Units(window, max(1, min(GRAM, window // 2)), True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    store = shards.stored(docs.select("doc_id", "text"))
    ranges = repeats.find(store.df, units, lambda *a: resolve(*a, window), False)

    def clean(table: pa.Table, rows: pa.Table) -> pa.Table:
        _, at, data, starts, ends = units.read(table)
        mask = repeats.gone(table, rows, units, at)
        kept, bounds = [], at.tolist()
        for low, high in zip(bounds[:-1], bounds[1:]):
            live = np.flatnonzero(~mask[low:high]) + low
            kept.append(b" ".join(data[a:b].tobytes() for a, b in zip(starts[live].tolist(), ends[live].tolist())).decode())
        removed = np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
        return pa.table({"doc_id": table.column("doc_id"), "n_words": np.diff(at), "n_removed": removed, "kept": pa.array(kept, pa.string())})

    return shards.each_with(store.df, ranges.df, clean, f"doc_id {kind}, n_words long, n_removed long, kept string")
