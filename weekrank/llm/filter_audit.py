"""Audit of a chain of filters: what each removes, misses and hides, in every order of the filters.

Every document fails some of the filters; that set is its mask. Documents are counted by part and mask, so that what is
left for the orders is at most 32 masks a part, however many documents there are. For these, the step at which a
mask's documents go is a min-plus product: a mask matrix (0 where a filter fails, infinite elsewhere) and the positions of the
filters in every order (the inverse permutations) are added and the minimum taken over the filters. Kept, removed and
redundant counts are scattered by that step, weighted by the documents behind the mask.

The filters are those of `FILTERS`. A null text counts as empty, a null part as the empty string. A document is a repeat if a
smaller doc_id has the same text; a row without doc_id neither is one nor makes another row one, and rows that repeat a
doc_id are judged one by one. Labels are joined by doc_id; of several the largest counts. An empty table gives no rows.
Words are compared by 64-bit and texts by 128-bit hashes.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank.llm import common, words

# The filters and their thresholds.
FILTERS = "ABCDE"  # short, repetitive, capitals, symbols, repeated text
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # per cent of the words
MOST_CAPITALS = 5  # per cent of the code points
SYMBOLS = "#$%&*|"

A, B, C, D, E = (1 << i for i in range(len(FILTERS)))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[ord("A"):ord("Z") + 1] = True


def text_masks(texts: pa.Array) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits."""
    data, offsets = common.flat(texts)
    hashes, _, _, at = words.hashed(data, offsets, False)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((hashes, owner))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    distinct = np.bincount(owner[by][new], minlength=len(n))

    def per_text(marks):
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    points = per_text((data & 0xC0) != 0x80)
    return (A * (n < LEAST_WORDS) + B * (100 * distinct < LEAST_DISTINCT * n) + C * (100 * per_text(_IS_CAPITAL[data]) > MOST_CAPITALS * points)
            + D * (per_text(_IS_SYMBOL[data]) > 0)).astype(np.int32)


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, h (hash of the text) and the mask of the filters A to D of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("h"), text.alias("text"))

    def judge(batches):
        for batch in common.cut(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(text_masks(batch.column(3)))], ["doc_id", "part", "h", "mask"])

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, h binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good and toxic: documents by part and full mask, and those labelled good and toxic among them."""
    # Rows without an id would all meet in one task: they carry a number of their own that no label has.
    kind = docs.schema["doc_id"].dataType
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).cast("long")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast(kind).alias("id"), F.lit(0).cast("long").alias("alone")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("bad"))
    joined = masked(docs, part).withColumns({"alone": own, "id": F.coalesce("doc_id", F.lit(0).cast(kind))}).join(marks, ["id", "alone"], "left")
    no = F.lit(False)
    grouped = joined.groupBy("id", "alone", "h", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("bad", no).alias("bad"))
    rows = common.stored(grouped.agg(F.count(F.lit(1)).alias("n")).withColumn("doc_id", F.when(F.col("alone") == 0, F.col("id"))).drop("id", "alone"))
    known = rows.df.filter("doc_id IS NOT NULL")
    # The first documents of every text are not repeats. All others are: counted as all rows less the first ones.
    least = known.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    first = known.join(least, ["h", "doc_id"]).drop("h")
    keys = ["part", "mask", "good", "bad", "n"]
    repeat = (F.col("mask").bitwiseOR(F.lit(E))).alias("mask")
    signed = (known.select("part", repeat, "good", "bad", "n")
              .unionAll(first.select("part", repeat, "good", "bad", (-F.col("n")).alias("n")))
              .unionAll(first.select(*keys)).unionAll(rows.df.filter("doc_id IS NULL").select(*keys)))
    return signed.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                              F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic")).filter("n > 0")


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product: the step at which each mask's documents go in each order; one more than there are filters if never."""
    fails = (masks[:, None] >> np.arange(positions.shape[1])) & 1
    never = positions.shape[1] + 1
    penalty = np.where(fails == 1, 0, never)
    return np.minimum((penalty[:, None, :] + positions[None, :, :]).min(axis=2), never)


def positions(orders: list[str] = ORDERS, filters: str = FILTERS) -> np.ndarray:
    """Step, from 1, of every filter in every order."""
    return np.array([[order.index(f) + 1 for f in filters] for order in orders])


def scattered(masks: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The COUNTS of every order and step: masks (m), weights (m, 3: all, good, toxic), places (orders, filters)."""
    orders, steps = places.shape
    at = removal_steps(masks, places)  # masks x orders
    inverse = np.argsort(places, axis=1)  # the filter at each step
    gone = np.zeros((orders, steps + 2, weights.shape[1]), np.int64)
    for k in range(weights.shape[1]):
        np.add.at(gone[:, :, k], (np.arange(orders)[None, :], at), weights[:, k][:, None])
    removed = gone[:, 1:steps + 1, :]
    kept = weights[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=1)
    fails = ((masks[:, None] >> np.arange(steps)) & 1).astype(np.int64)
    own = fails[:, inverse]  # masks x orders x steps
    redundant = np.einsum("mos,m->os", own * (at[:, :, None] < np.arange(1, steps + 1)), weights[:, 0])
    unique = ((fails.sum(axis=1) == 1)[:, None] * fails * weights[:, :1]).sum(axis=0)[inverse]
    by_filter = np.zeros(steps, np.int64)
    np.add.at(by_filter, inverse, removed[:, :, 0])
    return np.stack([kept, removed[:, :, 0], redundant, unique, removed[:, :, 1], removed[:, :, 2], by_filter[inverse]], axis=2)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the COUNTS: one row for every part, order of the filters and step."""
    counts = mask_counts(docs, labels, part)
    # At most one row a mask: a part is a bounded group.
    parts = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("masks"))
    orders, places = ORDERS, positions()

    def expand(batches):
        steps = places.shape[1]
        for batch in batches:
            for one, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                masks = np.array([r["mask"] for r in rows])
                found = scattered(masks, np.array([[r["n"], r["good"], r["toxic"]] for r in rows], np.int64), places).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(found), pa.string()), pa.array(np.repeat(orders, steps).tolist(), pa.string()),
                     pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))), *[pa.array(found[:, k]) for k in range(len(COUNTS))]],
                    ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
