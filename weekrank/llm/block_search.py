"""Ranked lexical search: inverted lists per shard of documents, Block-Max MaxScore over whole texts.

A shard is a stretch of documents of about SHARD_BYTES of text. Its index has, for every term, a list of postings
(document, frequency) in blocks of BLOCK: the documents of a block are kept as gaps, the frequencies beside them, both in the
fewest whole bytes that hold the block's largest. With every list stand its largest impact and with every block its last document and
its largest impact. The impact of a posting is the part of its score that does not depend on the query.

A query goes through the shards of a task one by one and keeps its `k` best so far; the score of the last of them is the
threshold. In a shard its lists are put in the order of their bounds. Those that cannot reach the threshold together are not
essential: only documents in an essential list are candidates. A candidate's bound, its score so far and the block maxima of the
lists still to be read, is compared with the threshold before any of their blocks is unpacked. Tasks return `k` rows a query,
and Spark merges them.

Scores are whole numbers (see `weight` and `impacts`), so all orders of adding agree. A null text, or one without terms, is no
document of the collection. Equal scores go to the smaller doc_id, rows without doc_id come last; repeated rows are found
one by one. Items are queries of their own, also repeated ones; a null or empty item, or one whose terms nowhere stand, finds nothing.
Terms are compared by 64-bit hashes. Very long texts are read in pieces cut between words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekrank.llm import common, words

SHARD_BYTES = 16 * 1024 * 1024  # text bytes whose postings are one shard
BLOCK = 128  # postings of a block
QUERY_TERMS = 1 << 20  # query terms that go through the index together
SCALE = 1_000_000_000
_SCHEMA = "shard long, ids binary, terms binary, firsts binary, tops binary, last binary, most binary, at binary, widths binary, data binary"

# --- words ------------------------------------------------------------------------------------------------------------


def term_pieces(texts: pa.Array, most: int = common.PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and hashes of all terms, piece by piece: short texts together, long ones cut between words."""
    data, offsets = common.flat(texts)
    n, text = len(offsets) - 1, 0
    while text < n:
        stop = max(text + 1, int(np.searchsorted(offsets, offsets[text] + most, "right")) - 1)
        low, high = int(offsets[text]), int(offsets[stop])
        while low < high:
            end = high
            if high - low > most:  # a single long text
                end = min(high, low + most)
                breaks = np.flatnonzero(~words.LOWER_WORDS[data[low:end]])
                if len(breaks):
                    end = low + int(breaks[-1]) + 1
                else:  # inside one word: on to its end
                    rest = np.flatnonzero(~words.LOWER_WORDS[data[end:high]])
                    end = end + int(rest[0]) if len(rest) else high
            inner = offsets[text:stop + 1]
            own = np.clip(inner, low, end) - low
            hashes, _, _, at = words.hashed(data[low:end], own, True)
            yield np.repeat(np.arange(text, stop), np.diff(at)), hashes
            low = end
        text = stop


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms with repeats."""
    def count(batches):
        n = total = 0
        for batch in common.cut(batches):
            found = np.zeros(batch.num_rows, np.int64)
            for owner, _ in term_pieces(batch.column(0)):
                found += np.bincount(owner, minlength=len(found))
            n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


# --- scores -----------------------------------------------------------------------------------------------------------


def weight(n: int, df: int) -> int:
    """Weight of a term that stands in `df` of `n` documents."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(terms: np.ndarray, n: int, total: int) -> np.ndarray:
    """The m of documents of so many terms, in a collection of `n` documents and `total` terms."""
    return 75 + (25 * terms * n) // max(total, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 12 * m)


# --- index ------------------------------------------------------------------------------------------------------------


def _packed(values: np.ndarray, blocks: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the bytes a value takes in each block, and the values' bytes, block by block."""
    most = np.zeros(n_blocks, np.int64)
    np.maximum.at(most, blocks, values)
    kind = (most > 0xFF).astype(np.int64) + (most > 0xFFFF)
    size = np.left_shift(1, kind)[blocks]
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for byte in range(4):
        has = size > byte
        out[(ends - size)[has] + byte] = (values[has] >> (8 * byte)) & 0xFF
    return kind, out


class Shard:
    """Inverted lists of some documents; `bytes_of` and `read` turn it into a row and back."""

    @classmethod
    def build(cls, ids: pa.Array, owner: np.ndarray, hashes: np.ndarray, n: int, total: int) -> Shard:
        """From the doc_ids of the texts and (text, hash) of every word."""
        self = cls()
        counts = np.bincount(owner, minlength=len(ids))
        # Documents are numbered by doc_id, so that a smaller number wins a tie.
        by = pa.compute.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        counts = counts[by]
        doc = place[owner]
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], doc[order]
        del order
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        tf = np.diff(np.append(heads, len(h)))
        h, d = h[heads], d[heads]
        impact = impacts(tf, lengths(counts, n, total)[d])
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else heads
        sizes = np.diff(np.append(starts, len(h)))
        n_blocks = -(-sizes // BLOCK)
        self.ids = ids.take(pa.array(by))
        self.counts = counts
        self.terms = h[starts]
        self.firsts = np.concatenate([[0], np.cumsum(n_blocks)]).astype(np.int64)
        within = np.arange(len(h)) - np.repeat(starts, sizes)
        block = np.repeat(self.firsts[:-1], sizes) + within // BLOCK
        opens = np.flatnonzero(within % BLOCK == 0)
        self.begin = np.append(opens, len(h)).astype(np.int64)  # first posting of each block
        self.last = d[self.begin[1:] - 1] if len(opens) else d
        self.most = np.maximum.reduceat(impact, opens) if len(opens) else impact
        self.tops = np.maximum.reduceat(impact, starts) if len(starts) else impact
        gaps = np.diff(d, prepend=0)
        gaps[opens] = d[opens]  # a block can be read without those before it
        self.gap_kind, gap_bytes = _packed(gaps, block, len(opens))
        self.tf_kind, tf_bytes = _packed(tf, block, len(opens))
        self.gaps, self.tfs = gap_bytes, tf_bytes
        return self._ready(n, total)

    def _ready(self, n: int, total: int) -> Shard:
        self.m = lengths(self.counts, n, total)
        size = np.diff(self.begin)
        self.gap_at = np.concatenate([[0], np.cumsum(size << self.gap_kind)])
        self.tf_at = np.concatenate([[0], np.cumsum(size << self.tf_kind)])
        return self

    def row(self, shard: int) -> pa.RecordBatch:
        def raw(x, kind):
            return pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
        ids = pa.BufferOutputStream()
        with pa.ipc.new_stream(ids, pa.schema([("id", self.ids.type), ("n", pa.int64())])) as out:
            out.write_table(pa.table({"id": self.ids, "n": self.counts}))
        columns = [pa.array([shard], pa.int64()), pa.array([ids.getvalue().to_pybytes()], pa.binary()), raw(self.terms, np.uint64), raw(self.firsts, np.int32),
                   raw(self.tops, np.int32), raw(self.last, np.int32), raw(self.most, np.int32), raw(self.begin, np.int32),
                   raw(np.concatenate([self.gap_kind, self.tf_kind]), np.uint8), pa.array([len(self.gaps).to_bytes(8, "little") + self.gaps.tobytes() + self.tfs.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])

    @classmethod
    def read(cls, row: dict, n: int, total: int) -> Shard:
        self = cls()

        def raw(name, kind):
            return np.frombuffer(row[name], kind)
        table = pa.ipc.open_stream(row["ids"]).read_all()
        self.ids, self.counts = table.column("id").combine_chunks(), table.column("n").to_numpy()
        self.terms, self.firsts, self.tops = raw("terms", np.uint64), raw("firsts", np.int32).astype(np.int64), raw("tops", np.int32).astype(np.int64)
        self.last, self.most, self.begin = raw("last", np.int32), raw("most", np.int32).astype(np.int64), raw("at", np.int32).astype(np.int64)
        kinds = raw("widths", np.uint8).astype(np.int64)
        self.gap_kind, self.tf_kind = kinds[:len(self.last)], kinds[len(self.last):]
        data = raw("data", np.uint8)
        size = int.from_bytes(data[:8].tobytes(), "little")
        self.gaps, self.tfs = data[8:8 + size], data[8 + size:]
        return self._ready(n, total)

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some blocks, in order."""
        sizes = self.begin[blocks + 1] - self.begin[blocks]
        starts = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)

        def values(raw, at, kind):
            width = np.repeat(kind[blocks], sizes)
            place = np.repeat(at[blocks], sizes) + (within << width)
            out = raw[place].astype(np.int64)
            for byte in (1, 2, 3):
                has = (1 << width) > byte
                if has.any():
                    out[has] |= raw[place[has] + byte].astype(np.int64) << (8 * byte)
            return out
        gaps = values(self.gaps, self.gap_at, self.gap_kind)
        run = np.cumsum(gaps)
        return run - np.repeat(run[starts] - gaps[starts], sizes) if len(run) else run, values(self.tfs, self.tf_at, self.tf_kind)

    # --- search -------------------------------------------------------------------------------------------------------

    def search(self, hashes: np.ndarray, weights: np.ndarray, k: int, threshold: int, seen: Counts | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores that reach `threshold` and belong to the best `k`: Block-Max MaxScore.

        `weights` hold how often a term stands in the query. Documents of one score are in the order of their numbers.
        """
        none = np.zeros(0, np.int64)
        if not len(self.terms):
            return none, none
        at = np.searchsorted(self.terms, hashes)
        here = (at < len(self.terms)) & (weights > 0)
        here[here] = self.terms[at[here]] == hashes[here]
        lists, w = at[here], weights[here]
        bounds = w * self.tops[lists]
        by = np.argsort(bounds, kind="stable")
        lists, w, bounds = lists[by], w[by], bounds[by]
        below = np.cumsum(bounds)
        if not len(lists) or below[-1] < threshold:
            return none, none
        scores = np.zeros(len(self.counts), np.int64)
        # The lists of the largest bounds are read whole until those left cannot reach the threshold on their own. The
        # threshold rises while they are read: documents read so far have that score at least.
        first = len(lists)
        while first and below[first - 1] >= max(threshold, 1):
            first -= 1
            blocks = np.arange(self.firsts[lists[first]], self.firsts[lists[first] + 1])
            docs, tf = self.unpack(blocks)
            scores[docs] += w[first] * impacts(tf, self.m[docs])
            if seen is not None:
                seen.unpacked += len(blocks)
            if len(scores) >= k and first and len(docs):
                threshold = max(threshold, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        found = np.flatnonzero(scores)
        score = scores[found]
        for i in range(first - 1, -1, -1):
            keep = score + below[i] >= threshold
            found, score = found[keep], score[keep]
            if not len(found):
                break
            low, high = self.firsts[lists[i]], self.firsts[lists[i] + 1]
            block = low + np.searchsorted(self.last[low:high], found)
            inside = block < high
            # The list's bound in a candidate's block; nothing is unpacked yet.
            bound = np.zeros(len(found), np.int64)
            bound[inside] = w[i] * self.most[block[inside]]
            keep = score + bound + (below[i - 1] if i else 0) >= threshold
            found, score, block, inside = found[keep], score[keep], block[keep], inside[keep]
            wanted = np.unique(block[inside])
            if seen is not None:
                seen.unpacked += len(wanted)
                seen.skipped += int(high - low) - len(wanted)
            if not len(wanted):
                continue
            docs, tf = self.unpack(wanted)
            place = np.searchsorted(docs, found)
            place[place == len(docs)] = 0
            hit = docs[place] == found
            score[hit] += w[i] * impacts(tf[place[hit]], self.m[found[hit]])
            if len(score) > k:
                threshold = max(threshold, int(np.partition(score, len(score) - k)[len(score) - k]))
        keep = score >= max(threshold, 1)
        found, score = found[keep], score[keep]
        best = np.lexsort((found, -score))[:k]
        return found[best], score[best]


class Counts:
    """Blocks that a search unpacked and skipped."""

    def __init__(self):
        self.unpacked = self.skipped = 0


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of the whole texts of `docs`, stored in the shared folder."""
    n, total = totals(docs)

    def gather(batches):
        from pyspark import TaskContext

        shard, ids, owners, hashes, size, rows = TaskContext.get().partitionId() << 32, [], [], [], 0, 0

        def out():
            return Shard.build(pa.concat_arrays(ids), np.concatenate([np.zeros(0, np.int64), *owners]), np.concatenate([np.zeros(0, np.uint64), *hashes]), n, total).row(shard)
        for batch in common.cut(batches):
            more = len(common.flat(batch.column(1))[0])
            if rows and size + more > shard_bytes:
                yield out()
                shard, ids, owners, hashes, size, rows = shard + 1, [], [], [], 0, 0
            counts = np.zeros(batch.num_rows, np.int64)
            for owner, found in term_pieces(batch.column(1)):
                counts += np.bincount(owner, minlength=len(counts))
                owners.append(owner + rows)
                hashes.append(found)
            ids.append(batch.column(0))
            size, rows = size + more, rows + batch.num_rows
        if rows:
            yield out()

    return Index(common.stored(docs.select("doc_id", "text").mapInArrow(gather, _SCHEMA)), n, total, docs.schema["doc_id"].dataType.simpleString())


class Index:
    def __init__(self, store: common.Stored, n: int, total: int, kind: str):
        self.store, self.n, self.total, self.kind = store, n, total, kind

    def document_frequencies(self, hashes: np.ndarray) -> np.ndarray:
        """In how many documents each term stands, from the list sizes of all shards."""
        def sizes(batches):
            found = np.zeros(len(hashes), np.int64)
            for batch in batches:
                for terms, firsts, begin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    terms, firsts, begin = np.frombuffer(terms, np.uint64), np.frombuffer(firsts, np.int32), np.frombuffer(begin, np.int32)
                    if len(terms):
                        at = np.searchsorted(terms, hashes)
                        at[at == len(terms)] = 0
                        found += np.where(terms[at] == hashes, begin[firsts[at + 1]] - begin[firsts[at]], 0)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "n"])

        rows = self.store.df.select("terms", "firsts", "at").mapInArrow(sizes, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(len(hashes), np.int64)
        out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        return out

    def search(self, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
        """The `k` best of every query (number, hashes, times): query, doc_id, score. One pass over the index."""
        known = np.unique(np.concatenate([h for _, h, _ in queries])) if queries else np.zeros(0, np.uint64)
        df = self.document_frequencies(known)
        n, total = self.n, self.total
        term_weight = np.array([weight(n, int(x)) if x else 0 for x in df], np.int64)
        weighted = [(number, h, times * term_weight[np.searchsorted(known, h)]) for number, h, times in queries]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]

        def run(batches):
            best: list[tuple[pa.Array, np.ndarray] | None] = [None] * len(weighted)
            for batch in batches:
                for at in range(batch.num_rows):
                    shard = Shard.read({c: batch.column(i)[at].as_buffer() for i, c in enumerate(names) if i}, n, total)
                    for q, (_, hashes, weights) in enumerate(weighted):
                        have = best[q]
                        full = have is not None and len(have[1]) == k
                        docs, scores = shard.search(hashes, weights, k, int(have[1][-1]) if full else 1)
                        if len(docs):
                            best[q] = merged(have, (shard.ids.take(pa.array(docs)), scores), k)
            some = [(number, *have) for (number, _, _), have in zip(weighted, best) if have is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in some], [len(x[2]) for x in some])), pa.concat_arrays([x[1] for x in some]),
                                                  pa.array(np.concatenate([x[2] for x in some]))], ["query", "doc_id", "score"])

        found = self.store.df.mapInArrow(run, f"query long, doc_id {self.kind}, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merged(a, b, k: int):
    """The best `k` of two heaps (ids, scores), ties to the smaller id, null ids last."""
    if a is None:
        return b
    ids, scores = pa.concat_arrays([a[0], b[0]]), np.concatenate([a[1], b[1]])
    by = pa.compute.sort_indices(pa.table({"s": scores, "id": ids}), sort_keys=[("s", "descending"), ("id", "ascending")], null_placement="at_end")[:k]
    return ids.take(by), scores[by.to_numpy()]


# --- items ------------------------------------------------------------------------------------------------------------


def blocks_of(items: DataFrame, most: int = QUERY_TERMS) -> Iterator[list[tuple]]:
    """The items as (item_id, hashes, times), so many at a time that a block has at most `most` terms."""
    def split(batches):
        for batch in batches:
            per_text: list[list] = [[] for _ in range(batch.num_rows)]
            for owner, hashes in term_pieces(batch.column(1)):
                for text in np.unique(owner):
                    per_text[text].append(hashes[owner == text])
            pairs = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in per_text]
            ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in pairs])])
            yield pa.RecordBatch.from_arrays([batch.column(0), common.grouped(np.concatenate([h for h, _ in pairs]).view(np.int64), ends, pa.int64()),
                                              common.grouped(np.concatenate([t for _, t in pairs]), ends, pa.int64())], ["item_id", "terms", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, terms array<long>, times array<long>")
    have, size = [], 0
    for row in rows.filter(F.size("terms") > 0).toLocalIterator():
        if have and size + len(row["terms"]) > most:
            yield have
            have, size = [], 0
        have.append((row["item_id"], np.array(row["terms"], np.int64).view(np.uint64), np.array(row["times"], np.int64)))
        size += len(row["terms"])
    if have:
        yield have


def rank(docs: DataFrame, items: DataFrame, k: int = 20, shard_bytes: int = SHARD_BYTES, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the `k` documents of the highest score for every item.

    Items go through the index in blocks of `query_terms`; a block is what the driver and the tasks hold at a time.
    """
    spark, index, out = docs.sparkSession, build(docs, shard_bytes), None
    item_kind = items.schema["item_id"].dataType.simpleString()
    for block in blocks_of(items, query_terms):
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], f"query long, item_id {item_kind}")
        found = index.search([(i, h, times) for i, (_, h, times) in enumerate(block)], k)
        one = common.stored(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")).df
        out = one if out is None else out.unionAll(one)
    index.store.drop()
    return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {index.kind}, score long") if out is None else out
