"""BPE encoding and decoding by way of a table of distinct words.

Texts are split into words shard by shard; a shard keeps its distinct words and, for every place, the number of the word there. The
distinct words of the corpus are counted over all shards and each is encoded once. Their ids go back to the shards by a join:
the words of the most shards, at most COMMON of them, as a table that every task holds, all others by shuffling
(word, shard, number) rows. Both ways give the same ids; the first keeps a word that stands in every shard from
being one row for each of them. Each shard then puts the ids where its words stand. Decoding joins ids to the piece table by id inside
the tasks, which hold that table: it is as large as the vocabulary, whatever the texts.

A null text counts as empty and has no ids. Rows are encoded one by one, also repeated ones. A text of any length is one
row of one shard; shards are of a bounded size unless a text alone is larger.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from weekrank.llm import common, shards

SHARD_BYTES = 4 * 1024 * 1024  # text bytes whose distinct words are listed together
COMMON, LONG = shards.COMMON, shards.LONG
LISTED = 1 << 18  # distinct words that a task counts before it hands them on
IDS_AT_ONCE = 1 << 21  # ids that are decoded together
PLAIN = r"\x00-ɏЀ-џ‐-‧€"  # signs that every version of the character tables classes alike


def _written_out(pattern: str) -> re.Pattern | None:
    """The pattern for texts of PLAIN signs with its classes written out as signs, for the faster `re`; None if that cannot be done."""
    if regex.search(r"\\[pP]|\\s", regex.sub(r"\[[^\]]*\]", "", pattern)):  # a class outside of brackets
        return None
    signs = [s for s in map(chr, range(0x20AD)) if regex.fullmatch(f"[{PLAIN}]", s)]

    def written(found) -> str:
        return "".join(re.escape(s) for s in signs if regex.fullmatch(found[0], s))
    return re.compile(regex.sub(r"\\p\{\w+\}|\\s", written, pattern))


class Splitter:
    """Words of a text as the tokenizer sees them; its special tokens are words of their own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.full = Tokenizer.from_file(path)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(re.escape(t) for t in specials) + ")") if specials else None
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Other texts are split by the library.
        self.plain = re.compile(f"[{PLAIN}]*")
        self.quick = _written_out(pattern) or self.pattern

    def words(self, text: str) -> list[str]:
        if self.special and "<" in text and self.special.search(text):
            return [w for part in self.special.split(text) for w in ([part] if part in self.specials else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        low = text.lower()
        # Composing changes nothing in a text of plain signs, and blanks are left out whichever they are.
        if text.isascii() or self.plain.fullmatch(text) and self.plain.fullmatch(low):
            return self.quick.findall(low)
        text = self.full.normalizer.normalize_str(text)
        if self.plain.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.full.pre_tokenizer.pre_tokenize_str(text)]


class WordEncoder:
    """Ids of single words that are already split off and normalised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = spec["pre_tokenizer"]["pretokenizers"][1]
        model = {name: value for name, value in spec["model"].items() if name != "type" and value is not None}
        model["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        spec["model"] = {"type": "BPE", "vocab": {}, "merges": []}
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        # No word comes twice, and the cache of a tokenizer outlives it: a worker would gather one from every task.
        self.tokenizer.model = models.BPE(**model, cache_capacity=0)

    def ids(self, some: list[str]) -> list[list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return [[self.specials[w]] if w in self.specials else i for w, i in zip(some, found)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def forget() -> None:
    """Drop the vocabularies that a worker holds, at the end of a task."""
    for held in (splitter, encoder, _common, _common_ids):
        held.cache_clear()
    common.release()


def word_table(lists: DataFrame, path: str) -> DataFrame:
    """word, n (shards that hold it) and ids of every distinct word; `lists` holds the word lists of the shards."""
    def count(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[str] = Counter()
        for batch in batches:
            for blob in batch.column(0):
                seen.update(shards.unpack(blob).column("word").to_pylist())
                if len(seen) > LISTED:
                    yield out()
                    seen = Counter()
        yield out()
        seen = Counter()
        common.release()

    def once(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoder(path).ids(batch.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "n", "ids"])
        forget()

    counted = lists.select("words").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(once, "word string, n long, ids array<int>")


def common_words(table: DataFrame, most: int = COMMON) -> DataFrame:
    """The words of the highest classes of counts that have at most `most` words together."""
    return shards.common_words(table, "ids", most)


def encode(docs: DataFrame, path: str, most_common: int = COMMON, table: DataFrame | None = None) -> DataFrame:
    """doc_id and the ids of the whole text, for every row of `docs`; with a piece `table` also `decoded`, as from `decode`.

    Decoding here spares a second Python worker per task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named, most = None if table is None else Pieces(table), SHARD_BYTES
    def split(shard, table):
        slots: dict[str, int] = {}
        parts, counts = [], []
        for text in shards.texts_of(table).to_pylist():
            found = splitter(path).words(text) if text else []
            parts.append(np.fromiter((slots.setdefault(w, len(slots)) for w in found), np.int32, len(found)))
            counts.append(len(found))
        slot = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # Frequent words get small numbers, which pack well.
        by = np.argsort(-np.bincount(slot, minlength=len(slots)), kind="stable")
        rank = np.empty(len(slots), np.int32)
        rank[by] = np.arange(len(slots), dtype=np.int32)
        words = pa.array(list(slots), pa.string()).take(pa.array(by))
        texts = shards.pack(pa.table({"doc_id": table.column("doc_id"), "n": pa.array(counts, pa.int64())}))
        yield pa.RecordBatch.from_arrays([pa.array([shard] * 2), pa.array([shards.pack(pa.table({"word": words})), None], pa.binary()), pa.array([None, texts], pa.binary()),
                                          pa.array([None, shards.planes(rank[slot] if len(slot) else slot)], pa.binary()), pa.array([True, False])],
                                         ["shard", "words", "texts", "places", "listed"])

    def every(batches):
        for shard, table in shards.tables(batches, most):
            yield from split(shard, table.combine_chunks())
        common.release()

    # Written once: all that follows reads the shards as they were numbered here.
    cut = common.stored(docs.select("doc_id", "text").mapInArrow(every, "shard long, words binary, texts binary, places binary, listed boolean"), "listed")
    lists = cut.df.filter("listed").select("shard", "words")
    words_of = common.stored(word_table(lists, path))
    known = common_words(words_of.df, most_common).toArrow().sort_by("word").combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(shards.pack(known))

    def rare(batches):
        """The words of a shard that are not common, row by row, and once a shard where its common words stand in their table."""
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = shards.unpack(blob).column("word").combine_chunks()
                places = _common(shared.value)
                at = np.fromiter((places.get(word, -1) for word in words.to_pylist()), np.int64, len(words))
                slots = np.flatnonzero(at < 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots) + 1, shard)), pa.array(np.append(np.int32(-1), slots)), pa.concat_arrays([pa.nulls(1, pa.string()), words.take(pa.array(slots))]),
                                                  pa.array([shards.planes(at + 1), *[None] * len(slots)], pa.binary())], ["shard", "slot", "word", "common"])
        forget()

    listed = common.stored(lists.mapInArrow(rare, "shard long, slot int, word string, common binary"))
    cut.drop("listed=true")
    back = common.stored(listed.df.filter("slot >= 0").select("shard", "slot", "word").join(words_of.df.select("word", "ids"), "word").select(
        "shard", "slot", "ids", F.lit(None).cast("binary").alias("common")).unionByName(
        listed.df.filter("slot < 0").select("shard", "slot", F.lit(None).cast("array<int>").alias("ids"), "common")))
    listed.drop()
    words_of.drop()

    def place(found: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("slot").combine_chunks()  # the one with the common words comes first
        ids = _common_ids(shared.value)
        at = shards.numbers(rows.column("common")[0]).astype(np.int64) - 1
        own = pa.concat_arrays([ids, _ids(rows.column("ids").slice(1))])
        at[rows.column("slot").to_numpy()[1:]] = len(ids) + np.arange(rows.num_rows - 1)
        sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values, starts = own.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        texts = shards.unpack(found.column("texts")[0])
        word = at[shards.numbers(found.column("places")[0])]
        n = sizes[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = values[np.repeat(starts[word] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(texts.column("n").to_numpy())]).astype(np.int64)
        out = pa.table({"doc_id": texts.column("doc_id"), "ids": common.grouped(flat, ends[bounds], pa.int32())})
        return out if named is None else out.append_column("decoded", named.joined(flat, np.diff(ends[bounds]), " "))

    def placed(found: pa.Table, rows: pa.Table) -> pa.Table:
        done = place(found, rows)
        common.release()
        return done

    return cut.df.filter("NOT listed").select("shard", "texts", "places").groupBy("shard").cogroup(back.df.groupBy("shard")).applyInArrow(placed, f"doc_id {kind}, ids array<int>" + ("" if named is None else ", decoded string"))


@lru_cache(maxsize=1)
def _common(packed: bytes) -> dict[str, int]:
    """Places of the common words, unpacked once in a worker."""
    return {word: i for i, word in enumerate(shards.unpack(packed).column("word").to_pylist())}


@lru_cache(maxsize=1)
def _common_ids(packed: bytes) -> pa.Array:
    """Ids of the common words by place; the words themselves are not unpacked as strings."""
    return _ids(shards.unpack(packed).column("ids"))


def _ids(column) -> pa.ListArray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column if isinstance(column, pa.Array) else pa.array([], pa.list_(pa.int32()))).cast(pa.list_(pa.int32()))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table of a vocabulary."""
    tokenizer = Tokenizer.from_file(path)
    return spark.createDataFrame([(i, p) for p, i in tokenizer.get_vocab(with_added_tokens=True).items()], "id int, piece string")


class Pieces:
    """The id-to-piece table in a task, sorted by id, to which whole batches of ids are joined."""

    def __init__(self, table: DataFrame):
        rows = table.dropDuplicates(["id"]).toArrow().sort_by("id").combine_chunks()
        self.numbers = rows.column("id").to_numpy()
        self.names = rows.column("piece").combine_chunks() if rows.num_rows else pa.array([], pa.string())

    def joined(self, ids: np.ndarray, sizes: np.ndarray, between: str) -> pa.Array:
        """The pieces of consecutive lists of ids, joined; ids that are not in the table have no piece."""
        place = np.minimum(np.searchsorted(self.numbers, ids), max(len(self.numbers) - 1, 0))
        hit = self.numbers[place] == ids if len(self.numbers) else np.zeros(len(ids), bool)
        ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(pa.array(place[hit]))), between)


def decode(encoded: DataFrame, table: DataFrame, between: str = " ") -> DataFrame:
    """Adds `decoded`: the pieces of `ids`, joined; an id that is not in the table has no piece, null ids no text.

    `table` has one row per vocabulary entry; every task holds it.
    """
    named, columns = Pieces(table), encoded.columns
    at = columns.index("ids")

    def joined(batches):
        for batch in batches:
            for part in _slices(batch, at):
                lists = part.column(at)
                sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
                texts = named.joined(lists.flatten().to_numpy(zero_copy_only=False), sizes, between)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*columns, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(joined, f"{fields}, decoded string")


def _slices(batch: pa.RecordBatch, at: int):
    """The batch in slices of about IDS_AT_ONCE ids."""
    ends = np.cumsum(pc.fill_null(batch.column(at).value_lengths(), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + IDS_AT_ONCE, "right")))
        yield batch.slice(start, stop - start)
        start = stop
