"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

Words fall into CLASSES classes by hash. The class of the next token comes from a softmax over hashed features of its
context: the word before, the two words before, and the word before the last (a skip). Inside its class a word has its
smoothed training frequency. Counts come from all training texts; the feature weights are trained by gradient sums over
all training texts, one pass per round: tasks sum gradients, Spark adds them up by feature, and the driver holds the
weights, whose size is fixed (SLOTS x CLASSES).

These weights are shared by many contexts. On them lie three layers, one for each kind of feature, in which every
word after every context of the training texts has a weight of its own, however many there are. Such a layer is saturated,
so its fit is closed: with a Dirichlet prior around the layer beneath, of the strength of FIRM tokens, a word seen n times
after a context seen N times has (n + FIRM x what the layer beneath says) / (N + FIRM), which sums to 1 over all words.
These weights stay in Spark: shards send the hashed keys of what they count in buckets, whose number grows with the
input, each bucket is added up by one task, and the sums go back in the order of the keys.

Texts are cut into words once, shard by shard; a shard keeps its distinct words and, for every place, the number of the
word there. Counts go back to the shards by a join: those of the words of the most shards, at most shards.COMMON of them,
as a table that every task holds, all others by shuffling (word, shard, number) rows.

Each text ends with an end token. A null text counts as empty. Repeated rows are scored, and learned from, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekrank.llm import common, shards, words

CLASSES, SLOTS = 32, 1 << 13
BYTES = 2 * shards.BYTES  # text bytes of a shard: larger ones send fewer words and keys
ROUNDS, STEP, CALM = 2, 1.0, 20.0
BLOCK = 1 << 14  # tokens that are scored at once
SMOOTH = 0.1
FEATURES = 3
SKIP, PRIOR, PAIR, BEFORE_SKIP = 2, 0, 1, 3  # what is counted: a word after each kind of context; all words after a word before the last
FIRM = {SKIP: 10_000.0, PRIOR: 3_000.0, PAIR: 8.0}  # from the lowest layer to the highest
COUNTED = 1 << 21  # tokens whose counts of one kind make a bucket
BITS, SPARE = 40, 12  # bits of a key: at least, and beyond those that number all tokens (one key in 4,096 may be another's too)
LISTED = 1 << 20  # words of shards that a task adds up before it hands them on
END = ""  # no word is empty


def held_out(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Distinct words with their counts `n` in texts to learn from, the number of the word at each place, and the tokens of each text."""
    data, offsets = common.flat(shards.texts_of(table))
    data = words.LOWER[data]
    starts, ends, at = words.spans(data, offsets, words.BLANK_WORDS)
    at = at + np.arange(len(at))  # with an end after each text
    own = np.ones(int(at[-1]), bool)
    own[at[1:] - 1] = False
    hashes = np.full(len(own), words.GRAM, np.uint64)
    hashes[own] = words.window_hashes(data, starts, ends, words.BASE)
    low, high = np.zeros((2, len(own)), np.int64)
    low[own], high[own] = starts, ends
    slot = pa.array(hashes).dictionary_encode().indices.to_numpy()
    kinds = int(slot.max()) + 1 if len(slot) else 0
    # Numbers go up from place to place where a word is new; frequent words then get small numbers, which pack well.
    first = np.searchsorted(np.maximum.accumulate(slot), np.arange(kinds))
    by = np.argsort(-np.bincount(slot, minlength=kinds), kind="stable")
    rank = np.empty(kinds, np.int64)
    rank[by] = np.arange(kinds)
    slot, first = rank[slot], first[by]
    sizes = high[first] - low[first]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    content = data[np.repeat(low[first] - stops[:-1], sizes) + np.arange(stops[-1])]
    word = pa.LargeStringArray.from_buffers(kinds, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(content.tobytes())).cast(pa.string())
    learned = np.repeat(table.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
    return pa.table({"word": word, "n": np.bincount(slot[learned], minlength=kinds)}), slot, np.diff(at)


def hashes_of(word: pa.Array) -> np.ndarray:
    data, offsets = common.flat(word)
    return np.where(np.diff(offsets) > 0, words.window_hashes(data, offsets[:-1], offsets[1:], words.BASE), words.GRAM)


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return (words.mix(hashes) % np.uint64(CLASSES)).astype(np.int64)


class Tokens:
    """Tokens of some texts of a shard: the number of each one's word, offsets of the texts, and the words' hashes and classes."""

    def __init__(self, word: pa.Array, slot: np.ndarray, sizes: np.ndarray):
        self.hashes = hashes_of(word)
        self.empty = pc.binary_length(word).to_numpy(zero_copy_only=False) == 0  # the end
        self.classes = classes_of(self.hashes)
        self.slot, self.at = slot, np.concatenate([[0], np.cumsum(sizes)])

    @cached_property
    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words one and two places before each token; before the start of a text stands nothing, numbered after all words."""
        n, starts, nothing = len(self.slot), self.at[:-1], len(self.hashes)
        one = np.concatenate([[nothing], self.slot])[:n]
        two = np.concatenate([[nothing] * 2, self.slot])[:n]
        one[starts] = two[starts] = nothing
        two[starts[np.diff(self.at) > 1] + 1] = nothing
        return one, two

    def contexts(self, kind: int) -> np.ndarray:
        """Hashes of each token's context of one kind: the word before, the two words before, or the word before the last."""
        (one, two), h = self.before, np.append(self.hashes, np.uint64(0))
        if kind == PAIR:
            return words.mix(words.mix(words.mix(h)[one] + (h * words.BASE)[two]) + np.uint64(kind))
        x, at = (h + np.uint64(1), one) if kind == PRIOR else (h ^ words.GRAM, two)
        return words.mix(words.mix(x) + np.uint64(kind))[at]

    def features(self) -> np.ndarray:
        """Weight rows of each token's context."""
        return np.stack([(self.contexts(kind) % np.uint64(SLOTS)).astype(np.int64) for kind in range(FEATURES)])

    def keys(self, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of what is counted of one kind, and the place of each token's key among them."""
        shift = np.uint64(64 - bits)
        if kind != BEFORE_SKIP:
            return np.unique(words.mix(self.contexts(kind) ^ words.mix(self.hashes * words.BASE)[self.slot]) >> shift, return_inverse=True)
        two = self.before[1]
        first = np.full(len(self.hashes) + 1, -1)  # one token for each context
        first[two] = np.arange(len(two))
        held = np.flatnonzero(first >= 0)
        keys, at = np.unique(words.mix(self.contexts(SKIP)[first[held]]) >> shift, return_inverse=True)
        first[held] = at
        return keys, first[two]


def _factors(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows as factors of the odds of the classes, without and with those of the bias."""
    rows = weights - weights.max(axis=1, keepdims=True)
    # A product of all factors of a class must not vanish.
    spread = -FEATURES * rows[:SLOTS].min() - rows[SLOTS].min()
    factors = np.exp(rows, dtype=np.float32 if spread < 80 else np.float64)
    return factors[:SLOTS], factors[:SLOTS] * factors[SLOTS]


def _shares(factors: tuple[np.ndarray, np.ndarray], features: np.ndarray) -> np.ndarray:
    """Probabilities of all classes in each context."""
    plain, biased = factors
    p = np.take(biased, features[0], axis=0)
    for f in features[1:]:
        p *= np.take(plain, f, axis=0)
    p /= (p @ np.ones(CLASSES, p.dtype))[:, None]
    return p


def log_shares(weights: np.ndarray, features: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of all classes in each context, or those of one class each; row SLOTS of the weights is the bias."""
    factors, parts = _factors(weights), []
    for low in range(0, features.shape[1], BLOCK):
        p = _shares(factors, features[:, low:low + BLOCK])
        parts.append(np.log(p if classes is None else p[np.arange(len(p)), classes[low:low + BLOCK]]))
    return np.concatenate(parts) if parts else np.zeros(0)


def _expected(weights: np.ndarray, features: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Sums (CLASSES, SLOTS) of the probabilities of all classes over the contexts with each feature."""
    if not weights[:SLOTS].any():  # all contexts have the shares of the bias
        share = np.exp(weights[SLOTS].astype(np.float64))
        return (share / share.sum())[:, None] * seen
    out, factors = np.zeros((CLASSES, SLOTS)), _factors(weights)
    for low in range(0, features.shape[1], BLOCK):
        block = features[:, low:low + BLOCK]
        shares = np.ascontiguousarray(_shares(factors, block).T, np.float64)
        for kind in block:
            for k in range(CLASSES):
                out[k] += np.bincount(kind, shares[k], SLOTS)
    return out


def _gradients(tokens: Tokens, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums (CLASSES, SLOTS) over the tokens, and how often each feature is seen."""
    features, own = tokens.features(), tokens.classes[tokens.slot] * SLOTS
    found = sum(np.bincount(own + kind, minlength=CLASSES * SLOTS) for kind in features).reshape(CLASSES, SLOTS)
    seen = found.sum(axis=0)
    return found - _expected(weights, features, seen), seen


def train(store: DataFrame, totals: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (SLOTS + 1, CLASSES): the bias from the class totals, the rest from gradient sums over all texts to learn from."""
    weights = np.zeros((SLOTS + 1, CLASSES), np.float32)
    share = (totals + SMOOTH) / (totals + SMOOTH).sum()
    weights[SLOTS] = np.log(share)
    for _ in range(rounds):
        def gradients(batches, weights=weights):
            total, seen = np.zeros((CLASSES, SLOTS)), np.zeros(SLOTS, np.int64)
            for batch in batches:
                for packed in zip(*batch.columns):
                    word, texts, places = shards.unpack(packed[0]).column("word").combine_chunks(), shards.unpack(packed[1]), shards.numbers(packed[2])
                    learn, sizes = texts.column("learn").to_numpy(zero_copy_only=False).astype(bool), texts.column("n").to_numpy()
                    g, n = _gradients(Tokens(word, places[np.repeat(learn, sizes)], sizes[learn]), weights)
                    total += g
                    seen += n
            rows = np.flatnonzero(seen)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(seen[rows]), common.grouped(total.T[rows].ravel(), np.arange(len(rows) + 1) * CLASSES, pa.float64())],
                                                 ["slot", "n", "g"])
            common.release()

        parts = store.select("words", "texts", "places").mapInArrow(gradients, "slot long, n long, g array<double>")
        sums = parts.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(CLASSES)]).toPandas()
        weights = weights.copy()
        if len(sums):
            g, n = sums[[f"g{i}" for i in range(CLASSES)]].to_numpy(), sums["n"].to_numpy()
            # A Newton-like step: the curvature of a class is about its share of the feature's tokens.
            weights[sums["slot"].to_numpy()] += (STEP / FEATURES * g / (n[:, None] * share + CALM)).clip(-3, 3).astype(np.float32)
    return weights


def word_counts(lists: DataFrame) -> DataFrame:
    """word, c (its count in the texts to learn from) and n (shards that hold it); `lists` holds the word lists of the shards."""
    def count(batches):
        def out():
            table = pa.concat_tables(have).group_by("word", use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            return table.select(["word", "n_sum", "n_count"]).rename_columns(["word", "c", "n"]).combine_chunks().to_batches()

        have = []
        for batch in batches:
            for blob in batch.column(0):
                have.append(shards.unpack(blob))
                if sum(t.num_rows for t in have) > LISTED:
                    yield from out()
                    have = []
        if have:
            yield from out()
        have = []
        common.release()

    return lists.select("words").mapInArrow(count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).filter("c > 0")


class Layers:
    """Counts of all words after all contexts: keys go out from the shards in buckets, sums come back."""

    def __init__(self, tokens: int):
        self.bits = min(62, max(BITS, tokens.bit_length() + SPARE))
        self.buckets = max(1, -(-tokens // COUNTED))  # of each kind
        self.width = (1 << self.bits) // self.buckets + 1
        self.key_bytes, self.sum_bytes = -(-self.bits // 8), max(1, -(-tokens.bit_length() // 8))

    def out(self, tokens: Tokens, learned: np.ndarray, kinds: tuple[int, ...]) -> Iterator[tuple[int, bytes, bytes]]:
        """Bucket, keys and how often the texts to learn from have them."""
        for kind in kinds:
            keys, at = tokens.keys(kind, self.bits)
            n = np.bincount(at[learned], minlength=len(keys))
            cuts = np.searchsorted(keys, np.arange(self.buckets + 1, dtype=np.uint64) * np.uint64(self.width))
            for bucket in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[bucket], cuts[bucket + 1])
                # As steps from one key to the next, which are short.
                yield kind * self.buckets + int(bucket), shards.planes(np.diff(keys[part], prepend=np.uint64(0)), self.key_bytes), shards.planes(n[part], self.sum_bytes)

    def counted(self, store: DataFrame, *kinds: int) -> DataFrame:
        """shard, bucket and the counts in all texts to learn from of the keys that the shard sent."""
        def sent(batches):
            for batch in batches:
                for shard, *packed in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                    tokens, texts = opened(*packed)
                    learned = np.repeat(texts.column("learn").to_numpy(zero_copy_only=False).astype(bool), texts.column("n").to_numpy())
                    for bucket, keys, n in self.out(tokens, learned, kinds):
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([shard], pa.int64()), pa.array([keys], pa.binary()), pa.array([n], pa.binary())],
                                                         ["bucket", "shard", "keys", "n"])
            common.release()

        def added(rows: pa.Table) -> pa.Table:
            keys = [np.cumsum(shards.numbers(x, self.key_bytes), dtype=np.uint64) for x in rows.column("keys")]
            ends = np.cumsum([len(x) for x in keys])
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, np.concatenate([shards.numbers(x, self.sum_bytes) for x in rows.column("n")])).astype(np.int64)[at]
            out = pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"), "sums": pa.array([shards.planes(x, self.sum_bytes) for x in np.split(sums, ends[:-1])], pa.binary())})
            common.release()
            return out

        keys = store.select("shard", "words", "texts", "places").mapInArrow(sent, "bucket long, shard long, keys binary, n binary")
        return keys.groupBy("bucket").applyInArrow(added, "shard long, bucket long, sums binary")

    def back(self, tokens: Tokens, rows: pa.Table, kind: int) -> np.ndarray:
        """The count of each token's key, from what came back to its shard."""
        bucket = rows.column("bucket").to_numpy()
        own = np.flatnonzero(bucket // self.buckets == kind)
        sums = [shards.numbers(rows.column("sums")[int(i)], self.sum_bytes) for i in own[np.argsort(bucket[own])]]
        return np.concatenate(sums)[tokens.keys(kind, self.bits)[1]].astype(np.int64)

    def on(self, tokens: Tokens, share: np.ndarray, rows: pa.Table, c: np.ndarray) -> np.ndarray:
        """The share of each token with all layers on `share`; `c` holds the counts of the words."""
        def layer(kind, share, n, contexts):
            return (np.minimum(n, contexts) + FIRM[kind] * share) / (contexts + FIRM[kind])

        share = layer(SKIP, share, self.back(tokens, rows, SKIP), self.back(tokens, rows, BEFORE_SKIP))
        # A text has one start as it has one end, and a word as many followers as places.
        starts = c[np.flatnonzero(tokens.empty)[0]]
        n = self.back(tokens, rows, PRIOR)
        share = layer(PRIOR, share, n, np.append(c, starts)[tokens.before[0]])
        pairs = np.concatenate([[0], n[:-1]])
        pairs[tokens.at[:-1]] = starts
        return layer(PAIR, share, self.back(tokens, rows, PAIR), pairs)


def opened(words_, texts, places) -> tuple[Tokens, pa.Table]:
    """Tokens and texts of a stored shard."""
    texts = shards.unpack(texts)
    return Tokens(shards.unpack(words_).column("word").combine_chunks(), shards.numbers(places), texts.column("n").to_numpy()), texts


def score(docs: DataFrame, learn: Column, rounds: int = ROUNDS, most_common: int = shards.COMMON) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the model) of every row.

    Both are log10 probabilities of the whole text. Without a row to learn from all tokens are unknown.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for shard, table in shards.tables(batches, BYTES):
            table = table.combine_chunks()
            word, slot, sizes = numbered(table)
            texts = pa.table({"doc_id": table.column("doc_id"), "learn": table.column("learn"), "n": sizes})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(slot)], pa.int64()),
                                              *[pa.array([x], pa.binary()) for x in (shards.pack(word), shards.pack(texts), shards.planes(slot))]],
                                             ["shard", "tokens", "words", "texts", "places"])
        common.release()

    # Written once: all that follows reads the shards as they were numbered here.
    store = common.stored(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(
        cut, "shard long, tokens long, words binary, texts binary, places binary"))
    counts = common.stored(word_counts(store.df))

    def class_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(classes_of(hashes_of(batch.column(0)))), batch.column(1)], ["k", "c"])

    sums = counts.df.select("word", "c").mapInArrow(class_of, "k long, c long").groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in sums:
        totals[row["k"]], kinds[row["k"]] = row["n"], row["v"]
    n, v = int(totals.sum()), int(kinds.sum())
    weights = train(store.df, totals, rounds=rounds)
    layers = Layers(store.df.agg(F.sum("tokens")).first()[0] or 0)
    # Written two kinds at a time, before the counts of words go back: the keys then take disk only until they are added up.
    layered = [common.stored(layers.counted(store.df, *both)) for both in ((SKIP, BEFORE_SKIP), (PRIOR, PAIR))]
    known = shards.common_words(counts.df, "c", most_common).toArrow().combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(shards.pack(known))

    def places_of(word: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands among the common ones (-1: it is none of them), and the counts of those."""
        table = shards.unpack(shared.value)
        at = pc.index_in(word, value_set=table.column("word").combine_chunks()) if table.num_rows else pa.nulls(len(word), pa.int32())
        return pc.fill_null(at, -1).to_numpy(zero_copy_only=False), table.column("c").to_numpy()

    def rare(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                word = shards.unpack(blob).column("word").combine_chunks()
                slots = np.flatnonzero(places_of(word)[0] < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), shard, np.int64)), pa.array(slots, pa.int32()), word.take(pa.array(slots))], ["shard", "slot", "word"])
        common.release()

    others = store.df.select("shard", "words").mapInArrow(rare, "shard long, slot int, word string")
    back = others.join(counts.df.select("word", "c"), "word").select("shard", "slot", "c")
    came = back
    for sums in layered:
        came = came.unionByName(sums.df, allowMissingColumns=True)

    def scored(left: pa.Table, rows: pa.Table) -> pa.Table:
        word = shards.unpack(left.column("words")[0]).column("word").combine_chunks()
        tokens, texts = opened(*[left.column(x)[0] for x in ("words", "texts", "places")])
        alone = pc.is_valid(rows.column("slot"))
        rows, sums = rows.filter(alone), rows.filter(pc.invert(alone))
        at, often = places_of(word)
        c = np.zeros(len(word), np.int64)
        c[at >= 0] = often[at[at >= 0]]
        c[rows.column("slot").to_numpy()] = rows.column("c").to_numpy()
        base = np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1)))[tokens.slot]
        inside = np.log((c + SMOOTH) / (totals + SMOOTH * (kinds + 1))[tokens.classes])[tokens.slot]
        model = log_shares(weights, tokens.features(), tokens.classes[tokens.slot]) + inside
        model = np.log(layers.on(tokens, np.exp(model), sums, c))
        starts = tokens.at[:-1]

        def per_text(x):
            return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
        out = pa.table({"doc_id": texts.column("doc_id"), "learn": texts.column("learn"), "n_tokens": np.diff(tokens.at), "n_known": per_text((c > 0)[tokens.slot].astype(np.int64)),
                        "train_tokens": np.full(len(starts), n), "base_score": per_text(base), "score": per_text(model) / np.log(10)})
        common.release()
        return out

    return store.df.groupBy("shard").cogroup(came.groupBy("shard")).applyInArrow(
        scored, f"doc_id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
