"""Quality classifier: a small byte-level convolutional network in numpy.

A text is read in overlapping chunks that cover it from the first to the last byte. Learned filters slide over the
bytes of a chunk; the largest response of each filter in the chunk is kept (max-pooling), and the mean and the maximum
over all chunks of a text go through one linear layer into a probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank.llm import common

CHUNK, STRIDE = 512, 384  # bytes; each chunk shares a quarter with the next
WIDTH, FILTERS = 6, 16
SAMPLE_ROWS = 6000  # most labelled rows that a fit looks at, half of each class where there are enough
SAMPLE_BYTES = 16 * 1024 * 1024  # most text bytes of them on the driver
LONGEST = 32 * 1024  # bytes of a text that a fit looks at; longer texts are scored, but not learned from
PRIOR = 0.75  # share of label 1 that the probabilities stand for
EPOCHS, BATCH, RATE = 6, 64, 0.02
THRESHOLD = 0.3

#: Byte classes, so that a filter tells kinds of signs apart: fixed ranges, then single frequent signs.
CLASSES = 64


def _classes() -> np.ndarray:
    """256 bytes in 64 classes: letters by themselves without case in one bit, other signs in groups."""
    out = np.zeros(256, np.uint8)
    for byte in range(256):
        if 97 <= byte <= 122:
            out[byte] = 1 + (byte - 97) // 2
        elif 65 <= byte <= 90:
            out[byte] = 14 + (byte - 65) // 5
        elif 48 <= byte <= 57:
            out[byte] = 20
        elif byte < 128:
            out[byte] = 21 + byte % 27
        else:
            out[byte] = 48 + byte % 16
    return out


CLASS_OF = _classes()


class Network:
    """Filters (width, class, filter), their biases, and a linear layer over mean and maximum of the chunks."""

    def __init__(self, filters, bias, weights, offset, scale):
        self.filters, self.bias, self.weights, self.offset, self.scale = filters, bias, weights, offset, scale

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses at each position of padded codes (WIDTH - 1 more than positions)."""
        n = len(codes) - WIDTH + 1
        out = self.filters[0][codes[:n]]
        for i in range(1, WIDTH):
            out += self.filters[i][codes[i:i + n]]
        return out

    def chunk_bounds(self, sizes: np.ndarray):
        """Chunk starts inside each text (at least one chunk) and the number of chunks of each text."""
        counts = np.maximum(1, np.ceil((sizes - CHUNK) / STRIDE).astype(np.int64) + 1)
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return number * STRIDE, counts

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of the pooled, rectified filter responses of each text."""
        sizes = np.diff(offsets)
        starts, counts = self.chunk_bounds(sizes)
        text = np.repeat(np.arange(len(sizes)), counts)
        # Max-pool in blocks of an eighth of a chunk: chunks are unions of blocks, so overlaps are not computed twice.
        block = CHUNK // 8
        blocks = -(-(sizes + WIDTH - 1) // block)  # the last WIDTH - 1 places are padding
        padded = np.zeros(int((blocks * block).sum()) + WIDTH, np.uint8)
        first = np.concatenate([[0], np.cumsum(blocks * block)])
        where = np.repeat(first[:-1] - offsets[:-1], sizes) + np.arange(len(data))
        padded[where] = CLASS_OF[data]
        pooled = []
        step = block * 512
        ends = (first[1:, None] - np.arange(1, WIDTH)).ravel()  # filters from these places reach into the next text
        for at in range(0, int(first[-1]), step):
            some = self.responses(padded[at:min(at + step, int(first[-1])) + WIDTH - 1])
            some[ends[(ends >= at) & (ends < at + step)] - at] = -np.inf
            pooled.append(some.reshape(-1, block, FILTERS).max(axis=1))
        pooled = np.concatenate(pooled)
        block_at = first // block
        begin = block_at[text] + starts // block
        end = np.minimum(begin + CHUNK // block, block_at[text + 1])
        chunk = pooled[begin]
        for k in range(1, CHUNK // block):
            chunk = np.maximum(chunk, pooled[np.minimum(begin + k, end - 1)])
        chunk = np.maximum(chunk + self.bias, 0)
        chunk_at = np.cumsum(counts) - counts
        mean = np.add.reduceat(chunk, chunk_at, axis=0) / counts[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, chunk_at, axis=0)], axis=1)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        z = self.features(data, offsets) / self.scale @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train filters on single chunks drawn from the texts, then the linear layer on whole texts."""
    rng = np.random.default_rng(seed)
    filters = rng.normal(0, 0.3, (WIDTH, CLASSES, FILTERS)).astype(np.float32)
    filters[:, 0] = 0  # padding
    bias, weights, offset = np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.float32(0)
    if not len(texts) or len(set(labels.tolist())) < 2:
        rate = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return Network(filters, bias, np.zeros(2 * FILTERS), math.log(rate / (1 - rate)), np.ones(2 * FILTERS))
    state = [np.zeros_like(x) for x in (filters, bias, weights)]
    codes = [CLASS_OF[np.frombuffer(t, np.uint8)] for t in texts]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            x = np.zeros((len(part), CHUNK + WIDTH - 1), np.int64)
            for row, i in enumerate(part):
                at = rng.integers(0, max(1, len(codes[i]) - CHUNK // 2))
                piece = codes[i][at:at + CHUNK]
                x[row, :len(piece)] = piece
            y = labels[part].astype(np.float32)
            z = filters[0][x[:, :CHUNK]]
            for k in range(1, WIDTH):
                z = z + filters[k][x[:, k:k + CHUNK]]
            best = z.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ weights + offset, -30, 30)))
            error = (p - y)[:, None] / len(part)
            back = error * weights * (pooled > 0)
            grad = np.zeros_like(filters)
            row = np.arange(len(part))[:, None]
            for k in range(WIDTH):
                np.add.at(grad[k], (x[row, best + k], np.arange(FILTERS)), back)
            grad[:, 0] = 0
            steps = (grad, back.sum(axis=0), (pooled * error).sum(axis=0) + 1e-4 * weights)
            for value, g, s in zip((filters, bias, weights), steps, state):
                s *= 0.98
                s += 0.02 * g * g
                value -= RATE * g / (np.sqrt(s) + 1e-4)
            offset -= np.float32(RATE * error.sum())
    net = Network(filters, bias, np.zeros(2 * FILTERS), 0.0, np.ones(2 * FILTERS))
    x = np.concatenate([net.features(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
                        for some in (texts[i:i + 200] for i in range(0, len(texts), 200))]).astype(np.float64)
    net.scale = np.maximum(x.std(axis=0), 1e-3)
    x = np.concatenate([x / net.scale, np.ones((len(x), 1))], axis=1)
    w, y = np.zeros(x.shape[1]), labels.astype(float)
    share = np.where(y == 1, PRIOR / max(y.mean(), 1e-9), (1 - PRIOR) / max(1 - y.mean(), 1e-9))
    for _ in range(25):  # Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-1 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (share * (p - y)) + 1e-1 * w)
    net.weights, net.offset = w[:-1], float(w[-1])
    return net


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES,
          seed: int = 7) -> Network:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    At most `rows` ids, half of each class, are drawn by a hash; only their texts are brought to the driver. While the
    sample is larger than `most` bytes, its longest texts are left out. Labels other than 0 and 1, and null ids, take no
    part. Without labels of both classes every text gets the share of label 1 (0.5 where there are no labels at all).
    """
    keys = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64("doc_id", F.lit(seed))
    drawn = keys.filter("y = 0").orderBy(order).limit(rows // 2).unionByName(keys.filter("y = 1").orderBy(order).limit(rows // 2))
    text = F.coalesce("text", F.lit(""))
    fits = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("bytes")).join(F.broadcast(drawn), "doc_id")
    fits = fits.filter(F.col("bytes") <= LONGEST).toArrow().sort_by([("bytes", "ascending"), ("doc_id", "ascending")])
    fits = fits.filter(pc.less_equal(pc.cumulative_sum(fits.column("bytes").cast(pa.int64())), most)).sort_by("doc_id")
    network = fit(fits.column("text").cast(pa.binary()).to_pylist(), fits.column("y").to_numpy().astype(np.int64), seed=seed)
    # The driver lives on through all that follows, and does not need the sample any more.
    del fits
    common.release()
    return network


def score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row; only the text is looked at, null counts as empty."""
    columns = [c for c in docs.columns if c != name]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index("text")

    def scored(batches):
        for batch in common.cut(batches):
            p = network.probabilities(*common.flat(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*columns, name])
        common.release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scored, f"{fields}, `{name}` double")
