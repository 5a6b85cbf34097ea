"""Documents in shards: stored pieces of a bounded size that later passes open again by their number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank.llm import common

BYTES = 2 * 1024 * 1024  # text bytes of a shard; a longer text is a shard of its own
COMMON = 1 << 18  # words of at most LONG characters that go to every task: 20 MB at most
LONG = 32


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob.as_buffer() if hasattr(blob, "as_buffer") else blob)).read_all().combine_chunks()


def texts_of(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return column.chunk(0) if column.num_chunks == 1 else pa.array([], pa.string()) if not column.num_chunks else column.combine_chunks()


def tables(batches: Iterator[pa.RecordBatch], bytes_each: int = BYTES) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task as numbered shards; a number is a shard's own as long as the task is not run again."""
    number, have, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in common.cut(batches, most=bytes_each):
        more = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index("text")))).as_py() or 0
        if have and size + more > bytes_each:
            yield number, pa.Table.from_batches(have)
            number, have, size = number + 1, [], 0
        have.append(batch)
        size += more
    if have:
        yield number, pa.Table.from_batches(have)


def stored(docs: DataFrame, bytes_each: int = BYTES) -> common.Stored:
    """All columns of the documents as (shard, blob), written once, so that a shard stays what it is if a task runs again."""
    def gather(batches: Iterator[pa.RecordBatch]):
        for number, table in tables(batches, bytes_each):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(table)], pa.binary())], ["shard", "blob"])
        common.release()

    return common.stored(docs.mapInArrow(gather, "shard long, blob binary"))


def each(shards: DataFrame, function, schema: str) -> DataFrame:
    """`function(shard, table)` yields record batches for every shard."""
    def run(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from function(shard, unpack(blob))
        common.release()
    return shards.mapInArrow(run, schema)


def each_with(shards: DataFrame, rows: DataFrame, function, schema: str) -> DataFrame:
    """`function(table, rows)` returns an Arrow table for each shard and what `rows` holds under its number."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        done = pa.concat_tables([function(unpack(blob), right) for blob in left.column("blob")])
        common.release()
        return done
    return shards.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, schema)


def planes(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers of at most `width` bytes packed byte plane by byte plane; planes of zeros take nothing."""
    whole = 4 if width <= 4 else 8
    raw = np.ascontiguousarray(numbers, f"u{whole}").view(np.uint8).reshape(-1, whole)[:, :width].T
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(raw).tobytes(), codec="zstd", asbytes=True)


def numbers(blob, width: int = 4) -> np.ndarray:
    raw, whole = blob.as_buffer(), 4 if width <= 4 else 8
    n = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    packed = pa.decompress(raw.slice(8), decompressed_size=width * n, codec="zstd") if n else b""
    out = np.zeros((n, whole), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, n).T
    return out.view(f"u{whole}").ravel()


def _often(n):
    """Eighths of powers of two: a few hundred classes of counts, whatever the counts."""
    return F.floor(F.log2(n) * 8).cast("int")


def common_words(table: DataFrame, value: str, most: int = COMMON) -> DataFrame:
    """word and `value` of the words in the highest classes of counts `n` that have at most `most` words together."""
    short = table.filter(F.length("word") <= LONG).withColumn("often", _often(F.col("n")))
    left, least = most, None
    for row in sorted(short.groupBy("often").count().collect(), key=lambda r: -r["often"]):
        left -= row["count"]
        if left < 0:
            break
        least = row["often"]
    return short.filter(F.lit(False) if least is None else F.col("often") >= least).select("word", value)
