"""Shared helpers: session settings, stored intermediate tables and Arrow batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank import session

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches go to Python in small pieces, so that long texts do not pile up in a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Shuffle files of a finished query are removed at once.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: Text bytes that a Python worker holds as one piece.
PIECE_BYTES = 2 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, *partition: str) -> Stored:
    """Write `df` once into the shared checkpoint folder and read it back."""
    path = session.scratch_path(df.sparkSession, "llm")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return Stored(df.sparkSession, path, df.schema)


class Stored:
    """A table in the shared checkpoint folder: survives lost executors, is read column by column."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, sub: str = "") -> None:
        """Remove the files once nothing reads them any more."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + (f"/{sub}" if sub else ""))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bits that mark keys in a bitmap: 8 MB at most, whatever the input.
BITS = 1 << 26
_ROW = 32768  # bits of one row of a bitmap


def bitmap(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """The keys as bits (bucket, bits): a table of at most `bits` / 8 bytes that may be broadcast."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    return keys.select(F.floor(slot / _ROW).cast("long").alias("bucket"), (slot % _ROW).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_bit(df: DataFrame, table: DataFrame, columns: list[str], bits: int, name: str) -> DataFrame:
    """Adds `name`: false where the key is certainly not in the bitmap; true where it is, or meets another's bit."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    table = table.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    found = df.withColumns({"_bucket": F.floor(slot / _ROW).cast("long"), "_bit": (slot % _ROW).cast("int")}).join(F.broadcast(table), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, F.col("_bit") % 8) == 1, F.lit(False))).drop("_bucket", "_bit", "_bits")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_key(text: str = "text"):
    """Tells rows with the same id but different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def cut(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Give memory that a task no longer needs back to the system: its worker stays, idle, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def grouped(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    """A list array from flat values and the n + 1 offsets of its rows."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
