"""Incremental ingest, as a batch and as a stream: new events, unseen keys, labels.

Every sink is written per micro-batch so that repeating a batch after a failure gives the same table:
appended tables are stored by batch number and a repeated batch overwrites its own folder; labels are
merged by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from weekrank.functions import dates
from weekrank.operators import joins, merge, ordered, profile
from weekrank.operators.columns import between_times
from weekrank.sources.tables import exists

BATCH = "ingest_batch"


def _stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The appended table, without the given batch and later ones; None while no batch with rows is stored."""
    if not exists(spark, path) or not _batches(spark, path):
        return None
    table = spark.read.parquet(path)
    return table if before is None else table.filter(F.col(BATCH) < before)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Stored batch numbers, from the folder names (empty batches have no folder)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    names = [entry.getPath().getName() for entry in entries]
    return [int(name.split("=")[1]) for name in names if name.startswith(f"{BATCH}=")]


def _last_batch(spark: SparkSession, path: str, before: int) -> int | None:
    """Highest stored batch number below `before`."""
    return max((n for n in _batches(spark, path) if n < before), default=None)


def _append(df: DataFrame, path: str, batch: int) -> None:
    df.withColumn(BATCH, F.lit(batch).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def new_rows(incoming: DataFrame, stored: DataFrame | None, ts: str = "date", until=None) -> DataFrame:
    """Incoming rows after the newest stored one (one timestamp reaches the driver)."""
    mark = None if stored is None else stored.agg(F.max(dates.to_utc(F.col(ts)))).first()[0]
    return between_times(incoming, dates.to_utc(F.col(ts)), mark, until)


def append_new_rows(incoming: DataFrame, path: str, batch: int, order: Sequence[str], ts: str = "date",
                    number: str = "scrobble_number", until=None) -> None:
    """Append the rows after the high-water mark, numbered on from the highest stored number.

    Every batch lies after the one before it, so the mark is in the last stored batch: only that
    partition is read, not the whole table.
    """
    spark = incoming.sparkSession
    stored, start = _stored(spark, path, batch), 0
    last = None if stored is None else _last_batch(spark, path, batch)
    stored = None if last is None else stored.filter(F.col(BATCH) == last)
    if stored is not None:
        start = profile.high_water_mark(stored, ts, number).first()["last_number"]
    fresh = new_rows(incoming, stored, ts, until)
    _append(ordered.running_number(fresh, order, number, start), path, batch)


def log_rows(incoming: DataFrame, path: str, batch: int, keys: Sequence[str], ts: str = "date") -> None:
    """Append the rows whose `keys` the log does not have yet, whatever their time: nothing is lost to the order of arrival.

    The log has one folder per batch, which a repeated batch writes again. `late` tells rows that are not after the newest row of
    the batches before. Only stored rows within the time span of the batch are compared (Parquet statistics skip the rest); rows
    without a time are compared with each other. Numbers are dealt when the log is read (`numbered`).
    """
    stored = _stored(incoming.sparkSession, path, batch)
    at = dates.to_utc(F.col(ts))
    fresh, mark = joins.first_per_key(incoming, keys, keys), None
    if stored is not None:
        span = incoming.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).first()
        mark = stored.agg(F.max(at)).first()[0]
        near = stored.filter(F.col(ts).between(F.lit(span["low"]), F.lit(span["high"])) | F.col(ts).isNull())
        seen = near.select(*[F.col(k).alias(f"_seen_{k}") for k in keys])
        fresh = fresh.join(seen, joins.same([(k, f"_seen_{k}") for k in keys]), "left_anti")
    late = F.lit(False) if mark is None else F.coalesce(at <= F.lit(mark), F.lit(False))
    _append(fresh.withColumn("late", late), path, batch)


def numbered(spark: SparkSession, path: str, order: Sequence[str], number: str = "scrobble_number") -> DataFrame:
    """The whole log with numbers from 1 in a total order; late rows have their place among the others."""
    return ordered.running_number(spark.read.parquet(path), order, number)


def commits(spark: SparkSession, path: str, ts: str = "date") -> DataFrame:
    """What every batch added: rows, late rows, first and last time."""
    return spark.read.parquet(path).groupBy(BATCH).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def weekly_counts(stream: DataFrame, entity: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Events per entity and Saturday-ended week as a watermarked window: a week is given out once, when no row of it is waited for.

    Weeks run from Sunday 00:00 to Saturday 24:00. Rows of a week that was given out are dropped by the watermark, `delay` after the newest time seen.
    """
    # The epoch fell on a Thursday: windows of seven days are moved to Sunday.
    window = F.window(F.col(ts), "7 days", startTime="3 days")
    counts = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(window.alias("week"), *entity).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*entity, F.to_date(F.col("week.end") - F.expr("INTERVAL 1 DAY")).alias("week_saturday"), "n")


def append_unseen(events: DataFrame, path: str, batch: int, keys: Sequence[str],
                  enrich: Callable[[DataFrame], DataFrame]) -> None:
    """Append `enrich(unseen keys)` for the keys of this batch the table does not have yet."""
    known = _stored(events.sparkSession, path, batch)
    _append(enrich(joins.pending_keys(events, known, keys)), path, batch)


def merge_versions(labels: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], partition: str) -> int:
    """As `merge_labels`, into versioned partitions whose manifest is swapped once."""
    return merge.upsert_versions(labels, path, keys, newest, partition)


def merge_labels(labels: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], partition: str) -> None:
    merge.upsert_partitions(labels, path, keys, newest, partition, exists(labels.sparkSession, path))


def watch(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", name: str = "*",
          files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the files landing in a folder."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def each_batch(stream: DataFrame, checkpoint: str, *steps: Callable[[DataFrame, int], None],
               once: bool = True) -> DataStreamWriter:
    """Writer that runs the steps on every micro-batch; with `once`, it stops when the folder is read."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for step in steps:
                step(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(availableNow=True) if once else writer
