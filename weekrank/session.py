"""Session settings, checkpoint folder and size estimates shared by all operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.errors import PySparkAttributeError
from pyspark.sql import DataFrame, SparkSession

# Needed for right results (UTC) or for run-time re-planning; resource sizes stay with the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

BYTES_PER_SHUFFLE_PARTITION = 64 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession, *inputs: DataFrame) -> SparkSession:
    """Apply the run-time settings; size the first shuffle from the bytes of `inputs`.

    AQE merges small shuffle partitions but never splits an aggregate's partition, so the
    starting number has to grow with the data. A number set by the user is kept.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if inputs and not _set_by_user(spark, INITIAL_PARTITIONS):
        sizes = [estimated_bytes(df) for df in inputs]
        if all(size is not None for size in sizes):
            wanted = math.ceil(sum(sizes) / BYTES_PER_SHUFFLE_PARTITION)
            parallel = spark.sparkContext.defaultParallelism
            spark.conf.set(INITIAL_PARTITIONS, str(max(parallel, wanted)))
            spark.conf.set("weekrank.initialPartitionsSet", "true")
    return spark


def _set_by_user(spark: SparkSession, key: str) -> bool:
    ours = spark.conf.get("weekrank.initialPartitionsSet", "false") == "true"
    return spark.conf.get(key, None) is not None and not ours


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a shuffle starts with."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan (no job is run); None where it cannot be read."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except (AttributeError, ValueError, NotImplementedError, PySparkAttributeError):
        return None


def compact(df: DataFrame) -> DataFrame:
    """Fewer partitions for a small table that an iterative fit scans again and again (no shuffle)."""
    size = estimated_bytes(df)
    few = None if size is None else max(1, math.ceil(size / BYTES_PER_SHUFFLE_PARTITION))
    return df.coalesce(few) if few is not None and few < df.sparkSession.sparkContext.defaultParallelism else df


def broadcast_limit(spark: SparkSession) -> int:
    """`spark.sql.autoBroadcastJoinThreshold` in bytes; -1 when broadcasting is off."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    units = {"kb": 1 << 10, "k": 1 << 10, "mb": 1 << 20, "m": 1 << 20, "gb": 1 << 30, "g": 1 << 30, "b": 1}
    for suffix, scale in units.items():
        if text.endswith(suffix):
            return int(float(text[: -len(suffix)]) * scale)
    return int(text)


def fits_broadcast(df: DataFrame) -> bool:
    """True when Catalyst itself would broadcast this side because its files are small."""
    size = estimated_bytes(df)
    return size is not None and size <= broadcast_limit(df.sparkSession)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="weekrank-checkpoint-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    context.setCheckpointDir(local)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the checkpoint folder, so that several readers share one result.

    The stored copy survives lost executors, and values that depend on how rows were placed
    (partition ids, sort positions) stay the same for every reader. Unlike a checkpointed RDD it is
    columnar: each reader scans only its columns, and Catalyst knows its size. `drop_cuts` removes
    the copies when their readers are done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/weekrank-{name}-{uuid.uuid4().hex}"
    _CUTS.append(path)
    return path


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables this process wrote to the checkpoint folder; returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    while _CUTS:
        target = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        dropped += bool(target.getFileSystem(conf).delete(target, True))
    return dropped
