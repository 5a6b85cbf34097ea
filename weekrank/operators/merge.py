"""Merging new rows into stored tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import session
from weekrank.operators import joins, ordered
from weekrank.operators.columns import conform


def upsert(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Existing and new rows in the new rows' schema, the newest per key."""
    rows = new if existing is None else ordered.union_all(conform(existing, new.schema), new)
    return joins.latest_per_key(rows, keys, newest)


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], partition: str,
                      exists: bool) -> None:
    """Upsert into a table stored by `partition`, one of the keys: only partitions with new rows are rewritten.

    The values of `partition` in the new rows (few, such as weeks) are listed, so that the scan reads those partitions
    alone; partitions with a null value are not addressed by a list and are read as a whole where one occurs. The
    merged rows are stored before anything is overwritten: a call that fails while it merges leaves the table as it
    was, and repeating a call with the same rows changes nothing.
    """
    spark = new.sparkSession
    existing = None
    if exists:
        touched = [row[0] for row in new.select(partition).distinct().collect()]
        place = F.col(partition)
        wanted = place.isin([v for v in touched if v is not None])
        existing = spark.read.schema(new.schema).parquet(path).filter(wanted | place.isNull() if None in touched else wanted)
    merged = session.cut(upsert(existing, new, keys, newest))
    # A partition's rows go to as many tasks, and so files, as its share of the bytes needs.
    files = max(1, math.ceil((session.estimated_bytes(merged) or 0) / session.BYTES_PER_SHUFFLE_PARTITION))
    slot = F.pmod(F.xxhash64(*[k for k in keys if k != partition] or [partition]), F.lit(files))
    (merged.repartition(F.col(partition), slot).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


# --- versions and a manifest ----------------------------------------------------------------------------------------------


class Versioned:
    """A table of partitions, each of which lives in the folder of the version that wrote it last.

    `data/version=N` holds the partitions that version N wrote, `manifest/version=N` one row per partition: its value (as text) and the version
    to read it from. A version exists once its manifest is complete, which is the last thing written and the one moment at
    which readers see anything of it: a run that is lost before leaves the table as it was, and its files are ignored.
    """

    DONE = "_SUCCESS"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = T.StructType([*[f for f in schema.fields if f.name != partition], T.StructField(partition, schema[partition].dataType)])

    def _files(self, sub: str) -> list[str]:
        """Names in a folder of the table; none where it does not exist."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [entry.getPath().getName() for entry in system.listStatus(folder)] if system.exists(folder) else []

    def versions(self) -> list[int]:
        """Versions with a complete manifest, oldest first."""
        numbers = [int(name.split("=")[1]) for name in self._files("manifest") if name.startswith("version=")]
        return sorted(n for n in numbers if self.DONE in self._files(f"manifest/version={n}"))

    def manifest(self, version: int) -> dict[str | None, int]:
        rows = self.spark.read.schema("value string, at long").parquet(f"{self.path}/manifest/version={version}").collect()
        return {row["value"]: row["at"] for row in rows}

    def read(self, values: Sequence[str | None] | None = None, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest by default), or only some of its partitions (values as text)."""
        known = self.versions() if version is None else [version]
        live = self.manifest(known[-1]) if known else {}
        wanted = live if values is None else {v: live[v] for v in values if v in live}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])).parquet(f"{self.path}/data")
        place, by = F.col(self.partition).cast("string"), {}
        for value, at in wanted.items():
            by.setdefault(at, []).append(value)
        # One condition per version over partition columns only: folders of no interest are not listed into tasks.
        match = F.lit(False)
        for at, some in by.items():
            own = place.isin([v for v in some if v is not None])
            match = match | ((F.col("version") == at) & (own | place.isNull() if None in some else own))
        return stored.filter(match).drop("version").select(*self.schema.fieldNames())

    def write(self, rows: DataFrame) -> int:
        """Put `rows` in the place of the partitions they are in; all other partitions stay. Returns the new version."""
        known = self.versions()
        live = self.manifest(known[-1]) if known else {}
        started = [int(name.split("=")[1]) for sub in ("data", "manifest") for name in self._files(sub) if name.startswith("version=")]
        version = max(started, default=0) + 1  # also above versions that were never finished
        rows = session.cut(rows)
        files = max(1, math.ceil((session.estimated_bytes(rows) or 0) / session.BYTES_PER_SHUFFLE_PARTITION))
        slot = F.pmod(F.xxhash64(*[f.name for f in self.schema.fields if f.name != self.partition]), F.lit(files))
        rows.repartition(F.col(self.partition), slot).write.partitionBy(self.partition).parquet(f"{self.path}/data/version={version}")
        live |= {row[0]: version for row in rows.select(F.col(self.partition).cast("string")).distinct().collect()}
        self.spark.createDataFrame(list(live.items()), "value string, at long").coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")
        return version

    def clean(self, keep: int = 1) -> list[int]:
        """Delete what neither of the last `keep` versions reads, and unfinished versions; returns the versions whose data went."""
        known = self.versions()
        kept = known[-keep:]
        read = {at for version in kept for at in self.manifest(version).values()}
        conf, gone = self.spark._jsc.hadoopConfiguration(), []
        for sub, live in (("manifest", set(kept)), ("data", read)):
            for name in self._files(sub):
                number = int(name.split("=")[1]) if name.startswith("version=") else None
                if number is not None and number not in live:
                    target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}/{name}")
                    target.getFileSystem(conf).delete(target, True)
                    gone += [number] if sub == "data" else []
        return sorted(gone)


def upsert_versions(new: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], partition: str) -> int:
    """Upsert into a `Versioned` table: the partitions with new rows are merged into a new version, which appears at once.

    The touched values (few, such as weeks) reach the driver, and so does the manifest (one row per partition). One writer at a time.
    """
    table = Versioned(new.sparkSession, path, new.schema, partition)
    touched = [row[0] for row in new.select(F.col(partition).cast("string")).distinct().collect()]
    if not touched:
        return (table.versions() or [0])[-1]
    existing = table.read(touched).select(*new.columns)
    return table.write(upsert(existing, new, keys, newest))
