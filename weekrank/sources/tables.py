"""Reading and writing tables: CSV with lenient typing, Parquet between stages, JSON reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas
from weekrank.functions import dates

_CSV = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"'}


def exists(spark: SparkSession, path: str) -> bool:
    """True when the path holds something, on any file system Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             types: dict[str, T.DataType] | None = None, parse_dates: Sequence[str] = (), safe: bool = False,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header. Cells are read as text, NA tokens become null, bad cells become null.

    Without `safe`, an absent column is an error; with it, only the columns that exist are read.
    `multi_line` allows line breaks inside quotes, at the price of one task per file.
    """
    raw = spark.read.options(**_CSV, multiLine=multi_line).csv(path)
    wanted = list(columns) if columns else raw.columns
    absent = [c for c in wanted if c not in raw.columns]
    if absent and not safe:
        raise ValueError(f"columns {absent} are not in {path}")
    kinds = types or {}

    def cell(name: str):
        value = F.col(f"`{name}`")
        value = F.when(~value.isin(schemas.NA_TOKENS), value)
        if name in parse_dates:
            return dates.parse_text(value).alias(name)
        return (value.try_cast(kinds[name]) if name in kinds else value).alias(name)

    return raw.select(*[cell(c) for c in wanted if c in raw.columns])


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV folder with a header per file; timestamps as `YYYY-MM-DD HH:MM:SS`."""
    writer = df.write.mode("append" if append else "overwrite").options(
        **_CSV, lineSep="\n", timestampFormat="yyyy-MM-dd HH:mm:ss", timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
        nullValue="", emptyValue="")
    writer.csv(path)


def write_table(df: DataFrame, path: str, append: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Parquet, the format between stages."""
    df.write.mode("append" if append else "overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A metrics table as JSON lines."""
    df.write.mode("overwrite").json(path)


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table, or an empty one of the same schema when it has not been written yet."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_inputs(spark: SparkSession, folder: str, required: str = "scrobbles", register: bool = False,
                fmt: str = "parquet") -> dict[str, DataFrame] | None:
    """The seven curated tables by name. None without the event table; absent others are left out."""
    found = {}
    for name, schema in schemas.INPUT_TABLES.items():
        path = f"{folder.rstrip('/')}/{name}.{fmt}"
        if not exists(spark, path):
            continue
        if fmt == "csv":
            found[name] = read_csv(spark, path, schema.names, {f.name: f.dataType for f in schema.fields}, safe=True)
        else:
            found[name] = spark.read.format(fmt).load(path)
        if register:
            found[name].createOrReplaceTempView(name)
    return found if required in found else None
