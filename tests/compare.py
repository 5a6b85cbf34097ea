"""Compare registered queries with their SQL on DuckDB: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normalised(frame):
    """Sorted text rows over the columns in name order."""
    import pandas as pd

    columns = sorted(frame.columns)

    def text(value):
        if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
            return "NULL"
        if isinstance(value, float) and value.is_integer():
            return str(int(value))
        return str(value)

    rows = [tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return columns, sorted(rows)


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def differences(spark, folder: str, names=None) -> dict[str, str]:
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    connection = duck(folder)
    bad = {}
    for name in names or queries:
        started = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - started
            if name not in sql:
                print(f"rows   {name:28s} {len(got):8d} {took:6.2f}s", flush=True)
                continue
            want = connection.execute(sql[name]).df()
            a, b = normalised(got), normalised(want)
        except Exception as error:  # report and go on
            bad[name] = str(error).split("JVM stacktrace")[0][:600]
            print(f"ERROR  {name}: {bad[name]}", flush=True)
            continue
        if a == b:
            print(f"ok     {name:28s} {len(got):8d} {took:6.2f}s", flush=True)
            continue
        if a[0] != b[0]:
            bad[name] = f"columns {a[0]} / {b[0]}"
        else:
            only = [x for x in a[1] if x not in set(b[1])][:2]
            other = [x for x in b[1] if x not in set(a[1])][:2]
            bad[name] = f"{len(a[1])}/{len(b[1])} rows; {a[0]}\n   spark {only}\n   sql   {other}"
        print(f"DIFF   {name}: {bad[name]}", flush=True)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    where = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "12g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    failed = differences(session, where, args or None)
    print(f"{len(failed)} differ: {sorted(failed)}")
    session.stop()
