"""Queries on orders whose weekly labels are all the same."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import normalised
from weekrank.operators import compiled
from weekrank.queries import registry


@pytest.fixture(scope="module", params=[480000.0, 1000.0], ids=["positive", "negative"])
def folder(request, spark, tmp_path_factory):
    """Twelve weeks of orders, every one of them above the label's price or every one below."""
    at = str(tmp_path_factory.mktemp("one_class"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
    customers = [(i, f"c{i}", i % 3, 10.0, s) for i, s in enumerate(segments)]
    start = datetime.datetime(2024, 1, 7, 12)
    days = [(week, c, n) for week in range(12) for c in range(4) for n in range(1 + (week * 5 + c * 3) % 7)]
    orders = [(i, c, "O", request.param + i, start + datetime.timedelta(weeks=week, days=n % 6), ["1-URGENT", "2-HIGH"][n % 2])
              for i, (week, c, n) in enumerate(days)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


def agrees(spark, folder, name):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in ("customer", "orders"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = normalised(registry.QUERIES[name](spark, folder).toPandas())
    assert got == normalised(connection.execute(registry.SQL[name]).df())
    return got


def test_correlation_with_a_constant_label_is_not_a_number(spark, folder):
    columns, rows = agrees(spark, folder, "pearson")
    assert len(rows) == 5 and {r[columns.index("correlation")] for r in rows} == {"NULL"}  # the frames' NaN


def test_a_model_without_a_finite_intercept_is_stored_and_scores(spark, folder):
    columns, rows = agrees(spark, folder, "stored_scoring")
    assert len(rows) > 0 and len({r[columns.index("probability")] for r in rows}) == 1


def test_a_literal_of_every_double():
    values = [float("inf"), float("-inf"), 0.1, -1e300]
    found = duckdb.sql(f"SELECT {', '.join(map(compiled.number, [*values, float('nan')]))}").fetchall()[0]
    assert list(found[:4]) == values and found[4] != found[4]


def test_literals_in_spark(spark):
    values = [float("inf"), float("-inf"), 0.1, -1e300]
    assert list(spark.range(1).select(*[F.expr(compiled.number(v)) for v in values]).first()) == values


def test_trees_without_a_split_take_the_first_cut(spark, folder):
    columns, rows = agrees(spark, folder, "stump_rounds")
    assert len(rows) == 4 and {r[columns.index("feature")] for r in rows} == {"scrobbles_week"}
