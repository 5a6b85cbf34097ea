"""Versioned partitions: swapped at once, old versions stay readable until they are cleaned."""

import pytest
from pyspark.sql import functions as F

from weekrank.operators import merge

SCHEMA = "name string, at int, week string"
KEYS = ["name", "week"]


def put(spark, path, *rows):
    return merge.upsert_versions(spark.createDataFrame(list(rows), SCHEMA), path, KEYS, ["at"], "week")


def table(spark, path):
    return merge.Versioned(spark, path, spark.createDataFrame([], SCHEMA).schema, "week")


def test_touched_partitions_move_to_a_new_version(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    assert rows(table(spark, path).read()) == [] and table(spark, path).versions() == []
    assert put(spark, path, ("a", 1, "w1"), ("b", 1, "w1"), ("a", 1, "w2"), ("n", 1, None)) == 1
    assert put(spark, path, ("a", 2, "w1"), ("c", 1, "w/3 =x"), ("n", 0, None)) == 2
    now = [("a", 1, "w2"), ("a", 2, "w1"), ("b", 1, "w1"), ("c", 1, "w/3 =x"), ("n", 1, None)]
    t = table(spark, path)
    assert rows(t.read()) == now
    assert rows(t.read(version=1)) == [("a", 1, "w1"), ("a", 1, "w2"), ("b", 1, "w1"), ("n", 1, None)]
    assert rows(t.read(["w/3 =x", None, "none"])) == [("c", 1, "w/3 =x"), ("n", 1, None)]
    assert t.manifest(2) == {"w1": 2, "w2": 1, "w/3 =x": 2, None: 2}
    # The same rows again change nothing, and an empty batch makes no version.
    put(spark, path, ("a", 2, "w1"))
    assert rows(t.read()) == now and t.versions() == [1, 2, 3]
    assert merge.upsert_versions(spark.createDataFrame([], SCHEMA), path, KEYS, ["at"], "week") == 3
    assert t.clean() == [] and rows(t.read()) == now and t.versions() == [3]
    put(spark, path, ("a", 9, "w1"), ("a", 9, "w2"))
    assert t.clean() == [1, 3] and len(rows(t.read())) == 5


@pytest.mark.parametrize("lost", ["data", "manifest"])
def test_a_run_that_is_lost_leaves_the_old_table(spark, tmp_path, rows, monkeypatch, lost):
    path = str(tmp_path / "t")
    put(spark, path, ("a", 1, "w1"), ("a", 1, "w2"))
    old = rows(table(spark, path).read())
    with monkeypatch.context() as patch:
        if lost == "manifest":
            patch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, f=type(spark).createDataFrame: (_ for _ in ()).throw(RuntimeError("lost"))
                          if schema == "value string, at long" else f(self, data, schema))
            with pytest.raises(RuntimeError):
                put(spark, path, ("a", 2, "w1"), ("a", 2, "w2"))
        else:  # one of two partitions is written, then the run ends
            bad = F.when(F.col("week") == "w2", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("at"))
            with pytest.raises(Exception, match="lost"):
                table(spark, path).write(spark.createDataFrame([("a", 2, "w1"), ("a", 2, "w2")], SCHEMA).withColumn("at", bad))
            spark.createDataFrame([("half", 2, "w1")], SCHEMA).write.partitionBy("week").parquet(f"{path}/data/version=2")
    t = table(spark, path)
    assert rows(t.read()) == old and t.versions() == [1]
    assert put(spark, path, ("a", 3, "w1")) == 3  # above the unfinished one
    assert rows(t.read()) == [("a", 1, "w2"), ("a", 3, "w1")]
    assert 2 in t.clean() and rows(t.read()) == [("a", 1, "w2"), ("a", 3, "w1")]
