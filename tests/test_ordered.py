import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weekrank.operators import ordered


def numbers(spark, n=500, seed=2):
    rng = random.Random(seed)
    rows = [(i, float(rng.choice([0, 0, 0, rng.randint(0, 30)])), None if rng.random() < 0.2 else rng.gauss(0, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_running_totals(spark):
    df = numbers(spark).groupBy((F.col("id") % 3).alias("g"), "a").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("m"))
    for down in (False, True):
        got = ordered.running_totals(df, "a", ["n", "m"], ["g"], descending=down).toPandas().sort_values(["g", "a"], ascending=[True, not down])
        assert (got.groupby("g")["n"].cumsum() == got["n_through"]).all()
        assert (got.groupby("g")["m"].cumsum() == got["m_through"]).all()


def test_running_number(spark):
    df = numbers(spark, 300).select("a", "id").repartition(5)
    got = ordered.running_number(df, ["a", "id"], "k", 40).toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(41, 341))
    assert got[["a", "id"]].values.tolist() == sorted(got[["a", "id"]].values.tolist())


def test_quantiles_and_ranks_equal_pandas(spark):
    df = numbers(spark)
    pdf = df.toPandas()
    got = ordered.quantiles(df, ["a", "b"], {"q1": 0.25, "q2": 0.5, "q9": 0.9}).toPandas().set_index("column")
    for c in ("a", "b"):
        want = pdf[c].quantile([0.25, 0.5, 0.9]).values
        assert np.allclose(got.loc[c, ["q1", "q2", "q9"]].astype(float), want)
    ranks = ordered.average_ranks(df, ["a", "b"]).toPandas()
    for c in ("a", "b"):
        want = pd.DataFrame({"v": pdf[c].dropna(), "r": pdf[c].dropna().rank()}).groupby("v")["r"].first()
        mine = ranks[ranks["column"] == c].set_index("value")["rank"].sort_index()
        assert np.allclose(mine.values, want.sort_index().values)


def test_slices_and_unions(spark):
    df = spark.range(200).select("id")
    assert [r[0] for r in ordered.row_slice(df, 49, 100, F.desc("id")).collect()] == list(range(150, 99, -1))
    assert [r[0] for r in ordered.top(df, 2, F.desc("id")).collect()] == [199, 198]
    both = ordered.union_all(df.limit(1), df.limit(1).withColumn("x", F.lit(1)), fill=True)
    assert both.columns == ["id", "x"] and both.count() == 2
    one = ordered.beside(df.agg(F.max("id").alias("a")), df.agg(F.min("id").alias("b")))
    assert tuple(one.first()) == (199, 0)
