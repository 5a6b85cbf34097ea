import numpy as np

from weekrank.llm import graph

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, s string"


def rows_of(x):
    return [(i, [float(f) for f in v], "clash", "clash", "clash") for i, v in enumerate(x)]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 1, (40, 32))[rng.integers(0, 40, 1500)] + rng.normal(0, 0.7, (1500, 32))).astype(np.float32)
    x[100:130] = x[7]
    odd = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0]), (5004, [None] * 32), (None, [1.0] * 32)]
    vectors = graph.usable(spark.createDataFrame(rows_of(x) + [(a, b, None, None, None) for a, b in odd], SCHEMA))
    got = graph.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, shard=400).toPandas()
    exact, hits = x.astype(float) @ x.astype(float).T, 0
    assert len(got) == 75 * 20
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part["vec_id"])
        assert np.allclose(part["score"], exact[q, part["vec_id"]], rtol=1e-12)
        others = np.delete(np.arange(1500), q)
        best = others[np.lexsort((others, -exact[q, others]))][:20]
        hits += len(set(best) & set(part["vec_id"]))
    assert hits >= 0.9 * 75 * 20


def test_few_and_none(spark):
    few = graph.usable(spark.createDataFrame(rows_of(np.eye(3)), SCHEMA))
    got = graph.nearest(few, few.filter("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    none = few.limit(0)
    assert graph.nearest(none, none).count() == 0


def test_a_third_of_the_rows_are_one_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (900, 16)).astype(np.float32)
    x[rng.permutation(900)[:300]] = x[5] * 2
    x[40:60] = x[41]
    vectors = graph.usable(spark.createDataFrame(rows_of(x), SCHEMA))
    got = graph.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, shard=150, block=20, groups=3).toPandas()
    exact = x.astype(float) @ x.astype(float).T
    assert len(got) == 45 * 20 and not got.duplicated(["query_id", "vec_id"]).any()
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        others = np.delete(np.arange(900), q)
        best = others[np.lexsort((others, -exact[q, others]))][:20]
        hits += len(set(best) & set(part["vec_id"]))
        if exact[q].max() == exact[q, 5] or (exact[q] == exact[q].max()).sum() >= 21:
            assert list(part["vec_id"]) == list(best)
    assert hits >= 0.97 * 45 * 20
