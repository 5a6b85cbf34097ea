"""Split, encode, fit, evaluate and score on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas, session
from weekrank.operators import encode, evaluate, joins, model, ordered, score
from weekrank.plans import training
from weekrank.plans.weekly_table import model_view
from weekrank.queries.common import ORDERS_CTE, SEGMENT, order_events, order_weekly, r, report, tables
from weekrank.queries.weekly import TABLE_CTE, feature_table
from weekrank.sources import artifacts

QUERIES: dict = {}
SQL: dict = {}

# --- split and encode ---------------------------------------------------------------------------


def time_split(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly rows per span of the 60/20/20 split, for both boundary rules."""
    base = session.cut(order_weekly(spark, folder))
    reports = []
    for rule in ("exclusive", "inclusive"):
        labelled = encode.time_split(base, boundary=rule).labelled(base)
        reports.append(labelled.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.min(schemas.WEEK).alias("first"), F.max(schemas.WEEK).alias("last"))
            .withColumn("rule", F.lit(rule)))
    return report(ordered.union_all(*reports))


_WEEKS = "k AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM w))"


def _split_sql(rule: str) -> str:
    train, val = ("floor(n * 0.6)", "floor(n * 0.6) + floor(n * 0.2)") if rule == "exclusive" else (
        "floor(n * 0.6) + 1", "floor(n * 0.8) + 1")
    return f"CASE WHEN i <= {train} THEN 'train' WHEN i <= {val} THEN 'val' ELSE 'test' END"


QUERIES["time_split"] = time_split
SQL["time_split"] = f"WITH {TABLE_CTE}, {_WEEKS} " + " UNION ALL ".join(
    f"SELECT {_split_sql(rule)} AS split, count(*) AS n, CAST(min(w.week) AS VARCHAR) AS first, CAST(max(w.week) AS VARCHAR) AS last, "
    f"'{rule}' AS rule FROM w JOIN k ON w.week = k.week GROUP BY 1" for rule in ("exclusive", "inclusive"))


def one_hot_fit_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Levels fitted on the training weeks and applied to all spans: the rows each 0/1 column marks."""
    base = session.cut(order_weekly(spark, folder)).withColumn(
        "category", F.when(F.col("o_orderpriority") != "5-LOW", F.concat_ws("/", "c_mktsegment", F.substring("o_orderpriority", 1, 1))))
    split = encode.time_split(base)
    train = split.train(base)
    encoder = encode.fit_one_hot(train, "category", 168, "cat")
    spans = [encoder.fit_transform(train), encoder.transform(split.validation(base)), encoder.transform(split.test(base))]
    reports = [
        span.unpivot([], [F.col(f"`{n}`") for n in encoder.names], "feature", "value").filter("value = 1")
        .groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.lit(name))
        for name, span in zip(("train", "val", "test"), spans)
    ]
    return report(ordered.union_all(*reports))


QUERIES["one_hot_fit_apply"] = one_hot_fit_apply
SQL["one_hot_fit_apply"] = f"""
WITH {TABLE_CTE}, {_WEEKS}, s AS (SELECT w.*, {_split_sql('exclusive')} AS split, coalesce(CASE WHEN o_orderpriority <> '5-LOW'
    THEN c_mktsegment || '/' || substr(o_orderpriority, 1, 1) END, 'unknown') AS category FROM w JOIN k ON w.week = k.week),
kept AS (SELECT category AS kc FROM s WHERE split = 'train' GROUP BY category HAVING count(*) >= 168)
SELECT 'cat__' || CASE WHEN kc IS NULL THEN 'other' ELSE category END AS feature, count(*) AS n, split
FROM s LEFT JOIN kept ON category = kc WHERE split = 'train' OR kc IS NOT NULL GROUP BY 1, 3"""


def one_hot_many_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per level and span where nearly every line item is a level of its own, and no level is a column."""
    items = tables(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", F.col("l_linenumber") % 3).alias("key"), F.date_trunc("week", "l_shipdate").alias("week"))
    items = session.cut(items)
    split = encode.time_split(items, "week")
    levels = encode.fit_levels(split.train(items), "key", 1)
    train = encode.with_level(split.train(items), "key", levels, True)
    rest = encode.with_level(items.filter(F.col("week") > F.lit(split.train_until)), "key", levels, False)
    marked = split.labelled(train.unionByName(rest)).filter("level IS NOT NULL").groupBy("level", "split").agg(F.count(F.lit(1)).alias("n"))
    return report(joins.lookup(marked, session.cut(encode.numbered_levels(levels)), ["level"], spread_by=["level", "split"]))


QUERIES["one_hot_many_levels"] = one_hot_many_levels
SQL["one_hot_many_levels"] = f"""
WITH w AS (SELECT concat_ws('-', l_orderkey, l_linenumber % 3) AS key, date_trunc('week', l_shipdate) AS week FROM lineitem), {_WEEKS},
s AS (SELECT w.*, {_split_sql('exclusive')} AS split FROM w JOIN k ON w.week = k.week),
kept AS (SELECT key AS level, row_number() OVER (ORDER BY key) - 1 AS level_index FROM s WHERE split = 'train' GROUP BY key)
SELECT level, split, count(*) AS n, level_index FROM s JOIN kept ON key = level GROUP BY ALL"""

# --- metrics with a score that is a column expression -------------------------------------------

_LABEL_SQL = "CASE WHEN c_acctbal * 30 + o_totalprice > 500000 THEN 1 ELSE 0 END"
_SCORED_CTE = (f"{ORDERS_CTE}, s AS (SELECT *, round(o_totalprice / 500000, 3) AS p, {_LABEL_SQL} AS y FROM oe)")
_CURVE_CTE = (
    f"{_SCORED_CTE}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p), "
    "c AS (SELECT p AS threshold, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS P1, "
    "sum(neg) OVER () AS N1 FROM g WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return order_events(spark, folder).withColumns({
        "probability": F.round(F.col("o_totalprice") / 500000, 3), "is_week_favorite": (F.col("c_acctbal") * 30 + F.col("o_totalprice") > 500000).cast("int")})


def score_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Positives and negatives at and above every distinct score."""
    return report(evaluate.score_curve(_scored(spark, folder)).drop("P", "N"))


QUERIES["score_curve"] = score_curve
SQL["score_curve"] = (f"WITH {_CURVE_CTE} SELECT {r('threshold')} AS threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, "
                      "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    """ROC-AUC of the score."""
    return report(evaluate.area_metrics(_scored(spark, folder)).select("roc_auc"))


QUERIES["roc_auc"] = roc_auc
SQL["roc_auc"] = f"""
WITH {_SCORED_CTE}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s),
a AS (SELECT CAST(sum(CASE WHEN y = 1 THEN rk END) AS DOUBLE) AS rs, CAST(sum(y) AS DOUBLE) AS P1, CAST(sum(1 - y) AS DOUBLE) AS N1 FROM k)
SELECT {r('(rs - P1 * (P1 + 1) / 2) / (P1 * N1)')} AS roc_auc FROM a"""


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Average precision of the score."""
    return report(evaluate.area_metrics(_scored(spark, folder)).select("pr_auc"))


QUERIES["average_precision"] = average_precision
SQL["average_precision"] = (
    f"WITH {_CURVE_CTE} SELECT {r('sum(CAST(tp AS DOUBLE) / (tp + fp) * pos / P1)')} AS pr_auc FROM c")


def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return report(evaluate.roc_points(_scored(spark, folder)))


QUERIES["roc_points"] = roc_points
SQL["roc_points"] = (f"WITH {_CURVE_CTE} SELECT {r('threshold')} AS threshold, {r('CAST(fp AS DOUBLE) / N1')} AS fpr, "
                     f"{r('CAST(tp AS DOUBLE) / P1')} AS tpr FROM c")


def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold with the highest F1."""
    return report(evaluate.best_threshold(_scored(spark, folder)))


QUERIES["best_threshold"] = best_threshold
SQL["best_threshold"] = f"""
WITH {_CURVE_CTE} SELECT {r('threshold')} AS threshold, {r('CAST(tp AS DOUBLE) / (tp + fp)')} AS precision,
  {r('CAST(tp AS DOUBLE) / P1')} AS recall, {r('CAST(2 * tp AS DOUBLE) / (tp + fp + P1)')} AS f1 FROM c
ORDER BY CAST(2 * tp AS DOUBLE) / (tp + fp + P1) DESC, c.threshold LIMIT 1"""

_COUNTS_SQL = ("count(*) FILTER (WHERE y = 1 AND p >= 0.6) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.6) AS fp, "
               "count(*) FILTER (WHERE y = 1 AND p < 0.6) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.6) AS tn")


def holdout_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts and rates at one threshold, beside the areas."""
    return report(evaluate.holdout_metrics(_scored(spark, folder), 0.6))


QUERIES["holdout_metrics"] = holdout_metrics
SQL["holdout_metrics"] = f"""
WITH {_CURVE_CTE}, t AS (SELECT {_COUNTS_SQL} FROM s),
area AS (SELECT sum(CAST(neg AS DOUBLE) * (tp - pos + pos / 2.0)) / (max(P1) * CAST(max(N1) AS DOUBLE)) AS roc_auc,
  sum(CAST(tp AS DOUBLE) / (tp + fp) * pos / P1) AS pr_auc FROM c)
SELECT {r('roc_auc')} AS roc_auc, {r('pr_auc')} AS pr_auc, 0.6::DOUBLE AS threshold, {r('tp / CAST(tp + fp AS DOUBLE)')} AS precision,
  {r('tp / CAST(tp + fn AS DOUBLE)')} AS recall, {r('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)')} AS f1, tp, fp, fn, tn FROM t, area"""


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall, F1 and support per class and on average."""
    return report(evaluate.class_report(_scored(spark, folder), 0.6))


QUERIES["class_report"] = class_report
SQL["class_report"] = f"""
WITH {_SCORED_CTE}, t AS (SELECT {_COUNTS_SQL} FROM s),
k AS (SELECT '0' AS class, tn / CAST(tn + fn AS DOUBLE) AS p, tn / CAST(tn + fp AS DOUBLE) AS q, 2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f,
    tn + fp AS n, tn AS hit FROM t
  UNION ALL SELECT '1', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE), 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), tp + fn, tp FROM t),
u AS (SELECT class, p, q, f, n FROM k
  UNION ALL SELECT 'accuracy', sum(hit) / CAST(sum(n) AS DOUBLE), sum(hit) / CAST(sum(n) AS DOUBLE), sum(hit) / CAST(sum(n) AS DOUBLE), sum(n) FROM k
  UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f), sum(n) FROM k
  UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(q * n) / sum(n), sum(f * n) / sum(n), sum(n) FROM k)
SELECT class, {r('p')} AS precision, {r('q')} AS recall, {r('f')} AS f1, CAST(n AS BIGINT) AS support FROM u"""

_BEST = "row_number() OVER (PARTITION BY week ORDER BY p DESC, o_orderkey)"


def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Share of weeks whose labelled order is first, or among the first three, by score."""
    scored = _scored(spark, folder).withColumn("is_week_favorite", (F.col("c_acctbal") > 9500).cast("int"))
    return report(evaluate.hit_rates(scored, 3, week=schemas.WEEK, tie_break=["o_orderkey"]))


QUERIES["hit_at_k"] = hit_at_k
SQL["hit_at_k"] = f"""
WITH {_SCORED_CTE}, k AS (SELECT week, CASE WHEN c_acctbal > 9500 THEN 1 ELSE 0 END AS y, {_BEST} AS rn FROM s),
h AS (SELECT week, max(CASE WHEN rn = 1 THEN y ELSE 0 END) AS one, max(CASE WHEN rn <= 3 THEN y ELSE 0 END) AS three, max(y) AS has FROM k GROUP BY week)
SELECT count(*) AS n_weeks, {r('avg(one)')} AS hit_at_1, {r('avg(three)')} AS hit_at_3 FROM h WHERE has = 1"""


def topk_table(spark: SparkSession, folder: str) -> DataFrame:
    """The five best orders of every week."""
    return report(evaluate.top_table(_scored(spark, folder), 5, week=schemas.WEEK, entity=["o_orderkey"]))


QUERIES["topk_table"] = topk_table
SQL["topk_table"] = f"""
WITH {_SCORED_CTE}, k AS (SELECT *, {_BEST} AS rn FROM s)
SELECT CAST(week AS VARCHAR) AS week_saturday_utc, rn AS rank, o_orderkey, {r('p')} AS probability,
  CASE WHEN y = 1 THEN 'Yes' ELSE '' END AS is_true_favorite FROM k WHERE rn <= 5"""


def group_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's orders as one request: threshold for a single one, one winner among several."""
    scored = _scored(spark, folder).select(F.col("c_custkey").alias("request_id"),
                                           F.col("o_orderkey").alias("index"), "probability")
    return report(score.decide(scored, 0.6))


QUERIES["group_decision"] = group_decision
SQL["group_decision"] = f"""
WITH {_SCORED_CTE}, k AS (SELECT o_custkey AS request_id, o_orderkey AS idx, p, count(*) OVER (PARTITION BY o_custkey) AS n_tracks,
  first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey) AS winner_index FROM s)
SELECT request_id, idx AS index, {r('p')} AS probability, n_tracks, winner_index, 0.6::DOUBLE AS threshold,
  CASE WHEN n_tracks = 1 THEN 'single_threshold' ELSE 'ranking' END AS mode, CAST(p >= 0.6 AS BIGINT) AS above_threshold,
  CAST(CASE WHEN n_tracks = 1 THEN p >= 0.6 ELSE idx = winner_index END AS BIGINT) AS prediction FROM k"""

# --- fits (no SQL form) -------------------------------------------------------------------------


def _prepared(spark: SparkSession, folder: str) -> training.Prepared:
    table = session.cut(feature_table(spark, folder).withColumn("genre_bucket", F.col("c_mktsegment")))
    return training.prepare(model_view(table, "1995-06-03"), min_freq=20)


def logreg_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Final logistic regression: tuned on validation, refitted, test metrics."""
    return report(training.train_final(_prepared(spark, folder)).metrics)


def logreg_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Validation areas of three feature sets: static, static and category, all."""
    data = _prepared(spark, folder)
    static = [c for c in model.STATIC_FEATURES if c in data.features]
    category = [c for c in data.features if c.startswith("genre__")]
    n = data.train.count()
    fits = {name: model.fit_logistic(data.train, cols, rows=n)
            for name, cols in (("static", static), ("static_genre", static + category), ("full", data.features))}
    rows = [evaluate.area_metrics(model.with_probability(data.validation, fit)).select(F.lit(name).alias("model"), "*")
            for name, fit in fits.items()]
    return report(ordered.union_all(*rows))


def logreg_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Validation areas per regularisation strength, best average precision first."""
    data = _prepared(spark, folder)
    return report(model.sweep_logistic(data.train, data.validation, data.features))


def gbt_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Validation areas of two depths with up to 40 trees, one fit each, then of learning and sampling around one of them."""
    data = _prepared(spark, folder)
    capacity = model.sweep_capacity(data.train, data.validation, data.features, grid={"maxDepth": [3, 5], "maxIter": [10, 20, 40]})
    sampling = model.sweep_sampling(data.train, data.validation, data.features, capacities=[{"maxDepth": 4, "maxIter": 10}], grid={
        "stepSize": [0.05, 0.1], "minChildWeight": [5], "subsamplingRate": [0.8], "featureSubset": [0.6]})
    return report(ordered.union_all(capacity, sampling, fill=True).orderBy(F.desc("pr_auc"), "model"))


def coef_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest standardised coefficients."""
    data = _prepared(spark, folder)
    fit = model.fit_logistic(data.train, data.features, c=model.BEST_C, scale=True)
    return report(model.leaderboard(model.coefficients(spark, fit, data.features), 20))


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression against boosted trees on the test weeks: areas, hit rates, threshold metrics."""
    data = _prepared(spark, folder)
    trained = training.train_final(data)
    settings = dict(maxDepth=4, maxIter=5, stepSize=0.1)
    first = model.fit_trees(data.train, data.features, **settings)
    own = evaluate.best_threshold(model.with_probability(data.validation, first)).first()["threshold"]
    classes = data.train.agg(F.count_if(F.col(schemas.LABEL) == 1).alias("p"), F.count_if(F.col(schemas.LABEL) == 0).alias("q")).first()
    weight = classes["q"] / classes["p"] if classes["p"] else 1.0
    trees = model.fit_trees(data.train.unionByName(data.validation), data.features, weight=weight, **settings)
    rows = [model.model_summary(name, scored, threshold, tie_break=SEGMENT)
            for name, scored, threshold in (("logreg", trained.scored_test, trained.artifacts.threshold), ("gbt", model.with_probability(data.test, trees), own))]
    return report(ordered.union_all(*rows))


def batch_score(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as JSON (one per week), scored with a stored and reloaded model, decided per request."""
    data = _prepared(spark, folder)
    path = session.scratch_path(spark, "model")
    artifacts.save(training.train_final(data).artifacts, path)
    stored = artifacts.load(spark, path)
    candidate = T.StructType([T.StructField(c, T.DoubleType()) for c in schemas.CORE_FEATURES]
                             + [T.StructField("genre_bucket", T.StringType())])
    # A week has at most one row per segment and priority, so a payload is small.
    rows = data.test.select(schemas.WEEK, F.struct(*[c for c in candidate.names if c in data.test.columns]).alias("c"))
    requests = rows.groupBy(F.col(schemas.WEEK).alias("request_id")).agg(
        F.to_json(F.struct(F.sort_array(F.collect_list("c")).alias("tracks"))).alias("payload"))
    parsed = score.parse_requests(requests, candidate)
    scored = score.score(parsed, stored.model, stored.encoder, stored.features, stored.threshold)
    scored = session.cut(scored.select("request_id", "index", "probability"))  # read by the winners and by the rows
    return report(score.decide(scored, stored.threshold))


for _query in (logreg_scores, logreg_baselines, logreg_grid, gbt_grid, coef_leaderboard, model_comparison, batch_score):
    QUERIES[_query.__name__] = _query
