"""Fits whose results SQL reaches on its own: Newton's method for logistic regression, closed-form stumps for boosting.

The weekly table of segments is cut down to two numbers and one category, so that the normal equations stay small enough to be
written out. The fits go through the same library code as those over all features.
"""

from __future__ import annotations

from math import isclose

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas, session
from weekrank.operators import compiled, encode, evaluate, joins, model, ordered, score
from weekrank.plans import training
from weekrank.queries.common import ORDERS_CTE, SEGMENT, order_weekly, report, tables, weekly_cte
from weekrank.queries.modelling import _WEEKS, _split_sql
from weekrank.sources import artifacts

QUERIES: dict = {}
SQL: dict = {}

TOL = 1e-11  # fits that are compared with an exact solution run until nothing changes
MIN_FREQ = 200
NUMBERS = ["scrobbles_week", "unique_days_week"]
LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "other", "unknown"]
X = [*NUMBERS, *[f"genre__{level}" for level in LEVELS]]
ROUNDS = [1, 2, 4]


def view(spark: SparkSession, folder: str) -> DataFrame:
    """Segment, week, two counts, the label and a category with a rare level and gaps."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    bucket = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING") | ((F.col("c_mktsegment") == "FURNITURE") & urgent), F.col("c_mktsegment"))
    return order_weekly(spark, folder).withColumn("genre_bucket", bucket).select(
        *SEGMENT, schemas.WEEK, schemas.WEEK_TS, *NUMBERS, "genre_bucket", schemas.LABEL)


def prepared(spark: SparkSession, folder: str) -> training.Prepared:
    return training.prepare(view(spark, folder), min_freq=MIN_FREQ)


# --- SQL: the rows, the normal equations and Newton's method ------------------------------------------------------------

_COLUMNS = ", ".join([*NUMBERS, *[f"CAST(coalesce(level, '') = '{level}' AS INT) AS \"genre__{level}\"" for level in LEVELS]])
#: Rows with their span, their encoded category when fitting and when applying, and the label.
ROWS = f"""{ORDERS_CTE}, {weekly_cte('w', 'oe', SEGMENT, 'o_orderdate', 'label')}, {_WEEKS},
b AS MATERIALIZED (SELECT w.*, {_split_sql('exclusive')} AS split, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
    OR (c_mktsegment = 'FURNITURE' AND o_orderpriority = '1-URGENT') THEN c_mktsegment END AS bucket FROM w JOIN k ON w.week = k.week),
lv AS MATERIALIZED (SELECT coalesce(bucket, 'unknown') AS bucket, count(*) >= {MIN_FREQ} AS own FROM b WHERE split = 'train' GROUP BY 1),
e AS (SELECT b.*, CASE WHEN split = 'train' THEN CASE WHEN lv.own THEN lv.bucket ELSE 'other' END
    WHEN lv.own THEN lv.bucket END AS level, is_week_favorite AS y FROM b LEFT JOIN lv ON coalesce(b.bucket, 'unknown') = lv.bucket),
x AS MATERIALIZED (SELECT c_mktsegment, o_orderpriority, week, split, y, bucket, {_COLUMNS} FROM e),
have AS (SELECT DISTINCT 'genre__' || CASE WHEN own THEN bucket ELSE 'other' END AS feature FROM lv)"""


def newton(data: str, names: list[str], steps: int = 12) -> str:
    """SQL of the table `best` (fit, c, w_0 ...): Newton steps for every fit of `data` (fit, c, y and the columns).

    Each step sums the normal equations (a_i_j for i <= j, b_i), eliminates column by column, and puts the solution in from the end.
    """
    n = len(names) + 1
    x = ["1.0", *[f'"{f}"' for f in names]]
    z = " + ".join(f"w_{j} * {x[j]}" for j in range(n))
    ws = ", ".join(f"w_{j}" for j in range(n))
    sums = [f"sum(p * (1 - p) * {x[i]} * {x[j]}){' + 1.0 / c' if i == j and i else ''} AS a_{i}_{j}" for i in range(n) for j in range(i, n)]
    sums += [f"sum((p - y) * {x[j]}){f' + w_{j} / c' if j else ''} AS b_{j}" for j in range(n)]
    out = [f"nw_0 AS MATERIALIZED (SELECT DISTINCT fit, c, {', '.join(f'CAST(0 AS DOUBLE) AS w_{j}' for j in range(n))} FROM {data})"]
    for s in range(steps):
        out.append(f"ne_{s}_0 AS MATERIALIZED (SELECT fit, c, {ws}, {', '.join(sums)} FROM (SELECT nw_{s}.*, d.* EXCLUDE (fit, c), 1.0 / (1.0 + exp(-({z}))) AS p "
                   f"FROM nw_{s} JOIN {data} d USING (fit, c)) GROUP BY fit, c, {ws})")
        for k in range(n - 1):
            changed = {f"a_{i}_{j}": f"a_{i}_{j} - a_{k}_{i} / a_{k}_{k} * a_{k}_{j}" for i in range(k + 1, n) for j in range(i, n)}
            changed |= {f"b_{i}": f"b_{i} - a_{k}_{i} / a_{k}_{k} * b_{k}" for i in range(k + 1, n)}
            out.append(f"ne_{s}_{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in changed.items())}) FROM ne_{s}_{k})")
        last = f"ne_{s}_{n - 1}"
        for i in reversed(range(n)):
            rest = "".join(f" - a_{i}_{j} * d_{j}" for j in range(i + 1, n))
            out.append(f"nd_{s}_{i} AS MATERIALIZED (SELECT *, (b_{i}{rest}) / a_{i}_{i} AS d_{i} FROM {last})")
            last = f"nd_{s}_{i}"
        out.append(f"nw_{s + 1} AS MATERIALIZED (SELECT fit, c, {', '.join(f'w_{j} - d_{j} AS w_{j}' for j in range(n))} FROM {last})")
    return ", ".join(out) + f", best AS (SELECT * FROM nw_{steps})"


def _margin(names: list[str]) -> str:
    return " + ".join(["w_0", *[f'w_{j + 1} * "{f}"' for j, f in enumerate(names)]])


def _curve(scored: str, by: str) -> str:
    """SQL of `area` (by, roc_auc, pr_auc, P1, N1) and of the running counts `cv`, from rows (by, y, p)."""
    return (f"g AS (SELECT {by}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {scored} GROUP BY {by}, p), "
            f"cv AS (SELECT {by}, p, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY {by}) AS P1, "
            f"sum(neg) OVER (PARTITION BY {by}) AS N1 FROM g WINDOW d AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), "
            f"area AS (SELECT {by}, sum(CAST(neg AS DOUBLE) * (tp - pos + pos / 2.0)) / (max(P1) * CAST(max(N1) AS DOUBLE)) AS roc_auc, "
            f"sum(CAST(tp AS DOUBLE) / (tp + fp) * pos / P1) AS pr_auc FROM cv GROUP BY {by})")


def _fits(rows: str) -> str:
    return f"WITH {ROWS}, {rows}"


_GRID = ", ".join(f"({c!r})" for c in model.C_GRID)
_GRID_CTE = f"data AS (SELECT 'full' AS fit, CAST(c AS DOUBLE) AS c, x.* FROM x, (VALUES {_GRID}) v(c) WHERE split = 'train')"


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return report(df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in names}))


def logreg_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of the fit for every strength of the grid, rare and missing categories encoded."""
    data = prepared(spark, folder)
    n, tables = data.train.count(), []
    for c in model.C_GRID:
        fit = model.fit_logistic(data.train, data.features, c=c, rows=n, tol=TOL)
        tables.append(model.coefficients(spark, fit, data.features).select(F.lit(float(c)).alias("C"), "feature", "coef"))
    return rounded(ordered.union_all(*tables), 4, "coef")


QUERIES["logreg_coefficients"] = logreg_coefficients
_LONG = " UNION ALL ".join(f"SELECT fit, c, '{f}' AS feature, w_{j + 1} AS coef FROM best" for j, f in enumerate(X))
_PRESENT = f"(feature IN ({', '.join(repr(f) for f in NUMBERS)}) OR feature IN (SELECT feature FROM have))"
SQL["logreg_coefficients"] = (f"{_fits(_GRID_CTE)}, {newton('data', X)}, long AS ({_LONG}) "
                              f"SELECT c AS \"C\", feature, (round(coef, 4) + 0.0) AS coef FROM long WHERE {_PRESENT}")


def fit_certificate(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of the fits over all features of `prepared`: what the probabilities add up to, and the gradient that is left."""
    data = prepared(spark, folder)
    n, tables = data.train.count(), []
    for c in model.C_GRID:
        fit = model.fit_logistic(data.train, data.features, c=c, rows=n, tol=TOL)
        proof = compiled.certificate(data.train, fit, data.features, schemas.LABEL, c)
        sums = data.train.agg(F.sum(F.lit(1.0)).alias("intercept"), *[F.sum(f).alias(f) for f in data.features]).unpivot(
            [], ["intercept", *data.features], "feature", "sum_x")
        hits = data.train.filter(F.col(schemas.LABEL) == 1).agg(F.sum(F.lit(1.0)).alias("intercept"), *[F.sum(f).alias(f) for f in data.features]).unpivot(
            [], ["intercept", *data.features], "feature", "sum_xy")
        tables.append(proof.join(sums, "feature").join(hits, "feature").select(
            F.lit(float(c)).alias("C"), "feature", "sum_x", "sum_xy", F.round("gradient", 3).alias("gradient")))
    return rounded(ordered.union_all(*tables), 3, "gradient")


QUERIES["fit_certificate"] = fit_certificate
_SUMS = " UNION ALL ".join([f"SELECT '{f}' AS feature, CAST(sum({e}) AS DOUBLE) AS sum_x, CAST(coalesce(sum({e}) FILTER (WHERE y = 1), 0) AS DOUBLE) AS sum_xy FROM x WHERE split = 'train'"
                            for f, e in [("intercept", "1"), *[(f, f'"{f}"') for f in X]]])
SQL["fit_certificate"] = (f"WITH {ROWS}, s AS ({_SUMS}) SELECT CAST(c AS DOUBLE) AS \"C\", feature, sum_x, sum_xy, CAST(0 AS DOUBLE) AS gradient "
                          f"FROM s, (VALUES {_GRID}) v(c) WHERE feature = 'intercept' OR {_PRESENT}")


def logreg_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Validation areas per strength, with the place of each on the leaderboard."""
    data = prepared(spark, folder)
    table = model.sweep_logistic(data.train, data.validation, data.features, tol=TOL)
    placed = ordered.running_number(rounded(table, 4, "roc_auc", "pr_auc"), [F.desc("pr_auc"), "C"], "place")
    return report(placed)


QUERIES["logreg_sweep"] = logreg_sweep
_VALIDATED = f"scored AS (SELECT fit, c, y, round({_margin(X)}, 9) AS p FROM best, x WHERE split = 'val'), {_curve('scored', 'fit, c')}"
SQL["logreg_sweep"] = (f"{_fits(_GRID_CTE)}, {newton('data', X)}, {_VALIDATED}, a AS (SELECT c, round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc FROM area) "
                       "SELECT c AS \"C\", roc_auc, pr_auc, row_number() OVER (ORDER BY pr_auc DESC, c) AS place FROM a")

SETS = {"numbers": NUMBERS, "category": [f for f in X if f not in NUMBERS], "full": X}


def logreg_feature_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Validation areas of three feature sets: numbers, category, both."""
    data = prepared(spark, folder)
    n = data.train.count()
    sets = {name: [f for f in names if f in data.features] for name, names in SETS.items()}
    fits = {name: model.fit_logistic(data.train, names, c=1.0, rows=n, tol=TOL) for name, names in sets.items()}
    return rounded(model.compare(fits, data.validation), 4, "roc_auc", "pr_auc")


QUERIES["logreg_feature_sets"] = logreg_feature_sets


def _masked(alias: str) -> str:
    return ", ".join("CASE " + " ".join(f"WHEN fit = '{name}' THEN {int(f in names)}" for name, names in SETS.items()) + f" END * {alias}.\"{f}\" AS \"{f}\"" for f in X)


SQL["logreg_feature_sets"] = (
    f"WITH {ROWS}, sets AS (SELECT unnest({list(SETS)}) AS fit, CAST(1 AS DOUBLE) AS c), data AS (SELECT fit, c, y, {_masked('x')} FROM x, sets WHERE split = 'train'), "
    f"{newton('data', X)}, scored AS (SELECT fit, c, y, round({_margin(X)}, 9) AS p FROM best, x WHERE split = 'val'), {_curve('scored', 'fit')} "
    "SELECT fit AS model, (round(roc_auc, 4) + 0.0) AS roc_auc, (round(pr_auc, 4) + 0.0) AS pr_auc FROM area")

FINAL_C = 1.0


def logreg_final(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold tuned on validation, refit on train and validation, metrics on test."""
    trained = training.train_final(prepared(spark, folder), c=FINAL_C, tol=TOL)
    return rounded(trained.metrics, 4, "roc_auc", "pr_auc", "threshold", "precision", "recall", "f1")


# The category of a validation row is encoded as it is applied, in the refit too: a rare level there is all zeros.
_TWO = (f"data AS (SELECT 'first' AS fit, CAST({FINAL_C} AS DOUBLE) AS c, x.* FROM x WHERE split = 'train' UNION ALL "
        f"SELECT 'final', CAST({FINAL_C} AS DOUBLE), x.* FROM x WHERE split <> 'test')")
_TUNED = (f"{_fits(_TWO)}, {newton('data', X)}, scored AS (SELECT fit, y, round({_margin(X)}, 9) AS p FROM best, x "
          f"WHERE (fit = 'first' AND split = 'val') OR (fit = 'final' AND split = 'test')), {_curve('scored', 'fit')}, "
          "th AS (SELECT p AS cut FROM cv WHERE fit = 'first' ORDER BY CAST(2 * tp AS DOUBLE) / (tp + fp + P1) DESC, p LIMIT 1)")
QUERIES["logreg_final"] = logreg_final
SQL["logreg_final"] = f"""{_TUNED}, t AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= cut) AS tp, count(*) FILTER (WHERE y = 0 AND p >= cut) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < cut) AS fn, count(*) FILTER (WHERE y = 0 AND p < cut) AS tn, any_value(cut) AS cut FROM scored, th WHERE fit = 'final')
SELECT round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc, round(1.0 / (1.0 + exp(-cut)), 4) AS threshold, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS precision,
  round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1, tp, fp, fn, tn FROM t, area WHERE fit = 'final'"""


def coef_standard(spark: SparkSession, folder: str) -> DataFrame:
    """The three largest coefficients of standardised features."""
    data = prepared(spark, folder)
    fit = model.fit_logistic(data.train, data.features, c=model.BEST_C, scale=True, tol=TOL)
    # Levels that complement each other have opposite coefficients: the names decide between equal sizes.
    return model.leaderboard(rounded(model.coefficients(spark, fit, data.features), 4, "coef", "abs_coef"), 3)


QUERIES["coef_standard"] = coef_standard
_STANDARD = ", ".join(f"CASE WHEN stddev_pop(\"{f}\") OVER () > 0 THEN (\"{f}\" - avg(\"{f}\") OVER ()) / stddev_pop(\"{f}\") OVER () ELSE 0 END AS \"{f}\"" for f in X)
SQL["coef_standard"] = (f"{_fits(f'data AS (SELECT 1 AS fit, CAST({model.BEST_C} AS DOUBLE) AS c, y, {_STANDARD} FROM x WHERE split = {chr(39)}train{chr(39)})')}, {newton('data', X)}, "
                        f"long AS ({_LONG}) SELECT feature, (round(coef, 4) + 0.0) AS coef, round(abs(coef), 4) AS abs_coef FROM long WHERE {_PRESENT} ORDER BY round(abs(coef), 4) DESC, feature LIMIT 3")


def level_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Returned or not by part: a fit whose only feature is one of thousands of levels, as sparse vectors, and its coefficients."""
    items = session.cut(tables(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_returnflag") == "R").cast("int").alias("label")))
    levels = encode.fit_levels(items, "part", 4)
    vectors = session.cut(encode.level_vectors(items, "part", levels, True))
    fit = model.fit_logistic(vectors, ["levels"], "label", c=FINAL_C, tol=TOL)
    marked = session.cut(encode.with_level(items, "part", levels, True).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("returned")))
    found = joins.lookup(marked, session.cut(model.level_coefficients(spark, fit, levels)), ["level"], spread_by=["level"])
    p = 1.0 / (1.0 + F.exp(-F.lit(float(fit.stages[-1].intercept)) - F.col("coef")))
    proof = F.col("n") * p - F.col("returned") + F.col("coef") / FINAL_C
    return rounded(found.withColumn("gradient", proof), 2, "coef", "gradient")


QUERIES["level_fit"] = level_fit


def _level_newton(steps: int = 12) -> str:
    """Newton's method for one category: each level only meets the intercept, so a step is one pass over the levels."""
    out = ["v0 AS MATERIALIZED (SELECT level, n, returned, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w FROM cells)"]
    for s in range(steps):
        out += [f"u{s} AS MATERIALIZED (SELECT *, n * p * (1 - p) AS s, n * p - returned AS g0, n * p - returned + w / {FINAL_C} AS g, n * p * (1 - p) + 1.0 / {FINAL_C} AS h "
                f"FROM (SELECT *, 1.0 / (1.0 + exp(-(w0 + w))) AS p FROM v{s}))",
                f"t{s} AS MATERIALIZED (SELECT (sum(g0) - sum(s * g / h)) / (sum(s) - sum(s * s / h)) AS d FROM u{s})",
                f"v{s + 1} AS MATERIALIZED (SELECT level, n, returned, w0 - d AS w0, w - (g - s * d) / h AS w FROM u{s}, t{s})"]
    return ", ".join(out) + f", done AS (SELECT * FROM v{steps})"


SQL["level_fit"] = f"""
WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
cells AS MATERIALIZED (SELECT CASE WHEN n >= 4 THEN part ELSE 'other' END AS level, CAST(sum(n) AS BIGINT) AS n, CAST(sum(returned) AS BIGINT) AS returned FROM c GROUP BY 1),
{_level_newton()} SELECT level, n, returned, (round(w, 2) + 0.0) AS coef, CAST(0 AS DOUBLE) AS gradient FROM done"""


# --- stored models and batch scoring -------------------------------------------------------------------------------------


def stored_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows as JSON requests, one a week, scored by the stored expression of the final model and decided.

    The requests of even days of the month carry no category: it counts as unknown.
    """
    data = prepared(spark, folder)
    path = session.scratch_path(spark, "model")
    artifacts.save(training.train_final(data, c=FINAL_C, tol=TOL).artifacts, path)
    stored = artifacts.load(spark, path)
    bare = T.StructType([T.StructField("c_mktsegment", T.StringType()), T.StructField("o_orderpriority", T.StringType()),
                         *[T.StructField(c, T.DoubleType()) for c in NUMBERS]])
    full = T.StructType([*bare.fields, T.StructField("genre_bucket", T.StringType())])
    spans = []
    for candidate, half in ((full, F.dayofmonth(schemas.WEEK_TS) % 2 == 1), (bare, F.dayofmonth(schemas.WEEK_TS) % 2 == 0)):
        rows = data.test.filter(half).select(F.col(schemas.WEEK).alias("request_id"), F.struct(*candidate.names).alias("c"))
        # A week has one row per segment and priority: a payload is small.
        requests = rows.groupBy("request_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list("c")).alias("tracks"))).alias("payload"))
        parsed = score.parse_requests(requests, candidate)
        plain = score.score_plain(parsed, stored.expression, stored.encoder, stored.features, stored.threshold)
        spans.append(plain.select("request_id", "index", "c_mktsegment", "o_orderpriority", "genre_bucket", "probability"))
    scored = session.cut(ordered.union_all(*spans))
    decided = score.decide(scored.withColumn("probability", F.round("probability", 9)), round(stored.threshold, 9))
    return rounded(decided.drop("winner_index"), 4, "probability", "threshold")


_REQUESTS = f"""{_TUNED}, q AS (SELECT c_mktsegment, o_orderpriority, week, day(week) % 2 = 1 AS known, CASE WHEN day(week) % 2 = 1 THEN bucket ELSE 'unknown' END AS genre_bucket,
    {', '.join(NUMBERS)} FROM x WHERE split = 'test'),
ql AS (SELECT q.*, lv.bucket AS level FROM q LEFT JOIN (SELECT bucket FROM lv WHERE own UNION SELECT 'other' WHERE EXISTS (FROM lv WHERE NOT own)) lv ON coalesce(q.genre_bucket, 'unknown') = lv.bucket),
qx AS (SELECT c_mktsegment, o_orderpriority, week, genre_bucket, {_COLUMNS} FROM ql),
s AS (SELECT week, c_mktsegment, o_orderpriority, genre_bucket, round(1.0 / (1.0 + exp(-({_margin(X)}))), 9) AS p, row_number() OVER (PARTITION BY week ORDER BY c_mktsegment, o_orderpriority) - 1 AS idx
  FROM qx, best WHERE fit = 'final'),
d AS (SELECT *, count(*) OVER (PARTITION BY week) AS n_tracks, first_value(idx) OVER (PARTITION BY week ORDER BY p DESC, idx) AS win, round(1.0 / (1.0 + exp(-cut)), 9) AS t FROM s, th)"""
QUERIES["stored_scoring"] = stored_scoring
SQL["stored_scoring"] = f"""{_REQUESTS} SELECT CAST(week AS VARCHAR) AS request_id, idx AS index, c_mktsegment, o_orderpriority, genre_bucket, round(p, 4) AS probability, n_tracks,
  round(t, 4) AS threshold, CASE WHEN n_tracks = 1 THEN 'single_threshold' ELSE 'ranking' END AS mode, CAST(p >= t AS BIGINT) AS above_threshold,
  CAST(CASE WHEN n_tracks = 1 THEN p >= t ELSE idx = win END AS BIGINT) AS prediction FROM d"""

# --- boosted stumps ------------------------------------------------------------------------------------------------------

STEP = 0.1


def _stumps(fit: str, rows: str, weight: str, rounds: int) -> str:
    """SQL of `f_<fit>` (round, feature, cut, low, high, share): depth-1 trees on -1 / 1 labels, positives weighted.

    Every round takes the split that lowers the weighted variance most; the first tree fits the labels, later ones the
    gradient of the logistic loss, and count STEP.
    """
    xs = ", ".join(f'CAST("{f}" AS DOUBLE)' for f in X)
    out = [f"{fit}_r AS MATERIALIZED (SELECT xs, t0, n * CASE WHEN t0 = 1 THEN {weight} ELSE 1.0 END AS wt FROM (SELECT [{xs}] AS xs, 2 * y - 1 AS t0, count(*) AS n FROM {rows} GROUP BY ALL))",
           f"{fit}_v AS (SELECT DISTINCT j, xs[j] AS v FROM {fit}_r, (SELECT unnest(range(1, {len(X) + 1})) AS j))",
           f"{fit}_c AS MATERIALIZED (SELECT * FROM (SELECT j, (v + lead(v) OVER (PARTITION BY j ORDER BY v)) / 2 AS cut FROM {fit}_v) WHERE cut IS NOT NULL)",
           f"{fit}_0 AS (SELECT xs, t0, wt, CAST(0 AS DOUBLE) AS f FROM {fit}_r)"]
    for m in range(1, rounds + 1):
        target = "CAST(t0 AS DOUBLE)" if m == 1 else "4.0 * t0 / (1.0 + exp(2.0 * t0 * f))"
        share = 1.0 if m == 1 else STEP
        out += [f"{fit}_t{m} AS MATERIALIZED (SELECT *, {target} AS t FROM {fit}_{m - 1})",
                f"{fit}_g{m} AS (SELECT j, cut, sum(wt) FILTER (WHERE xs[j] <= cut) AS wl, sum(wt) FILTER (WHERE xs[j] > cut) AS wr, sum(wt * t) FILTER (WHERE xs[j] <= cut) AS sl, "
                f"sum(wt * t) FILTER (WHERE xs[j] > cut) AS sr FROM {fit}_t{m}, {fit}_c GROUP BY j, cut)",
                f"{fit}_s{m} AS MATERIALIZED (SELECT {m} AS round, j, cut, sl / wl AS low, sr / wr AS high, {share} AS share FROM {fit}_g{m} "
                f"ORDER BY round(sl * sl / wl + sr * sr / wr, 6) DESC, j, cut LIMIT 1)",
                f"{fit}_{m} AS MATERIALIZED (SELECT xs, t0, wt, f + share * CASE WHEN xs[j] <= cut THEN low ELSE high END AS f FROM {fit}_t{m}, {fit}_s{m})"]
    out.append(f"f_{fit} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {fit}_s{m}" for m in range(1, rounds + 1)) + ")")
    return ", ".join(out)


_WEIGHT = "(SELECT count(*) FILTER (WHERE y = 0) / CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) FROM x WHERE split = 'train')"


def _boosted(fit: str, rows: str, rounds: str) -> str:
    """SQL that scores `rows` with the first trees of a fit: (n, y, the row's key, p)."""
    xs = ", ".join(f'CAST("{f}" AS DOUBLE)' for f in X)
    return (f"SELECT n, c_mktsegment, o_orderpriority, week, y, round(sum(share * CASE WHEN xs[j] <= cut THEN low ELSE high END), 9) AS p "
            f"FROM (SELECT *, [{xs}] AS xs FROM {rows}) a, f_{fit}, (SELECT unnest({rounds}) AS n) WHERE round <= n GROUP BY ALL")


def stump_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The trees of a weighted boosting fit of depth 1: feature, threshold, the value on each side, and the tree's weight.

    Where no split is better than none (a tree of one leaf, or of two equal ones), all splits tie: the first one stands, with the
    leaf's value on both sides. Without negatives no row has a weight, and the sides no mean.
    """
    data = prepared(spark, folder)
    fit = model.fit_trees(data.train, data.features, maxDepth=1, maxIter=max(ROUNDS), stepSize=STEP, maxBins=64)
    rows, even = [], []
    for i, (w, t) in enumerate(compiled.trees_of(fit.stages[-1]), 1):
        if isinstance(t, compiled.Leaf):
            even.append((i, t.value, w))
        elif isclose(t.left.value, t.right.value, rel_tol=1e-9, abs_tol=1e-12):
            even.append((i, t.left.value, w))  # a gain of rounding errors
        else:
            rows.append((i, data.features[t.feature], t.threshold, t.left.value, t.right.value, w))
    first = model.first_cut(data.train, data.features) if even else None
    if first is not None:
        weightless = model.class_weight(data.train) == 0
        for i, value, w in even:
            value = float("nan") if weightless else value
            rows.append((i, *first, value, value, w))
    trees = spark.createDataFrame(rows, "round long, feature string, cut double, low double, high double, share double")
    return rounded(trees, 5, "low", "high")


QUERIES["stump_rounds"] = stump_rounds
_NAME = "CASE j " + " ".join(f"WHEN {j} THEN '{f}'" for j, f in enumerate(X, 1)) + " END"
_TRAIN_STUMPS = _stumps("train", "(SELECT * FROM x WHERE split = 'train')", _WEIGHT, max(ROUNDS))
SQL["stump_rounds"] = (f"WITH {ROWS}, {_TRAIN_STUMPS} SELECT CAST(round AS BIGINT) AS round, {_NAME} AS feature, cut, (round(low, 5) + 0.0) AS low, (round(high, 5) + 0.0) AS high, "
                       "CAST(share AS DOUBLE) AS share FROM f_train")


def gbt_capacity(spark: SparkSession, folder: str) -> DataFrame:
    """Validation areas per depth and number of trees: one fit a depth, its prefixes scored in one pass."""
    data = prepared(spark, folder)
    table = model.sweep_capacity(data.train, data.validation, data.features, grid={"maxDepth": [1], "maxIter": ROUNDS}, stepSize=STEP, maxBins=64)
    return rounded(table, 4, "roc_auc", "pr_auc")


QUERIES["gbt_capacity"] = gbt_capacity
SQL["gbt_capacity"] = (f"WITH {ROWS}, {_TRAIN_STUMPS}, vals AS (SELECT * FROM x WHERE split = 'val'), scored AS ({_boosted('train', 'vals', str(ROUNDS))}), {_curve('scored', 'n')} "
                       "SELECT 'gbt_maxDepth1_maxIter' || n AS model, CAST(n AS BIGINT) AS \"maxIter\", CAST(1 AS BIGINT) AS \"maxDepth\", round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc FROM area")


def models_beside(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression and boosted stumps on the test weeks: areas, hit rates and metrics at each one's own threshold."""
    data = prepared(spark, folder)
    trained = training.train_final(data, c=FINAL_C, tol=TOL)
    settings = {"maxDepth": 1, "maxIter": max(ROUNDS), "stepSize": STEP, "maxBins": 64, "weight": model.class_weight(data.train)}
    first = model.fit_trees(data.train, data.features, **settings)
    own = evaluate.best_threshold(model.with_probability(data.validation, first).withColumn("probability", F.round("probability", 9))).first()["threshold"]
    trees = model.with_probability(data.test, model.fit_trees(data.train.unionByName(data.validation), data.features, **settings))
    rows = [model.model_summary(name, scored.withColumn("probability", F.round("probability", 9)), round(threshold, 9), tie_break=SEGMENT)
            for name, scored, threshold in (("logreg", trained.scored_test, trained.artifacts.threshold), ("gbt", trees, own))]
    return rounded(ordered.union_all(*rows), 4, "roc_auc", "pr_auc", "threshold", "precision", "recall", "f1", "hit_at_1", "hit_at_3")


_BOTH_STUMPS = _stumps("both", "(SELECT * FROM x WHERE split <> 'test')", _WEIGHT, max(ROUNDS))
QUERIES["models_beside"] = models_beside
SQL["models_beside"] = f"""{_fits(_TWO)}, {newton('data', X)}, {_TRAIN_STUMPS}, {_BOTH_STUMPS}, vals AS (SELECT * FROM x WHERE split = 'val'), tests AS (SELECT * FROM x WHERE split = 'test'),
z AS (SELECT 'logreg' AS model, split, c_mktsegment, o_orderpriority, week, y, round(1.0 / (1.0 + exp(-({_margin(X)}))), 9) AS p FROM best, x
    WHERE (fit = 'first' AND split = 'val') OR (fit = 'final' AND split = 'test')
  UNION ALL SELECT 'gbt', 'val', c_mktsegment, o_orderpriority, week, y, round(1.0 / (1.0 + exp(-2 * p)), 9) FROM ({_boosted('train', 'vals', f'[{max(ROUNDS)}]')})
  UNION ALL SELECT 'gbt', 'test', c_mktsegment, o_orderpriority, week, y, round(1.0 / (1.0 + exp(-2 * p)), 9) FROM ({_boosted('both', 'tests', f'[{max(ROUNDS)}]')})),
scored AS (SELECT model || '/' || split AS part, y, p FROM z), {_curve('scored', 'part')},
th AS (SELECT split_part(part, '/', 1) AS model, p AS cut FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY CAST(2 * tp AS DOUBLE) / (tp + fp + P1) DESC, p) AS rn FROM cv WHERE part LIKE '%/val') WHERE rn = 1),
t AS (SELECT model, any_value(cut) AS cut, count(*) FILTER (WHERE y = 1 AND p >= cut) AS tp, count(*) FILTER (WHERE y = 0 AND p >= cut) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < cut) AS fn, count(*) FILTER (WHERE y = 0 AND p < cut) AS tn FROM z JOIN th USING (model) WHERE split = 'test' GROUP BY model),
h AS (SELECT model, week, max(y) AS has, max(CASE WHEN rn = 1 THEN y ELSE 0 END) AS one, max(CASE WHEN rn <= 3 THEN y ELSE 0 END) AS three
  FROM (SELECT *, row_number() OVER (PARTITION BY model, week ORDER BY p DESC, c_mktsegment, o_orderpriority) AS rn FROM z WHERE split = 'test') GROUP BY model, week),
hit AS (SELECT model, count(*) AS n_weeks, avg(one) AS hit_at_1, avg(three) AS hit_at_3 FROM h WHERE has = 1 GROUP BY model)
SELECT t.model, round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc, round(cut, 4) AS threshold, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1, tp, fp, fn, tn, n_weeks, round(hit_at_1, 4) AS hit_at_1, round(hit_at_3, 4) AS hit_at_3
FROM t JOIN hit USING (model) JOIN area ON part = t.model || '/test'"""
