"""Ranking and threshold metrics, exact for any number of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekrank import schemas
from weekrank.operators import ordered


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def score_curve(df: DataFrame, score: str = "probability", label: str = schemas.LABEL) -> DataFrame:
    """True and false positives at every distinct threshold (score >= threshold).

    Columns: threshold, pos and neg at the score, tp and fp from the top down to it, P and N overall.
    """
    y = F.col(label)
    by_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    totals = ordered.running_totals(by_score, "threshold", ["pos", "neg"], descending=True)
    return totals.withColumnsRenamed({"pos_through": "tp", "neg_through": "fp", "pos_total": "P", "neg_total": "N"})


def area_metrics(df: DataFrame, score: str = "probability", label: str = schemas.LABEL,
                 curve: DataFrame | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) in one row."""
    curve = score_curve(df, score, label) if curve is None else curve
    sums = curve.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0))).alias("below"),
        F.sum(F.col("pos") * _safe(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision_sum"))
    return sums.select(
        F.try_divide(F.col("below"), F.col("P").cast("double") * F.col("N")).alias("roc_auc"),
        F.try_divide(F.col("precision_sum"), F.col("P")).alias("pr_auc"))


def roc_points(df: DataFrame, score: str = "probability", label: str = schemas.LABEL,
               curve: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; the origin is implied."""
    curve = score_curve(df, score, label) if curve is None else curve
    return curve.select("threshold", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def threshold_table(df: DataFrame, score: str = "probability", label: str = schemas.LABEL,
                    curve: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 at every distinct threshold."""
    curve = score_curve(df, score, label) if curve is None else curve
    return curve.select(
        "threshold", _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _safe(F.col("tp"), F.col("P")).alias("recall"),
        _safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")).alias("f1"))


def best_threshold(df: DataFrame, score: str = "probability", label: str = schemas.LABEL,
                   curve: DataFrame | None = None) -> DataFrame:
    """The threshold with the highest F1, the lowest one on ties (one row)."""
    table = threshold_table(df, score, label, curve)
    return ordered.top(table, 1, F.desc("f1"), F.asc("threshold"))


def threshold_metrics(df: DataFrame, threshold: float, score: str = "probability",
                      label: str = schemas.LABEL) -> DataFrame:
    """Confusion counts, precision, recall and F1 at one threshold (one aggregate)."""
    chosen, y = F.col(score) >= F.lit(float(threshold)), F.col(label)
    counts = df.agg(
        F.count_if((y == 1) & chosen).alias("tp"), F.count_if((y == 0) & chosen).alias("fp"),
        F.count_if((y == 1) & ~chosen).alias("fn"), F.count_if((y == 0) & ~chosen).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        F.lit(float(threshold)).alias("threshold"), _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "fp", "fn", "tn")


def holdout_metrics(df: DataFrame, threshold: float, score: str = "probability",
                    label: str = schemas.LABEL) -> DataFrame:
    """Area and threshold metrics side by side (one row each)."""
    return ordered.beside(area_metrics(df, score, label), threshold_metrics(df, threshold, score, label))


def class_report(df: DataFrame, threshold: float, score: str = "probability", label: str = schemas.LABEL) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    predicted = (F.col(score) >= F.lit(float(threshold))).cast("int")
    y = F.col(label)
    counts = df.agg(*[
        count.alias(f"{name}{k}") for k in (0, 1) for name, count in (
            ("tp", F.count_if((y == k) & (predicted == k))), ("chosen", F.count_if(predicted == k)),
            ("support", F.count_if(y == k)))])
    total = F.col("support0") + F.col("support1")
    scores = {
        k: (_safe(F.col(f"tp{k}"), F.col(f"chosen{k}")), _safe(F.col(f"tp{k}"), F.col(f"support{k}")),
            _safe(2 * F.col(f"tp{k}"), F.col(f"chosen{k}") + F.col(f"support{k}"))) for k in (0, 1)}
    accuracy = _safe(F.col("tp0") + F.col("tp1"), total)
    macro = [(a + b) / 2 for a, b in zip(*scores.values())]
    weighted = [_safe(a * F.col("support0") + b * F.col("support1"), total) for a, b in zip(*scores.values())]

    def line(name: str, values: Sequence[Column], support: Column) -> Column:
        parts = [v.alias(c) for v, c in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("class"), *parts, support.alias("support"))

    lines = F.array(line("0", scores[0], F.col("support0")), line("1", scores[1], F.col("support1")),
                    line("accuracy", [accuracy] * 3, total), line("macro avg", macro, total),
                    line("weighted avg", weighted, total))
    return counts.select(F.explode(lines).alias("l")).select("l.*")


# --- ranking inside a week ----------------------------------------------------------------------

def top_per_week(df: DataFrame, k: int, score: str = "probability", week: str = schemas.WEEK_TS,
                 tie_break: Sequence[str] = schemas.ENTITY) -> DataFrame:
    """The k best rows of each week with their rank.

    The limit is applied inside every task before the shuffle, so a hot week moves k rows per task.
    """
    window = W.partitionBy(week).orderBy(F.desc(score), *tie_break)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def top_table(df: DataFrame, k: int = 5, score: str = "probability", week: str = schemas.WEEK_TS,
              label: str = schemas.LABEL, entity: Sequence[str] = schemas.ENTITY) -> DataFrame:
    """Readable top-k table."""
    marked = top_per_week(df, k, score, week, entity).withColumn(
        "is_true_favorite", F.when(F.col(label) == 1, "Yes").otherwise(""))
    return marked.select(week, "rank", *entity, score, "is_true_favorite")


def hit_rates(df: DataFrame, k: int = 3, score: str = "probability", week: str = schemas.WEEK_TS,
              label: str = schemas.LABEL, tie_break: Sequence[str] = schemas.ENTITY) -> DataFrame:
    """Share of weeks whose favourite is ranked first, and among the first k; weeks without one do not count."""
    with_favourite = df.dropna(subset=[week]).groupBy(week).agg(F.max(label).alias("_has")).filter("_has = 1")
    best = top_per_week(df.select(week, score, label, *tie_break), k, score, week, tie_break)
    hits = best.groupBy(week).agg(
        F.max(F.when(F.col("rank") == 1, F.col(label)).otherwise(0)).alias("_first"), F.max(label).alias("_any"))
    joined = with_favourite.join(hits, week)
    return joined.agg(F.count(F.lit(1)).alias("n_weeks"), F.coalesce(F.avg("_first"), F.lit(0.0)).alias("hit_at_1"),
                      F.coalesce(F.avg("_any"), F.lit(0.0)).alias(f"hit_at_{k}"))
