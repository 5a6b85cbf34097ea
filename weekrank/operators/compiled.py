"""Fitted classifiers as plain expressions: a linear sum, or nested CASE for trees, and staged scoring of ensembles.

A compiled model needs no ML stage to score: it is SQL text over its feature columns, which any engine evaluates, that is
stored beside the pipeline and that Catalyst prunes and pushes like any other expression. The margin is the log-odds of a
linear model, and half of them for boosted trees; `link` says by how much it is multiplied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isfinite, isnan

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"\s*(?:Tree \d+ \(weight (?P<weight>[^)]+)\):|(?P<kind>If|Else) \(feature (?P<feature>\d+) (?:<=|>) (?P<threshold>[^)]+)\)|Predict: (?P<value>\S+))")


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Values up to `threshold` go left."""

    feature: int
    threshold: float
    left: Leaf | Split
    right: Leaf | Split


@dataclass(frozen=True)
class Compiled:
    """SQL text of the margin over the feature columns, and what the margin is multiplied by."""

    margin: str
    link: float

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-F.lit(self.link) * F.expr(self.margin)))

    def sql(self, quote: str = '"') -> str:
        """The probability as SQL text, with the quotes that another engine puts around names."""
        return f"1e0 / (1e0 + exp(-{number(self.link)} * ({self.margin.replace('`', quote)})))"


def number(value: float) -> str:
    """A double literal: an exponent, so that no engine reads a decimal; 17 digits, so that none is lost.

    Labels that are all the same give an infinite intercept, which has no digits: it is cast from its name.
    """
    if not isfinite(value):
        return f"CAST('{'NaN' if isnan(value) else 'Infinity' if value > 0 else '-Infinity'}' AS DOUBLE)"
    return f"{value:.17e}"


def _name(feature: str) -> str:
    if "`" in feature or '"' in feature:
        raise ValueError(f"a quote in the feature name {feature!r}")
    return f"`{feature}`"


def trees_of(model: GBTClassificationModel) -> list[tuple[float, Leaf | Split]]:
    """Weight and root of every tree, read from the model's printed form."""
    found = [m for m in map(_LINE.match, model.toDebugString.split("\n")) if m]
    at = 0

    def node():
        nonlocal at
        m = found[at]
        at += 1
        if m["value"] is not None:
            return Leaf(float(m["value"]))
        left = node()
        at += 1  # the line that opens the other branch
        return Split(int(m["feature"]), float(m["threshold"]), left, node())

    out = []
    while at < len(found):
        weight = float(found[at]["weight"])
        at += 1
        out.append((weight, node()))
    return out


def _case(node: Leaf | Split, names: Sequence[str]) -> str:
    if isinstance(node, Leaf):
        return number(node.value)
    return (f"CASE WHEN {_name(names[node.feature])} <= {number(node.threshold)} THEN {_case(node.left, names)} "
            f"ELSE {_case(node.right, names)} END")


def compiled(model: PipelineModel, features: Sequence[str]) -> Compiled:
    """The last stage over the unscaled features; scaling stages in between are folded into the coefficients."""
    last = model.stages[-1]
    if isinstance(last, GBTClassificationModel):
        return Compiled(" + ".join(f"{number(w)} * ({_case(root, features)})" for w, root in trees_of(last)) or number(0.0), 2.0)
    if not isinstance(last, LogisticRegressionModel):
        raise TypeError(f"no expression for {type(last).__name__}")
    coefficients, intercept = last.coefficients.toArray(), float(last.intercept)
    for stage in reversed(model.stages[:-1]):
        if hasattr(stage, "std") and hasattr(stage, "mean"):
            std, mean = stage.std.toArray(), stage.mean.toArray()
            coefficients = np.divide(coefficients, std, out=np.zeros(len(std)), where=std > 0)
            intercept -= float(coefficients @ mean)
        elif hasattr(stage, "getScalingVec"):
            coefficients = coefficients * stage.getScalingVec().toArray()
    return Compiled(" + ".join([number(intercept), *[f"{number(c)} * {_name(f)}" for f, c in zip(features, coefficients)]]), 1.0)


def certificate(df: DataFrame, model: PipelineModel, features: Sequence[str], label: str, c: float) -> DataFrame:
    """Proof of a logistic fit on the rows it was fitted on: feature, coefficient, gradient of the penalised loss.

    The objective is `c` times the summed loss plus half the squared coefficients, divided by `c`; it is convex, so a gradient of zero
    in every component is the one optimum. All components come from one aggregate. The intercept carries no penalty;
    its gradient is the sum of the probabilities less the positives.
    """
    last = model.stages[-1]
    scored = model.transform(df).select(vector_to_array(last.getFeaturesCol()).alias("x"),
                                        (vector_to_array(last.getProbabilityCol())[1] - F.col(label)).alias("off"))
    names = ["intercept", *features]
    sums = scored.agg(F.sum("off").alias("g0"), *[F.sum(F.col("off") * F.col("x")[j]).alias(f"g{j + 1}") for j in range(len(features))])
    values = [float(last.intercept), *map(float, last.coefficients)]
    rows = [F.struct(F.lit(i).alias("at"), F.lit(name).alias("feature"), F.lit(value).alias("coef"),
                     (F.col(f"g{i}") + (F.lit(value / c) if i else F.lit(0.0))).alias("gradient")) for i, (name, value) in enumerate(zip(names, values))]
    return sums.select(F.inline(F.array(*rows)))


# --- staged scoring -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Flat:
    """Trees as node arrays: a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def margins(self, x: np.ndarray, low: int, high: int) -> np.ndarray:
        """Weighted sum of the trees from `low` to `high` for every row of `x`, tree after tree."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for tree in range(low, high):
            node = np.full(len(x), self.roots[tree])
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.weights[tree] * self.value[node]
        return total


def flat(trees: list[tuple[float, Leaf | Split]]) -> Flat:
    feature, threshold, left, right, value, roots, deepest = [], [], [], [], [], [], 0

    def add(node, depth) -> int:
        nonlocal deepest
        deepest, at = max(deepest, depth), len(feature)
        for column, default in ((feature, 0), (threshold, np.inf), (left, at), (right, at), (value, 0.0)):
            column.append(default)
        if isinstance(node, Leaf):
            value[at] = node.value
        else:
            feature[at], threshold[at] = node.feature, node.threshold
            left[at], right[at] = add(node.left, depth + 1), add(node.right, depth + 1)
        return at

    for _, root in trees:
        roots.append(add(root, 0))
    return Flat(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value),
                np.array(roots, np.int64), np.array([w for w, _ in trees]), deepest)


def staged(df: DataFrame, model: PipelineModel, features: Sequence[str], rounds: Sequence[int]) -> DataFrame:
    """Adds `probabilities`: the score of the first r trees for every r of `rounds`, in one pass and with every tree once.

    Each stage adds its own trees to the margin of the one before. The model goes to the tasks (its size does not depend on the rows).
    """
    trees = trees_of(model.stages[-1])
    if max(rounds) > len(trees):
        raise ValueError(f"{max(rounds)} rounds of a model of {len(trees)}")
    order = sorted(set(rounds))
    arrays, back = flat(trees), [order.index(r) for r in rounds]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            x, margin, done, out = np.column_stack([batch[c].to_numpy(np.float64) for c in batch.columns]), np.zeros(len(batch)), 0, []
            for r in order:
                margin, done = margin + arrays.margins(x, done, r), r
                out.append(1.0 / (1.0 + np.exp(-2.0 * margin)))
            yield pd.Series(list(np.stack(out, axis=1)[:, back]))

    scored = F.pandas_udf(score, "array<double>")
    return df.withColumn("probabilities", scored(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])))
