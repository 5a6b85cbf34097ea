"""Logistic regression on one sparse 0/1 vector of very many levels: Newton's method on tables, no vector of coefficients in the driver."""

from __future__ import annotations

from math import inf, log

from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekrank import session
from weekrank.operators import joins

#: Vectors up to this size are fitted by Spark ML, whose driver keeps some twenty vectors of that size.
WIDE = 1 << 14
#: Halvings of a Newton step that does not lower the loss.
HALVINGS = 30


def _position(vector: str) -> Column:
    """The place of the only entry of a sparse vector, null where it has none."""
    return F.get(F.unwrap_udt(vector)["indices"], F.lit(0)).cast("long")


def cells(df: DataFrame, vector: str, label: str) -> tuple[DataFrame, int] | None:
    """Rows `n` and positives `hits` per place of the vector (`at`, null without an entry), stored once, and the vector's size.

    None unless the vectors are sparse, wider than WIDE and of one size, hold one entry of 1 or none, and the labels are 0 or 1.
    """
    if not isinstance(df.schema[vector].dataType, VectorUDT):
        return None
    one = df.select(F.unwrap_udt(vector)["size"].alias("size")).first()
    if one is None or one["size"] is None or one["size"] <= WIDE:
        return None
    v, y = F.unwrap_udt(vector), F.col(label).cast("double")
    entries = F.size(v["indices"])
    plain = (v["type"] == 0) & (v["size"] == one["size"]) & ((entries == 0) | ((entries == 1) & (F.get(v["values"], F.lit(0)) == 1.0))) & y.isin(0.0, 1.0)
    found = session.cut(df.groupBy(_position(vector).alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1.0).alias("hits"), F.bool_and(F.coalesce(plain, F.lit(False))).alias("plain")))
    return (found.drop("plain"), one["size"]) if found.filter(~F.col("plain")).isEmpty() else None


class LevelLogisticModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """Intercept and a table of coefficients (`at`, `coef`) of any size; places that are not in it have 0."""

    @keyword_only
    def __init__(self, *, intercept: float, table: DataFrame, size: int, columns: dict[str, str]):
        super().__init__()
        self.intercept, self.table, self.numFeatures = intercept, table, size
        self._set(**columns)

    @property
    def coefficients(self) -> DenseVector:
        """All coefficients in the driver, as Spark's models hold them; `table` is the way for many."""
        values = [0.0] * self.numFeatures
        for row in self.table.toLocalIterator():
            values[row["at"]] = row["coef"]
        return DenseVector(values)

    def _transform(self, df: DataFrame) -> DataFrame:
        features = self.getFeaturesCol()
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)]
        placed = df.withColumn("_at", _position(features))
        known = self.table.select(F.col("at").alias("_at"), F.col("coef").alias("_coef"))
        margin = F.lit(self.intercept) + F.coalesce(F.col("_coef"), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-margin))
        scored = joins.lookup(placed, known, ["_at"], spread_by=plain or ["_at"])
        return scored.withColumns({self.getRawPredictionCol(): array_to_vector(F.array(-margin, margin)),
                                   self.getProbabilityCol(): array_to_vector(F.array(1.0 - p, p)),
                                   self.getPredictionCol(): (p > 0.5).cast("double")}).drop("_at", "_coef")


def fit(counted: DataFrame, c: float, max_iter: int, tol: float) -> tuple[float, DataFrame]:
    """Intercept and coefficients (`at`, `coef`) of the penalised fit on the table of `cells`.

    Every level only meets the intercept, so a Newton step is one pass: the sums give the intercept's step, and each level's own
    follows from it. Levels with the same counts have the same coefficient, so the passes run over the different counts.
    """
    shapes = counted.groupBy("n", "hits", F.col("at").isNotNull().alias("own")).agg(F.count(F.lit(1)).alias("levels"))
    state = session.cut(shapes.withColumn("w", F.lit(0.0)))
    rows, hits = state.agg(F.sum(F.col("n") * F.col("levels")), F.sum(F.col("hits") * F.col("levels"))).first()
    if hits in (0, rows):
        # The loss falls towards 0 as the intercept grows: no level needs a coefficient.
        return inf if hits else -inf, counted.filter(F.col("at").isNotNull()).select("at", F.lit(0.0).alias("coef"))
    n, y, w, k, own = (F.col(x) for x in ("n", "hits", "w", "levels", "own"))

    def parts(w0: float) -> tuple[Column, Column, Column, Column]:
        z = F.lit(w0) + w
        p = 1.0 / (1.0 + F.exp(-z))
        s = n * p * (1.0 - p)
        return z, s, n * p - y + w / c, F.when(own, 1.0 / (s + 1.0 / c)).otherwise(0.0)

    def sums(table: DataFrame, w0: float):
        z, s, g, u = parts(w0)
        loss = n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - y * z + w * w / (2.0 * c)
        return table.agg(F.sum(k * loss).alias("loss"), F.sum(k * (g - w / c - s * g * u)).alias("g"),
                         F.sum(k * F.when(own, s * u / c).otherwise(s)).alias("s"), F.max(F.abs(g * u)).alias("most")).first()

    w0 = log(hits / (rows - hits))
    at = sums(state, w0)
    for _ in range(max_iter):
        d = at["g"] / at["s"]
        _, s, g, u = parts(w0)
        step, last = 1.0, at["most"] + abs(d) <= tol ** 0.5  # the error after this step is about the square of it
        for _ in range(HALVINGS):
            moved = session.cut(state.withColumn("w", w - F.lit(step) * (g - s * d) * u))
            then = sums(moved, w0 - step * d)
            if last or then["loss"] <= at["loss"] + 1e-12 * abs(at["loss"]):
                break
            step /= 2.0
        state, w0, at = moved, w0 - step * d, then
        if last:
            break
    known = state.filter("own").select("n", "hits", F.col("w").alias("coef"))
    placed = joins.lookup(counted.filter(F.col("at").isNotNull()), known, ["n", "hits"], spread_by=["at"])
    return w0, session.cut(placed.select("at", "coef"))
