"""Scoring of candidate lists: defaults, probabilities and the decision per request."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank.operators import columns, joins
from weekrank.operators.compiled import Compiled
from weekrank.operators.encode import OneHot


def parse_requests(df: DataFrame, candidate: T.StructType, request: str = "request_id", payload: str = "payload",
                   field: str = "tracks") -> DataFrame:
    """Rows of JSON requests `{"tracks": [{...}, ...]}`: one row per candidate with its position `index`."""
    body = T.StructType([T.StructField(field, T.ArrayType(candidate))])
    parsed = df.select(request, F.from_json(payload, body)[field].alias("_items"))
    empty = F.coalesce(F.size("_items"), F.lit(0)) < 1
    checked = parsed.withColumn("_items", F.when(empty, F.raise_error(
        F.concat(F.lit(f"'{field}' must be a non-empty list in request "), F.col(request).cast("string")))
    ).otherwise(F.col("_items")))
    return checked.select(request, F.posexplode("_items").alias("index", "_c")).select(request, "index", "_c.*")


def score(df: DataFrame, model: PipelineModel, encoder: OneHot, features: list[str], threshold: float,
          output: str = "probability") -> DataFrame:
    """Probability and `above_threshold` per row; absent columns and gaps get their defaults."""
    ready = columns.with_category(df, encoder.column).transform(encoder.transform)
    ready = columns.with_defaults(ready, features)
    scored = model.transform(ready)
    extra = [c for c in scored.columns if c not in ready.columns]
    probability = vector_to_array(F.col("_probability"))[1]
    return (scored.withColumn("_p", probability).drop(*extra).withColumnRenamed("_p", output)
            .withColumn("above_threshold", (F.col(output) >= F.lit(float(threshold))).cast("int")))


def score_plain(df: DataFrame, model: Compiled, encoder: OneHot, features: list[str], threshold: float,
                output: str = "probability") -> DataFrame:
    """As `score`, by the model's expression: no ML stage, no vectors; `df` keeps its columns."""
    ready = columns.with_category(df, encoder.column).transform(encoder.transform)
    scored = columns.with_defaults(ready, features).withColumn(output, model.probability())
    kept = df.columns if encoder.column in df.columns else [*df.columns, encoder.column]
    return scored.select(*[F.col(f"`{c}`") for c in kept], output).withColumn(
        "above_threshold", (F.col(output) >= F.lit(float(threshold))).cast("int"))


def decide(scored: DataFrame, threshold: float, request: str = "request_id", index: str = "index",
           probability: str = "probability") -> DataFrame:
    """One candidate: compare with the threshold. Several: only the best one wins (smallest index on ties).

    The winner comes from a map-side combined aggregate, not from a window over the request, and is
    joined back with hot requests spread; so one huge request does not land in one task.
    """
    best = F.struct(F.col(probability), (-F.col(index)).alias("order"))
    groups = scored.groupBy(request).agg(F.count(F.lit(1)).alias("n"), (-F.max(best)["order"]).alias("winner_index"))
    summary = groups.withColumn("n_tracks", F.col("n"))
    joined = joins.spread_join(scored, summary, [request], spread_by=[index], counts=groups, weight="n")
    above = (F.col(probability) >= F.lit(float(threshold))).cast("int")
    single = F.col("n_tracks") == 1
    return joined.withColumns({
        "threshold": F.lit(float(threshold)),
        "mode": F.when(single, "single_threshold").otherwise("ranking"),
        "above_threshold": above,
        "prediction": F.when(single, above).otherwise((F.col(index) == F.col("winner_index")).cast("int")),
    })
