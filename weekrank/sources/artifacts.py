"""Storing and loading a fitted model with its encoder, feature list, threshold and plain expression."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from weekrank.operators.compiled import Compiled, compiled
from weekrank.operators.encode import OneHot

REQUIRED = ("model_type", "encoder", "feature_columns", "threshold")


@dataclass(frozen=True)
class Artifacts:
    model: PipelineModel
    encoder: OneHot
    features: list[str]
    threshold: float
    model_type: str = "logreg"
    expression: Compiled | None = None


def save(artifacts: Artifacts, path: str) -> None:
    """Model in `path/model`, the rest as one row of `path/settings`, with the model's expression over the features."""
    artifacts.model.write().overwrite().save(f"{path}/model")
    encoder, plain = artifacts.encoder, artifacts.expression or compiled(artifacts.model, artifacts.features)
    settings = {
        "model_type": artifacts.model_type, "feature_columns": artifacts.features, "threshold": artifacts.threshold,
        "expression": {"margin": plain.margin, "link": plain.link},
        "encoder": {"column": encoder.column, "prefix": encoder.prefix, "levels": list(encoder.levels),
                    "kept": list(encoder.kept)},
    }
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/settings")


def load(spark: SparkSession, path: str) -> Artifacts:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    absent = [key for key in REQUIRED if key not in settings]
    if absent:
        raise KeyError(f"stored model lacks {absent}")
    e = settings["encoder"]
    encoder = OneHot(e["column"], tuple(e["levels"]), tuple(e["kept"]), e["prefix"])
    plain = Compiled(**settings["expression"]) if "expression" in settings else None
    return Artifacts(PipelineModel.load(f"{path}/model"), encoder, settings["feature_columns"],
                     float(settings["threshold"]), settings["model_type"], plain)
