"""Split, encode, tune on validation, refit, test once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from weekrank import schemas, session
from weekrank.operators import columns, encode, evaluate, model
from weekrank.sources.artifacts import Artifacts


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    encoder: encode.OneHot
    features: list[str]


@dataclass(frozen=True)
class Trained:
    artifacts: Artifacts
    metrics: DataFrame
    scored_test: DataFrame


def prepare(view: DataFrame, *, label: str = schemas.LABEL, week: str = schemas.WEEK_TS, category: str = "genre_bucket",
            min_freq: int = 20, prefix: str = "genre", boundary: str = "exclusive") -> Prepared:
    """Split by weeks, fit the encoder on the training weeks, same feature list everywhere.

    The view is stored once: the cut weeks, the levels and the iterative fits all read it, and the
    spans are week filters that reach its scan.
    """
    view = session.cut(view)
    split = encode.time_split(view, week, boundary=boundary)
    train, validation, test = split.train(view), split.validation(view), split.test(view)
    encoder = encode.fit_one_hot(train, category, min_freq, prefix)
    spans = [encoder.fit_transform(train), encoder.transform(validation), encoder.transform(test)]
    wanted = columns.feature_columns(spans[0])
    return Prepared(*[model.model_input(s, wanted, label) for s in spans], encoder, wanted)


def train_final(data: Prepared, *, label: str = schemas.LABEL, c: float = model.BEST_C, max_iter: int = 1000, tol: float = 1e-6) -> Trained:
    """Fit on train, tune the threshold on validation, refit on both, evaluate on test."""
    first = model.fit_logistic(data.train, data.features, label, c=c, max_iter=max_iter, tol=tol)
    tuned = evaluate.best_threshold(model.with_probability(data.validation, first), label=label)
    threshold = float(tuned.first()["threshold"])
    both = data.train.unionByName(data.validation)
    final = model.fit_logistic(both, data.features, label, c=c, max_iter=max_iter, tol=tol)
    scored = model.with_probability(data.test, final)
    return Trained(Artifacts(final, data.encoder, data.features, threshold),
                   evaluate.holdout_metrics(scored, threshold, label=label), scored)
