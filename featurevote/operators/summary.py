"""Metric tables: one row per model, one row per metric, the winner, the target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurevote.operators.confusion import classification_metrics
from featurevote.operators.ranking import auc_roc
from featurevote.values import (
    BASELINE_ACCURACY,
    TARGET_ACCURACY,
    VERDICT_HIGH,
    VERDICT_MEDIUM,
)

METRIC_COLUMNS = ("accuracy", "precision", "recall", "f1_score", "auc_roc")


def model_metrics(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
    by: Sequence[str] = ("model",),
) -> DataFrame:
    """(by..., n_rows, accuracy, precision, recall, f1_score, auc_roc), one row per model."""
    by = list(by)
    metrics = classification_metrics(predictions, label, prediction, by)
    auc = auc_roc(predictions, score, label, by=by)
    if by:
        return metrics.join(auc, on=by, how="left")
    return metrics.withColumn("auc_roc", auc.scalar())


def long_metrics(
    wide: DataFrame, names: Sequence[str], keep: Sequence[str] = (), facts: Mapping[str, float] | None = None
) -> DataFrame:
    """(keep..., metric, value); ``facts`` adds constant rows such as run settings."""
    facts = facts or {}
    table = wide.select(
        *keep,
        *[F.col(n).cast("double").alias(n) for n in names],
        *[F.lit(float(v)).alias(k) for k, v in facts.items()],
    )
    return table.unpivot(list(keep), [*names, *facts], "metric", "value")


def ensemble_gain(accuracies: DataFrame, ensemble_accuracy: Column | float) -> DataFrame:
    """One row: mean accuracy of the single models and the ensemble's gain over it."""
    if not isinstance(ensemble_accuracy, Column):
        ensemble_accuracy = F.lit(float(ensemble_accuracy))
    return accuracies.agg(F.avg("accuracy").alias("mean_accuracy")).select(
        "mean_accuracy",
        ensemble_accuracy.alias("ensemble_accuracy"),
        (ensemble_accuracy - F.col("mean_accuracy")).alias("gain"),
    )


def best_model(metrics: DataFrame, tie_order: Sequence[str], model: str = "model") -> DataFrame:
    """One row: the most accurate model; equal accuracies go to the earlier in ``tie_order``."""
    position = F.array_position(F.array(*[F.lit(m) for m in tie_order]), F.col(model))
    rank = F.struct(F.col("accuracy"), F.when(position > 0, -position).alias("preference"))
    return metrics.agg(
        F.max_by(model, rank).alias("best_model"), F.max("accuracy").alias("best_accuracy")
    )


def judge(
    metrics: DataFrame,
    target: float = TARGET_ACCURACY,
    baseline: float = BASELINE_ACCURACY,
    high: float = VERDICT_HIGH,
    medium: float = VERDICT_MEDIUM,
) -> DataFrame:
    """Add target gap, gain over a baseline and a verdict to any table with ``accuracy``."""
    accuracy = F.col("accuracy")
    return metrics.withColumns(
        {
            "target_met": accuracy >= target,
            "target_gap": F.greatest(F.lit(target) - accuracy, F.lit(0.0)),
            "baseline_gain": accuracy - F.lit(baseline),
            "verdict": F.when(accuracy > high, "very effective")
            .when(accuracy > medium, "good")
            .otherwise("not enough"),
        }
    )
