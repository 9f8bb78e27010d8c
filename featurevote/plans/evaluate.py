"""Score once, write the narrow predictions, and take every metric from what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from featurevote.operators.ranking import auc_roc
from featurevote.operators.confusion import classification_metrics
from featurevote.operators.sinks import save_predictions, write_table
from featurevote.plans.score import score

PREDICTION_COLUMNS = ("label", "prediction", "probability", "score")


def evaluate(
    model, test_rows: DataFrame, predictions_path: str, metrics_path: str, key: str = "path"
) -> DataFrame:
    """One metric row (accuracy, precision, recall, f1_score, auc), also saved."""
    scored = score(model, test_rows)
    columns = [key, *PREDICTION_COLUMNS]
    save_predictions(scored, predictions_path, columns)
    written = test_rows.sparkSession.read.schema(scored.select(*columns).schema).parquet(predictions_path)
    metrics = evaluate_predictions(written)
    write_table(metrics, metrics_path)
    return test_rows.sparkSession.read.schema(metrics.schema).parquet(metrics_path)


def evaluate_predictions(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score"
) -> DataFrame:
    """One metric row of a scored table, which is read as often as metrics need it."""
    metrics = classification_metrics(predictions, label, prediction)
    return metrics.select(
        "accuracy",
        "precision",
        "recall",
        "f1_score",
        auc_roc(predictions, score, label).scalar().alias("auc"),
    )
