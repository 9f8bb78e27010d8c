"""Loading saved MLlib models for scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegressionModel,
    RandomForestClassificationModel,
)

READERS = {
    "lr": LogisticRegressionModel,
    "rf": RandomForestClassificationModel,
    "pipeline": PipelineModel,
}


def load_model(path: str, kind: str):
    """Model saved at ``path``; ``kind`` is one of lr, rf, pipeline."""
    return READERS[kind].load(path)
