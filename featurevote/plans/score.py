"""Applying one or several fitted models, or fixed linear weights, to feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurevote.functions.vectors import linear_score
from featurevote.operators.votes import vote_name


def score(model, rows: DataFrame) -> DataFrame:
    """``model.transform`` with the probabilities as an array and ``score`` = P(class 1)."""
    scored = model.transform(rows).withColumn("probability", vector_to_array("probability"))
    return scored.withColumn("score", F.col("probability")[1]).drop("rawPrediction")


def score_all(models: Mapping[int, object], rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., pred_k for every model) in one pass over the rows, without any join.

    All models see the same row in the same task, so votes are aligned by construction.
    """
    for number, model in models.items():
        voter = model.copy()
        voter.setPredictionCol(vote_name(number))
        voter.setProbabilityCol("")
        voter.setRawPredictionCol("")
        rows = voter.transform(rows)
    return rows.select(*keep, *[vote_name(number) for number in models])


def score_linear(
    rows: DataFrame,
    weights: Mapping[int | str, Sequence[float]],
    features: str = "features",
    threshold: float = 0.0,
) -> DataFrame:
    """Add ``pred_k`` = 1 where the dot product with the k-th weights exceeds the threshold."""
    return rows.withColumns(
        {
            vote_name(k): (linear_score(F.col(features), w) > threshold).cast("double")
            for k, w in weights.items()
        }
    )
