"""Confusion matrix and every metric that follows from it.

The data is read once: ``groupBy(label, prediction).count()`` is reduced on the map side to
at most (classes squared) rows per task, so one huge class costs nothing extra. All metrics
are then computed from those few rows, by model where ``by`` names columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., label, prediction, count)."""
    return df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("count"))


def confusion_cells(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    positive: int = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """True/false negatives/positives per group; 0 where a class does not occur."""
    actual, said = F.col(label) == F.lit(positive), F.col(prediction) == F.lit(positive)
    return df.groupBy(*by).agg(
        F.count_if(~actual & ~said).alias("true_negatives"),
        F.count_if(~actual & said).alias("false_positives"),
        F.count_if(actual & ~said).alias("false_negatives"),
        F.count_if(actual & said).alias("true_positives"),
    )


def error_rates(cells: DataFrame) -> DataFrame:
    """Add false positive and false negative rates, 0 on an empty denominator."""
    return cells.withColumns(
        {
            "false_positive_rate": _share(
                F.col("false_positives"), F.col("false_positives") + F.col("true_negatives")
            ),
            "false_negative_rate": _share(
                F.col("false_negatives"), F.col("false_negatives") + F.col("true_positives")
            ),
        }
    )


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., n_rows, accuracy, precision, recall, f1_score), weighted by class support."""
    return metrics_from_matrix(confusion_matrix(df, label, prediction, by), label, prediction, by)


def hard_vote_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """As :func:`classification_metrics`, plus ``auc_roc`` of the 0/1 prediction itself.

    A single threshold makes the area the mean of the two classes' recalls, so no ordering
    is needed. NULL unless both classes occur.
    """
    return metrics_from_matrix(confusion_matrix(df, label, prediction, by), label, prediction, by, True)


def metrics_from_matrix(
    matrix: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
    hard_auc: bool = False,
) -> DataFrame:
    n, zero = F.col("count"), F.lit(0).cast("bigint")
    actual, said = F.col(label).cast("double"), F.col(prediction).cast("double")
    sides = F.array(
        F.struct(
            actual.alias("class"),
            n.alias("support"),
            zero.alias("predicted"),
            F.when(actual == said, n).otherwise(zero).alias("hits"),
        ),
        F.struct(said.alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")),
    )
    classes = (
        matrix.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    support, predicted, hits = F.col("support"), F.col("predicted"), F.col("hits")
    total = F.sum("support")
    recalls = F.when(support > 0, hits / support)
    area = F.when(F.count(recalls) == 2, F.avg(recalls)).alias("auc_roc")
    return classes.groupBy(*by).agg(
        total.alias("n_rows"),
        _share(F.sum(hits), total).alias("accuracy"),
        _share(F.sum(support * _share(hits, predicted)), total).alias("precision"),
        _share(F.sum(support * _share(hits, support)), total).alias("recall"),
        _share(F.sum(support * _share(2 * hits, predicted + support)), total).alias("f1_score"),
        *([area] if hard_auc else []),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
