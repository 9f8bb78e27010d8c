"""Measures that need rows in score order: ROC, precision-recall, AUC, worst mistakes.

Scores are first reduced to one row per distinct score, so equal scores (however many) never
travel as rows. Distinct scores are then cut into as many ranges as there are shuffle
partitions, at quantiles of the scores themselves. Running counts are taken inside each
range and lifted by the totals of the higher ranges, so no task sees the whole order and
the result is exact. The quantiles are constants of the plan (at most one number per shuffle
partition reaches the driver), so a retried task cuts the ranges the same way.

The scores are read twice, once for the quantiles. Give a written table, not a plan that
scores rows anew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def score_counts(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    positive: int = 1,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(by..., score, pos, neg): how many rows of either class share each score.

    A missing score ranks lowest, as minus infinity. ``weight`` names a count column where the
    input rows stand for several rows each.
    """
    return (
        df.select(
            *by,
            # Adding zero makes one of both zeros.
            (F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))) + F.lit(0.0)).alias("score"),
            (F.col(label) == F.lit(positive)).cast("bigint").alias("is_pos"),
            (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("n"),
        )
        .groupBy(*by, "score")
        .agg(
            F.sum(F.col("is_pos") * F.col("n")).alias("pos"),
            F.sum((1 - F.col("is_pos")) * F.col("n")).alias("neg"),
        )
    )


def score_bounds(df: DataFrame, score: str = "score", ranges: int | None = None) -> list[float]:
    """Increasing finite scores that cut the rows into ``ranges`` parts of about the same size."""
    ranges = max(2, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(score, shares, max(0.1 / ranges, 1e-4))
    return sorted({b for b in found if math.isfinite(b)})


def cumulative_counts(
    counts: DataFrame, bounds: Sequence[float] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Add running and total class counts to (by..., score, pos, neg).

    ``tp`` and ``fp`` count the rows of either class with this score or a higher one,
    ``n_pos`` and ``n_neg`` all of them. Any finite ``bounds`` give the same result; without
    them scores are cut at zero, as for a column that holds only missing or infinite ones.
    NaN ranks highest, minus infinity lowest.
    """
    by = list(by)
    bounds = list(bounds) or [0.0]
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="score", outputCol="_range", handleInvalid="keep")
    ranged = cut.transform(counts).withColumn("_range", F.col("_range").cast("int"))
    higher = W.partitionBy(*by).orderBy(F.desc("_range"))
    # One row per range and group: as many as there are bounds.
    lifts = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
        .select(
            F.col("_range").alias("__range"),
            *[F.col(c).alias(f"_{c}") for c in by],
            (F.sum("_pos").over(higher) - F.col("_pos")).alias("_higher_pos"),
            (F.sum("_neg").over(higher) - F.col("_neg")).alias("_higher_neg"),
            F.sum("_pos").over(W.partitionBy(*by)).alias("n_pos"),
            F.sum("_neg").over(W.partitionBy(*by)).alias("n_neg"),
        )
    )
    inside = W.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = ranged.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})
    # Missing groups are groups like others. Left join: an inner one would also test every row for them.
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_range"]])
    return running.join(lifts, same, "left").select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("tp") + F.col("_higher_pos")).alias("tp"),
        (F.col("fp") + F.col("_higher_neg")).alias("fp"),
        "n_pos",
        "n_neg",
    )


def ranked(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    positive: int = 1,
    by: Sequence[str] = (),
    weight: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Cumulative counts of a scored table, from which all curves and areas follow."""
    bounds = score_bounds(df, score, ranges)
    return cumulative_counts(score_counts(df, score, label, positive, by, weight), bounds, by)


def auc_from(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc_roc): exact area under the ROC curve, ties counted half.

    NULL where one of the classes is missing.
    """
    pos, neg, tp = (F.col(c).cast("double") for c in ("pos", "neg", "tp"))
    pairs = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    return cumulative.groupBy(*by).agg(
        F.when(pairs > 0, F.sum(neg * (tp - pos / 2)) / pairs).alias("auc_roc")
    )


def auc_roc(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    positive: int = 1,
    by: Sequence[str] = (),
    weight: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact AUC of a scored table: raw scores, vote shares or hard votes."""
    return auc_from(ranked(df, score, label, positive, by, weight, ranges), by)


def roc_curve(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, fpr, tpr) per threshold, plus the point (0, 0) with a NULL score."""
    points = cumulative.select(
        *by,
        "score",
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )
    groups = cumulative.select(*by).distinct() if by else cumulative.sparkSession.range(1)
    start = groups.select(
        *by,
        F.lit(None).cast("double").alias("score"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def precision_recall_curve(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, recall, precision) per threshold."""
    return cumulative.select(
        *by,
        "score",
        F.try_divide("tp", "n_pos").alias("recall"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def misclassified(
    df: DataFrame,
    key: str,
    n: int | None = None,
    label: str = "label",
    prediction: str = "prediction",
    confidence: str = "confidence",
) -> DataFrame:
    """Wrongly predicted rows; with ``n``, the most confident mistakes in order."""
    wrong = df.where(F.col(label) != F.col(prediction))
    if n is None:
        return wrong
    return wrong.orderBy(F.desc(confidence), F.asc(key)).limit(n)
