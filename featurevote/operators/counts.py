"""Row counts against what is expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurevote.values import EXPECTED_TOTAL, EXPECTED_TRAIN


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(label)


def counts_against_expected(
    df: DataFrame | None, expected: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Rows per expected group, 0 for groups that are absent; ``None`` stands for no table.

    ``expected`` is the caller's list of groups, so it is as small as that list; the data
    side is reduced to one row per group before the join.
    """
    if df is None:
        return expected.withColumn("n_rows", F.lit(0).cast("bigint"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return expected.join(counts, on=list(keys), how="left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint"))
    )


def compare_total(counts: DataFrame, expected: int = EXPECTED_TOTAL) -> DataFrame:
    """One row: total, expected, signed difference, whether they are equal."""
    total = F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint"))
    return counts.agg(total.alias("actual")).select(
        "actual",
        F.lit(expected).cast("bigint").alias("expected"),
        (F.col("actual") - F.lit(expected)).cast("bigint").alias("difference"),
        (F.col("actual") == F.lit(expected)).alias("complete"),
    )


def total_band(counts: DataFrame, enough: int = EXPECTED_TRAIN) -> DataFrame:
    """One row: total and whether it is ``enough``, ``partial`` or ``empty``."""
    total = F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint"))
    return counts.agg(total.alias("actual")).withColumn(
        "band",
        F.when(F.col("actual") >= enough, "enough")
        .when(F.col("actual") > 0, "partial")
        .otherwise("empty"),
    )


def batch_run_summary(results: DataFrame) -> DataFrame:
    """One row over per-batch write results: batches written whole, batches, rows saved."""
    return results.agg(
        F.count_if("ok").alias("ok_batches"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_saved").alias("n_samples"),
    )
