"""Looking at raw files and features before training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.operators.quantiles import exact_quantiles
from featurevote.values import TOP_IMPORTANCES


def dataset_overview(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per group and their share of the whole table."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("share", F.col("n_rows") / total)


def file_sizes(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number and size of files per group, from metadata only."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("total_bytes"),
        F.min("length").alias("min_bytes"),
        F.max("length").alias("max_bytes"),
        F.avg("length").alias("mean_bytes"),
    )


def image_dimensions(images: DataFrame, by: Sequence[str] = (), image: str | None = "image") -> DataFrame:
    """Images per group and size, so any statistic of the dimensions can follow from it. The size is that of
    a decoded ``image``, or with None the columns height and width, as from ``prepare.with_header``."""
    inside = f"{image}." if image else ""
    return images.groupBy(
        *by, F.col(f"{inside}height").alias("height"), F.col(f"{inside}width").alias("width")
    ).agg(F.count(F.lit(1)).alias("n_images"))


def feature_statistics(df: DataFrame, features: str = "features") -> DataFrame:
    """Count, mean, deviation, extremes and non-zeros of every feature position.

    Exploded rows are reduced to one row per position inside each task.
    """
    value = F.col("value")
    return _positions(df, features).groupBy("position").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(value != 0).alias("nonzero"),
    )


def feature_distribution(
    df: DataFrame, low: float, high: float, n_bins: int = 20, features: str = "features"
) -> DataFrame:
    """(position, bin, n) over equal bins of [low, high); bins 0 and n+1 hold the rest."""
    width = (high - low) / n_bins
    inside = F.floor((F.col("value") - F.lit(low)) / F.lit(width)) + 1
    binned = F.greatest(F.lit(0), F.least(inside, F.lit(n_bins + 1))).cast("int")
    return (
        _positions(df, features)
        .groupBy("position", binned.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def feature_quantiles(
    df: DataFrame,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    features: str = "features",
) -> DataFrame:
    """(position, quantiles), exact: the smallest value with at least that share of the values up to it.

    Found by sketches in a few scans, see :mod:`featurevote.operators.quantiles`; no value is shuffled.
    Missing values count for nothing, and a position with no others has no quantiles.
    """
    found, width = exact_quantiles(df, quantiles, features)
    rows = [(p, found.get(p)) for p in range(width)]
    return df.sparkSession.createDataFrame(rows, "position int, quantiles array<double>")


def principal_components(df: DataFrame, k: int, features: str = "features"):
    """(model, rows with ``components``) for the first ``k`` principal components."""
    vectors = df.withColumn("_vector", array_to_vector(F.col(features).cast("array<double>")))
    model = PCA(k=k, inputCol="_vector", outputCol="_projected").fit(vectors)
    projected = model.transform(vectors).withColumn("components", vector_to_array("_projected"))
    return model, projected.drop("_vector", "_projected")


def feature_importances(spark: SparkSession, model) -> DataFrame:
    """(position, importance) of a fitted forest, one row per feature."""
    row = spark.createDataFrame([(model.featureImportances,)], ["importances"])
    return row.select(
        F.posexplode(vector_to_array("importances")).alias("position", "importance")
    )


def top_importances(importances: DataFrame, n: int = TOP_IMPORTANCES) -> DataFrame:
    """The ``n`` most important features; equal ones in order of position."""
    return importances.orderBy(F.desc("importance"), F.asc("position")).limit(n)


def _positions(df: DataFrame, features: str) -> DataFrame:
    # Outer, because a plain explode first filters on the array, which computes freshly
    # extracted features twice.
    array = F.col(features).cast("array<double>")
    exploded = df.select(F.posexplode_outer(array).alias("position", "value"))
    return exploded.where("position is not null")
