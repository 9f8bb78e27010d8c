"""Batch inference: scan, features, saved model, predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.operators.features import decoded_features, image_features
from featurevote.operators.prepare import with_label
from featurevote.operators.sinks import save_predictions
from featurevote.plans.score import score
from featurevote.sources.files import read_images
from featurevote.sources.models import load_model
from featurevote.values import FILE_GLOB


def image_rows(
    spark: SparkSession,
    path: str | list[str],
    extract: Callable[[DataFrame], DataFrame] = image_features,
    name_glob: str | None = FILE_GLOB,
) -> DataFrame:
    """(path, label, features, is_valid) for every image file; the raster is not kept."""
    rows = extract(with_label(read_images(spark, path, name_glob)))
    return rows.select("path", "label", "features", "is_valid")


def predict(rows: DataFrame, model) -> DataFrame:
    """Score rows that hold ``features`` as an array; keeps every other column."""
    vectors = rows.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    return score(model, vectors).drop("features")


def predict_files(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    model_path: str,
    kind: str,
    extract: Callable[[DataFrame], DataFrame] = image_features,
    name_glob: str | None = FILE_GLOB,
) -> DataFrame:
    """Score the images below ``input_path`` with a saved model and write the predictions."""
    rows = image_rows(spark, input_path, extract, name_glob)
    predictions = predict(rows, load_model(model_path, kind))
    columns = ["path", "label", "is_valid", "prediction", "probability"]
    save_predictions(predictions, output_path, columns)
    return spark.read.schema(predictions.select(*columns).schema).parquet(output_path)


def byte_rows(
    files: DataFrame,
    decode: Callable | None = None,
    layout: str = "per_channel",
    resample: str | None = "cubic",
    content: str = "content",
) -> DataFrame:
    """A table of encoded images, as ``sinks.ingest_files`` stores them, with ``features`` and ``is_valid``
    in place of the bytes; every other column stays."""
    return decoded_features(files, decode, content, layout, resample).drop(content)


def predict_bytes(
    files: DataFrame,
    output_path: str,
    model_path: str,
    kind: str,
    keep: list[str],
    decode: Callable | None = None,
    layout: str = "per_channel",
    resample: str | None = "cubic",
) -> DataFrame:
    """Score a table of encoded images with a saved model and write the predictions: (keep..., is_valid,
    prediction, probability). Files that cannot be decoded keep their row, without a prediction."""
    rows = byte_rows(files, decode, layout, resample).select(*keep, "features", "is_valid")
    scored = predict(rows, load_model(model_path, kind))
    told = [F.when(F.col("is_valid"), F.col(c)).alias(c) for c in ("prediction", "probability")]
    predictions = scored.select(*keep, "is_valid", *told)
    save_predictions(predictions, output_path, predictions.columns)
    return files.sparkSession.read.schema(predictions.schema).parquet(output_path)


def embed_table(
    df: DataFrame,
    make_model: Callable,
    features: str,
    input_width: int,
    batch_size: int = 1024,
    output: str = "embedding",
) -> DataFrame:
    """Add ``output`` from a batch model over a fixed-width feature array column."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    model = predict_batch_udf(
        make_model,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[input_width]],
    )
    return df.withColumn(output, model(F.col(features).cast("array<double>")))
