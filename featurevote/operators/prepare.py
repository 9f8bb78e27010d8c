"""From raw files to labeled, valid rows ready for feature extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.functions.headers import image_header
from featurevote.functions.labels import label_from_path
from featurevote.sources.files import read_images
from featurevote.values import FILE_GLOB, LABEL_PATTERN


def with_label(df: DataFrame, path: str = "path", pattern: str = LABEL_PATTERN) -> DataFrame:
    return df.withColumn("label", label_from_path(F.col(path), pattern))


def with_validity(images: DataFrame, image: str = "image") -> DataFrame:
    """Add ``is_valid``: the file decoded and both sides are longer than zero."""
    valid = (F.col(f"{image}.height") > 0) & (F.col(f"{image}.width") > 0)
    return images.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def with_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``format``, ``height``, ``width`` and ``is_valid`` of encoded images, read from their bytes
    without decoding; a file that passes may still hold broken pixels."""
    return files.withColumn("_header", image_header(F.col(content))).select(*files.columns, "_header.*")


def prepare_files(files: DataFrame, path: str = "path", pattern: str = LABEL_PATTERN) -> DataFrame:
    """Label and check a table of file bytes, and keep the valid ones; the bytes stay as they are."""
    return valid_rows(with_header(with_label(files, path, pattern)))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("is_valid")


def prepare(spark: SparkSession, path: str | list[str], name_glob: str | None = FILE_GLOB) -> DataFrame:
    """Scan, label, validate and keep valid images; one lazy plan, no count per step."""
    return valid_rows(with_validity(with_label(read_images(spark, path, name_glob))))
