"""Scans of feature, prediction and metric tables, and small tables from local rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType(), False)]
    + [
        T.StructField(name, T.DoubleType(), name != "training_time_seconds")
        for name in ("accuracy", "precision", "recall", "f1_score", "auc_roc", "training_time_seconds")
    ]
)
METRICS_SCHEMA_WITH_SAMPLES = T.StructType(
    METRICS_SCHEMA.fields + [T.StructField("training_samples", T.LongType(), False)]
)


def read_table(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """One table, or several directories named by glob signs in the path.

    Directories called ``name=value`` need ``base_path``, the root of the table they belong to.
    """
    return read_tables(spark, [path], base_path)


def read_tables(spark: SparkSession, paths: Sequence[str], base_path: str | None = None) -> DataFrame:
    """One scan over several directories of the same schema.

    With ``base_path``, ``name=value`` directories below it come back as columns.
    """
    reader = spark.read
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.parquet(*paths)


def read_batches(
    spark: SparkSession,
    root: str,
    split: str | None = None,
    labels: Sequence[str] | None = None,
    max_batch: int | None = None,
) -> DataFrame:
    """Partition-pruned scan of a feature table laid out by split, label and batch."""
    df = spark.read.parquet(root)
    if split is not None:
        df = df.where(F.col("split") == split)
    if labels is not None:
        df = df.where(F.col("label").isin(list(labels)))
    if max_batch is not None:
        df = df.where(F.col("batch") <= max_batch)
    return df


def read_existing_tables(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """One scan over those paths that hold a table; None when none does."""
    found = []
    for path in paths:
        try:
            spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            found.append(path)
    return spark.read.parquet(*found) if found else None


def metrics_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Metric rows under the explicit schema; 8 values add training_samples. A metric may be missing, as
    the AUC of a single class is."""
    with_samples = bool(rows) and len(rows[0]) == len(METRICS_SCHEMA_WITH_SAMPLES)
    schema = METRICS_SCHEMA_WITH_SAMPLES if with_samples else METRICS_SCHEMA
    return spark.createDataFrame(list(rows), schema)


def local_table(spark: SparkSession, rows: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """Small table from Rows, dicts or tuples with inferred types."""
    return spark.createDataFrame(list(rows), list(columns) if columns else None)
