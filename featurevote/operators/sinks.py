"""Writing tables and checking what was written.

Checks read narrow columns back instead of observing the write: once a Spark 4.1 session has
used an ``Observation``, freshly fitted models can no longer be sent to its executors.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featurevote.functions.labels import key_hash
from featurevote.sources.files import file_status, read_files, read_first_files, read_readable_files, tag_below
from featurevote.values import FILE_GLOB, LABEL_PATTERN, SPLIT_PATTERN

FEATURE_LAYOUT = ("split", "label", "batch")
# What ingest_files writes.
INGESTED = "path string, modificationTime timestamp, length bigint, content binary, stored int, split string, label string"


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, reachable by every executor.

    Only a local-mode session without that setting gets one temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, partitioned by directory where columns are named."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def spread_for_layout(
    df: DataFrame, layout: Sequence[str], key: str, files_per_group: int
) -> DataFrame:
    """Shuffle so that each layout group is written as about ``files_per_group`` files.

    The group is salted by the key's hash, so one large group is written by many tasks.
    Costs a shuffle of the whole table; without it every task writes one file per group
    that it holds, which is the better choice for scans already ordered by group.
    """
    salt = (key_hash(F.col(key)) % files_per_group).alias("_salt")
    return df.repartition(*[F.col(c) for c in layout], salt)


def write_verified(
    df: DataFrame, path: str, partition_by: Sequence[str] = FEATURE_LAYOUT
) -> DataFrame:
    """Write, read back, compare totals: (partition columns..., n_saved, n_written, total_saved, ok).

    ``ok`` holds for all groups or none. Use :func:`write_batches_verified` to see which
    group is short.
    """
    batches = write_batches_verified(df, path, partition_by)
    # One row per group.
    everything = W.partitionBy()
    return batches.select(
        *partition_by,
        "n_saved",
        F.sum("n_input").over(everything).alias("n_written"),
        F.sum("n_saved").over(everything).alias("total_saved"),
    ).withColumn("ok", F.col("n_written") == F.col("total_saved"))


def _as_stored(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Partition values as they read back: an empty string is stored as a missing one."""
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return [F.nullif(F.col(k), F.lit("")).alias(k) if k in texts else F.col(k) for k in keys]


def _side_by_side(sides: Sequence[tuple[DataFrame, dict[str, Column]]], keys: Sequence[str]) -> DataFrame:
    """The aggregates of several tables by common groups, 0 where a table lacks the group. Missing
    keys are a group like others, which a join would not match."""
    names = [name for _, aggregates in sides for name in aggregates]
    rows = []
    for df, aggregates in sides:
        own = df.groupBy(*_as_stored(df, keys)).agg(*[a.alias(n) for n, a in aggregates.items()])
        rows.append(own.withColumns({n: F.lit(0).cast("bigint") for n in names if n not in aggregates}))
    both = reduce(lambda a, b: a.unionByName(b), rows)
    return both.groupBy(*keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def write_batches_verified(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = FEATURE_LAYOUT,
    source: DataFrame | None = None,
) -> DataFrame:
    """Write, read back, compare: (partition columns..., n_input, n_saved, ok) for every batch.

    The input is counted by its partition columns alone: columns that are only written, such
    as features, are not computed again. ``source`` is counted in place of ``df`` where the
    same rows are cheaper to get, as from a file listing. The rows saved come from Parquet
    footers.
    """
    write_table(df, path, partition_by)
    keys = list(partition_by)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    n = F.count(F.lit(1))
    counted = _side_by_side([(df if source is None else source, {"n_input": n}), (saved, {"n_saved": n})], keys)
    return counted.withColumn("ok", F.col("n_input") == F.col("n_saved"))


def batch_checksums(df: DataFrame, partition_by: Sequence[str] = FEATURE_LAYOUT) -> DataFrame:
    """(partition columns..., n_rows, checksum) for every batch: a sum of the rows' hashes over all columns, so
    it depends on what the rows hold and on how often, and not on their order or files."""
    keys = list(partition_by)
    # By name, as a written table has its partition columns at the end.
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c not in keys]).cast("decimal(38,0)")
    stored = _as_stored(df, keys)
    return df.groupBy(*stored).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("checksum"))


def write_with_manifest(
    df: DataFrame, path: str, manifest: str, partition_by: Sequence[str] = FEATURE_LAYOUT
) -> DataFrame:
    """Write batches, check their row counts, and keep their checksums as a table of their own; returns the
    report of :func:`write_batches_verified`. The checksums are taken from what was written."""
    report = write_batches_verified(df, path, partition_by)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    write_table(batch_checksums(written, partition_by), manifest)
    return report


def check_batches(
    spark: SparkSession, path: str, manifest: str, partition_by: Sequence[str] = FEATURE_LAYOUT
) -> DataFrame:
    """(partition columns..., ok) for every batch of the manifest or the table: whether it holds just the rows
    that it was written with. Batches that are missing, short, changed or not in the manifest are not ok."""
    keys = list(partition_by)
    known = spark.read.parquet(manifest)
    now = batch_checksums(spark.read.schema(_stored_schema(spark, path, known, keys)).parquet(path), keys)
    both = known.withColumn("_now", F.lit(0)).unionByName(now.withColumn("_now", F.lit(1)))
    told = both.groupBy(*keys).agg(F.collect_set(F.struct("n_rows", "checksum")).alias("told"), F.count(F.lit(1)).alias("sides"))
    return told.select(*keys, ((F.col("sides") == 2) & (F.size("told") == 1)).alias("ok"))


def _stored_schema(spark: SparkSession, path: str, known: DataFrame, keys: Sequence[str]):
    """The table's schema with its partition columns as the manifest has them: folder names alone do not
    tell a number from a text."""
    inferred = spark.read.parquet(path).schema
    kinds = {f.name: f.dataType for f in known.schema if f.name in keys}
    for field in inferred:
        field.dataType = kinds.get(field.name, field.dataType)
    return inferred


def rewrite_batches(
    df: DataFrame, path: str, manifest: str, partition_by: Sequence[str] = FEATURE_LAYOUT
) -> DataFrame:
    """Write those batches again that :func:`check_batches` finds wrong, and no others; returns the batches
    (partition columns..., ok) after that. ``df`` holds the rows of all batches; only those of the wrong ones
    are computed where it is pruned by its partition columns.

    A run that was cut off is taken up by calling this again. Batches of the table that neither the
    manifest nor ``df`` knows stay, and stay reported.
    """
    spark, keys = df.sparkSession, list(partition_by)
    # One row for each wrong batch.
    wrong = check_batches(spark, path, manifest, keys).where("NOT ok").select(*keys).collect()
    if wrong:
        stored = _as_stored(df, keys)
        is_wrong = [reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(r[k])) for c, k in zip(stored, keys)]) for r in wrong]
        again = df.where(reduce(lambda a, b: a | b, is_wrong))
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return check_batches(spark, path, manifest, keys)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def save_predictions(
    predictions: DataFrame,
    path: str,
    columns: Sequence[str] = ("path", "label", "prediction", "probability"),
) -> None:
    """Write the narrow projection of scored rows; feature vectors are not written again."""
    write_table(predictions.select(*columns), path)


def save_votes(
    voted: DataFrame, final_path: str, detailed_path: str, label: str = "label"
) -> None:
    """Write all votes, then the (label, vote) table from what was written."""
    write_table(voted, detailed_path)
    written = voted.sparkSession.read.schema(voted.schema).parquet(detailed_path)
    write_table(written.select(label, "ensemble_prediction"), final_path)


def ingest_files(
    spark: SparkSession,
    source: str,
    target: str,
    name_glob: str | None = FILE_GLOB,
    max_files: int | None = None,
    split: Column | None = None,
    label: Column | None = None,
    max_bytes: int | None = None,
) -> dict[str, int]:
    """Copy files into a Parquet table of bytes by split and label; returns run statistics.

    ``split`` and ``label`` default to what the path says below ``source``. A file that cannot be read, or
    is longer than ``max_bytes``, does not stop the run: it is left out and counted as failed, and
    :func:`ingest_status` names it. ``total_files`` and ``total_size`` are the files and bytes found.
    """
    if max_files is None:
        listed = read_files(spark, source, name_glob, recursive=True)
        files = read_readable_files(spark, source, name_glob, recursive=True, max_bytes=max_bytes)
    else:
        listed = read_first_files(spark, source, max_files, name_glob=name_glob, recursive=True)
        files = read_first_files(spark, source, max_files, name_glob=name_glob, recursive=True, max_bytes=max_bytes, readable=True)
    path = F.col("path")
    tagged = files.withColumns(
        {
            "label": tag_below(path, source, LABEL_PATTERN) if label is None else label,
            "split": tag_below(path, source, SPLIT_PATTERN) if split is None else split,
        }
    )
    stored = tagged.withColumn("stored", F.octet_length("content"))
    write_table(stored, target, ("split", "label"))
    written = spark.read.schema(stored.schema).parquet(target)
    stats = file_status(listed, written, max_bytes).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("length"), F.lit(0).cast("bigint")).alias("total_size"),
        F.count("error").alias("failed_files"),
    )
    return stats.first().asDict()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """A table of :func:`ingest_files`. Its schema is given, as a run of which every file failed leaves no
    Parquet file to tell it."""
    return spark.read.schema(INGESTED).parquet(target)


def ingest_status(
    spark: SparkSession,
    source: str,
    target: str,
    name_glob: str | None = FILE_GLOB,
    max_bytes: int | None = None,
) -> DataFrame:
    """(path, length, bytes, error), one row for each file below ``source``: what ``target`` holds of it."""
    listed = read_files(spark, source, name_glob, recursive=True)
    return file_status(listed, read_ingested(spark, target), max_bytes)


def verify_ingest(
    source: DataFrame, target: DataFrame, keys: Sequence[str] = ("split", "label"), size: str = "length"
) -> DataFrame:
    """Files and bytes per group on both sides, and whether they agree; no group is left out."""

    def measures(name: str) -> dict[str, Column]:
        total = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
        return {f"{name}_files": F.count(F.lit(1)), f"{name}_bytes": total}

    filled = _side_by_side([(source, measures("source")), (target, measures("target"))], keys)
    filled = filled.select(*keys, "source_files", "source_bytes", "target_files", "target_bytes")
    return filled.withColumn(
        "complete",
        (F.col("source_files") == F.col("target_files"))
        & (F.col("source_bytes") == F.col("target_bytes")),
    )


def count_files(spark: SparkSession, path: str, name_glob: str | None = None) -> int:
    """Files below a path, 0 when it does not exist."""
    try:
        return read_files(spark, path, name_glob, recursive=True).count()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
