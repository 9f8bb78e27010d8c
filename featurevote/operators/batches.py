"""Splitting rows into batches, size presets and the check on classes per batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featurevote.functions.labels import key_hash, stable_batch
from featurevote.values import SPLIT_SEED, SPLIT_WEIGHTS, TRAIN_BATCHES


def with_batch(df: DataFrame, key: str | Column, n_batches: int = TRAIN_BATCHES) -> DataFrame:
    """Add ``batch`` (1..n) from the key; the same key is in the same batch in every job."""
    column = F.col(key) if isinstance(key, str) else key
    return df.withColumn("batch", stable_batch(column, n_batches))


def quota_batches(
    df: DataFrame, key: str, n_batches: int = TRAIN_BATCHES, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add ``batch`` (1..n) so that the batches of each group in ``by`` differ by one row at most.

    Rows of a group are ranked by the key's hash, then the key, and dealt out in turn; keys should be
    unique, as rows of one key are ranked in any order. The hash is cut into even ranges: each ranks its
    own rows, lifted by the totals of the ranges before it, so no task ranks a whole group. One shuffle of
    the rows; the totals have a row for each group and range.
    """
    by = list(by)
    ranges = max(1, ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_hash", key_hash(F.col(key)))
    rows = rows.withColumn("_range", F.shiftright(F.col("_hash") * F.lit(ranges), 32).cast("int"))
    held = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_held"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    lifts = held.select(
        F.col("_range").alias("__range"),
        *[F.col(c).alias(f"_{c}") for c in by],
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_range"]])
    inside = W.partitionBy(*by, "_range").orderBy("_hash", key)
    placed = rows.withColumn("_place", F.row_number().over(inside)).join(lifts, same, "left")
    batch = ((F.col("_before") + F.col("_place") - 1) % n_batches + 1).cast("int")
    return placed.select(*df.columns, batch.alias("batch"))


def with_split(
    df: DataFrame, key: str | Column, test_parts: int = 1, parts: int = 6
) -> DataFrame:
    """Add ``split`` (train/test) from the key: ``test_parts`` of ``parts`` go to test."""
    column = F.col(key) if isinstance(key, str) else key
    slot = stable_batch(F.concat(F.lit("split-"), column.cast("string")), parts)
    return df.withColumn("split", F.when(slot <= test_parts, "test").otherwise("train"))


def random_batches(
    df: DataFrame, weights: Sequence[float] = SPLIT_WEIGHTS, seed: int = SPLIT_SEED
) -> list[DataFrame]:
    """Seeded random split. Read from a written table: it repeats only if its input does."""
    return df.randomSplit(list(weights), seed)


def batch_sizes(df: DataFrame, *by: str) -> DataFrame:
    """Rows per batch (or per the given columns) in one pass."""
    return df.groupBy(*(by or ("batch",))).agg(F.count(F.lit(1)).alias("n_rows"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name of any number of tables."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_batches(df: DataFrame, n: int | None) -> DataFrame:
    """Size preset: batches 1..n only, all when None. Prunes partitions of a written table."""
    return df if n is None else df.where(F.col("batch") <= n)


def classes_per_batch(df: DataFrame, label: str = "label", batch: str = "batch") -> DataFrame:
    """(batch, n_classes, n_rows); a batch with one class cannot train a classifier."""
    return (
        df.groupBy(batch, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(batch)
        .agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_rows"))
        .withColumn("trainable", F.col("n_classes") > 1)
    )
