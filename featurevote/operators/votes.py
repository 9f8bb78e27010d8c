"""Aligning the votes of several models on a stable key and taking the majority."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.functions.vectors import rounded_mean


# Rows of a vote table that a bucket is to hold: a task that aligns tables aggregates and sorts a bucket of each.
BUCKET_ROWS = 1 << 17


def vote_name(model_id: int | str) -> str:
    return f"pred_{model_id}"


def join_votes(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join of two vote tables on the row key. The strategy is left to AQE."""
    return left.join(right, on=key, how="inner")


def long_votes(wide: DataFrame, keep: Sequence[str], model_ids: Sequence[int | str]) -> DataFrame:
    """(keep..., model_id, prediction), one row per vote of a wide table."""
    cells = [
        F.struct(F.lit(str(m)).alias("model_id"), F.col(vote_name(m)).cast("double").alias("prediction"))
        for m in model_ids
    ]
    return wide.select(*keep, F.inline(F.array(*cells)))


def align_votes(
    votes: Sequence[tuple[int | str, DataFrame]],
    keys: Sequence[str],
    prediction: str = "prediction",
) -> DataFrame:
    """Wide votes from one table per model, keeping keys that every model voted on.

    Same rows as folding inner joins over the tables, but one shuffle instead of one per table,
    reduced on the map side. Rows with a missing key are dropped, as a join drops them. Repeated equal
    votes of a model on a key count once, differing ones are an error. Put the label among ``keys``
    to carry it along.
    """
    tagged = [
        df.select(*keys, F.lit(str(m)).alias("model_id"), F.col(prediction).cast("double").alias("p"))
        for m, df in votes
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    stacked = stacked.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    names = [vote_name(m) for m, _ in votes]
    per_model = [F.max(F.when(F.col("model_id") == str(m), F.col("p"))).alias(vote_name(m)) for m, _ in votes]
    own = [F.when(F.col("model_id") == str(m), F.col("p")) for m, _ in votes]
    voted = [F.count_if(F.col("model_id") == str(m)).alias(f"_n_{vote_name(m)}") for m, _ in votes]
    differ = [F.coalesce(F.min(p) != F.max(p), F.lit(False)).alias(f"_differ_{n}") for p, n in zip(own, names, strict=True)]
    wide = stacked.groupBy(*keys).agg(*per_model, *voted, *differ)
    clash = reduce(lambda a, b: a | b, [F.col(f"_differ_{n}") for n in names])
    every = reduce(lambda a, b: a & b, [F.col(f"_n_{n}") > 0 for n in names])
    error = F.raise_error(F.lit("a key has differing votes of one model"))
    once = F.when(clash, error.cast("boolean")).otherwise(every)
    return wide.where(once).select(*keys, *names)


def bucket_count(votes: Sequence[DataFrame], least: int = 1, rows: int = BUCKET_ROWS) -> int:
    """Buckets for vote tables that are to be aligned: as many as keep a bucket of the largest one to about ``rows``
    rows, so that what a task holds does not grow with the tables; ``least`` for small ones."""
    counts = reduce(lambda a, b: a.unionAll(b), [df.agg(F.count(F.lit(1)).alias("n")) for df in votes])
    return max(least, -(-counts.agg(F.max("n")).first()[0] // rows))


def save_bucketed_votes(
    votes: DataFrame,
    table: str,
    keys: Sequence[str],
    buckets: int,
    path: str | None = None,
    prediction: str = "prediction",
) -> None:
    """Save a vote table in sorted buckets by its keys, under a name of the session's catalog.

    Tables of one number of buckets can be aligned with no further shuffle, however often; saving costs one.
    :func:`bucket_count` gives a number that suits all of them.
    ``path`` puts the files there, else they are in the warehouse. Rows with a missing key are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = votes.where(known).select(*keys, F.col(prediction).cast("double").alias("prediction"))
    # Dealt out as the buckets are, so that each bucket is one file.
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def align_bucketed_votes(
    spark: SparkSession, tables: Sequence[tuple[int | str, str]], keys: Sequence[str]
) -> DataFrame:
    """Wide votes from tables saved by :func:`save_bucketed_votes`; the same rows as :func:`align_votes` gives.

    Buckets of equal number meet each other, so neither the check for repeated keys nor the joins move a row.
    """
    error = F.raise_error(F.lit("a key has differing votes of one model")).cast("double")
    sides = []
    for model_id, table in tables:
        low, high = F.min("prediction"), F.max("prediction")
        vote = F.when(low != high, error).otherwise(high)
        sides.append(spark.table(table).groupBy(*keys).agg(vote.alias(vote_name(model_id))))
    wide = reduce(lambda a, b: a.hint("merge").join(b.hint("merge"), on=list(keys), how="inner"), sides)
    return wide.select(*keys, *[vote_name(m) for m, _ in tables])


def majority_vote(wide: DataFrame, model_ids: Sequence[int | str]) -> DataFrame:
    """Add ``ensemble_prediction`` (rounded mean) and ``vote_share``; row-local, no shuffle."""
    names = [F.col(vote_name(m)) for m in model_ids]
    total = reduce(lambda a, b: a + b, [n.cast("double") for n in names])
    return wide.withColumns(
        {
            "ensemble_prediction": rounded_mean(names),
            "vote_share": total / F.lit(float(len(names))),
        }
    )


def model_accuracy(
    votes: DataFrame, label: str = "label", prediction: str = "prediction", model: str = "model_id"
) -> DataFrame:
    """Accuracy of each model in a long vote table."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return votes.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_votes"), F.avg(hit).alias("accuracy")
    )


def label_join_fanout(tables: Sequence[DataFrame], label: str = "label") -> DataFrame:
    """Rows that joining the tables on the label alone would yield, without joining them.

    Per label the product of its counts; labels missing from a table give no rows.
    """
    counts = [
        df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias(f"n_{i}"))
        for i, df in enumerate(tables)
    ]
    joined = reduce(lambda a, b: a.join(b, on=label, how="inner"), counts)
    product = reduce(lambda a, b: a * b, [F.col(f"n_{i}") for i in range(len(tables))])
    return joined.select(label, product.alias("joined_rows"))
