"""Whole runs: raw files to a feature table, models on all rows, ensembles of batch models.

Each run writes its tables below one folder and takes its metrics from what it wrote.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.functions.labels import label_to_int, stable_batch
from featurevote.operators.features import image_features
from featurevote.operators.prepare import valid_rows
from featurevote.operators.sinks import (
    save_model,
    save_predictions,
    save_votes,
    write_batches_verified,
    write_table,
)
from featurevote.operators.summary import best_model, ensemble_gain, judge, model_metrics
from featurevote.plans import train
from featurevote.plans.ensemble import (
    ensemble_metrics,
    ensemble_report,
    ensemble_votes,
    member_accuracy,
)
from featurevote.plans.score import score
from featurevote.sources.files import read_files, read_images, tag_below
from featurevote.sources.tables import metrics_table, read_batches
from featurevote.values import (
    FILE_GLOB,
    LABEL_PATTERN,
    LABEL_TO_INT,
    SPLIT_PATTERN,
    TARGET_ACCURACY,
    TRAIN_BATCHES,
)

ESTIMATORS = {"lr": train.logistic_regression, "rf": train.random_forest}


def extract(
    spark: SparkSession,
    source: str,
    target: str,
    layout: str = "per_channel",
    n_batches: int = TRAIN_BATCHES,
    name_glob: str | None = FILE_GLOB,
    labels: dict[str, int] | None = None,
) -> DataFrame:
    """Images below ``source`` to a feature table by split, label and batch; one report row each.

    Training rows get ``n_batches`` stable batches, test rows one. Split and class are those that the path
    names below ``source``. Files outside a split or class directory are not extracted; they are
    reported as rows with what is known of them, no batch, nothing saved and ``ok`` false. Files that
    cannot be decoded are kept with ``is_valid`` false, so that the file listing alone tells how many
    rows must arrive.
    """
    path, known = F.col("path"), F.col("label").isNotNull() & F.col("split").isNotNull()

    def tagged(files: DataFrame) -> DataFrame:
        name = tag_below(path, source, LABEL_PATTERN)
        named = files.withColumns(
            {
                "label": label_to_int(name, labels or LABEL_TO_INT),
                "split": F.nullif(tag_below(path, source, SPLIT_PATTERN), F.lit("")),
            }
        )
        return named.withColumn("batch", F.when(F.col("split") == "train", stable_batch(path, n_batches)).otherwise(1))

    rows = image_features(tagged(read_images(spark, source, name_glob)).where(known), layout=layout)
    listing = tagged(read_files(spark, source, name_glob, recursive=True).select("path"))
    report = write_batches_verified(
        rows.select("path", "features", "is_valid", "label", "split", "batch"), target, source=listing.where(known)
    )
    left_out = listing.where(~known).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_input"))
    left_out = left_out.withColumns({"batch": F.lit(None).cast("int"), "n_saved": F.lit(0).cast("bigint"), "ok": F.lit(False)})
    return report.unionByName(left_out)


def _counted(spark: SparkSession, features: str) -> DataFrame:
    """(split, label, n_rows, n_invalid) of a feature table: invalid rows take no part in fits and metrics."""
    stored = read_batches(spark, features)
    invalid = ~F.col("is_valid") if "is_valid" in stored.columns else F.lit(False)
    return stored.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(invalid).alias("n_invalid"))


def _rows(
    spark: SparkSession, features: str, split: str, keep: tuple[str, ...] = (), max_batch: int | None = None
) -> DataFrame:
    """Rows to fit or score: the split's directories only, without unreadable files."""
    stored = read_batches(spark, features, split=split, max_batch=max_batch)
    if "is_valid" in stored.columns:
        stored = valid_rows(stored)
    return train.training_rows(stored, keep=keep)


def train_on_all(
    spark: SparkSession,
    features: str,
    output: str,
    preset: str = "basic",
    key: str = "path",
    max_batch: int | None = None,
) -> DataFrame:
    """Fit the preset's models on all training rows; one metric row per model, also saved.

    Writes ``models/<kind>``, ``predictions/<kind>``, ``metrics`` and ``rows``, which counts the rows of
    the feature table and the invalid ones among them, which are not used. ``max_batch`` trains on the
    first batches only. With test rows of one class the AUC is missing.
    """
    write_table(_counted(spark, features), f"{output}/rows")
    rows = _rows(spark, features, "train", max_batch=max_batch)
    test = _rows(spark, features, "test", (key,))
    n_training = rows.count()
    seconds, parts = {}, []
    for kind in _kinds(preset):
        start = time.monotonic()
        model = train.fit_all(rows, ESTIMATORS[kind](preset))
        seconds[kind] = time.monotonic() - start
        save_model(model, f"{output}/models/{kind}")
        scored = score(model, test)
        columns = (key, "label", "prediction", "probability", "score")
        save_predictions(scored, f"{output}/predictions/{kind}", columns)
        written = spark.read.schema(scored.select(*columns).schema).parquet(f"{output}/predictions/{kind}")
        parts.append(written.withColumn("model", F.lit(kind)))
    measured = model_metrics(reduce(lambda a, b: a.unionByName(b), parts)).collect()
    names = ("accuracy", "precision", "recall", "f1_score", "auc_roc")
    rows_out = [
        (r["model"], *[None if r[n] is None else float(r[n]) for n in names], float(seconds[r["model"]]), n_training)
        for r in measured
    ]
    table = metrics_table(spark, rows_out)
    write_table(table, f"{output}/metrics")
    return table


def train_ensemble(
    spark: SparkSession,
    features: str,
    output: str,
    kind: str,
    preset: str = "mixed_batches",
    key: str = "path",
    single_class: str = "error",
    parallelism: int = 1,
    target: float = TARGET_ACCURACY,
) -> dict[str, DataFrame]:
    """One model per training batch, voting on the test rows.

    Writes ``models/<kind>_batch_<n>``, ``votes``, ``final``, ``metrics`` and ``rows``, as
    :func:`train_on_all` does. Returns the saved
    ``votes``, the ``metrics`` by name, the ``members`` and their ``gain``, and the ``verdict``.
    """
    write_table(_counted(spark, features), f"{output}/rows")
    estimator = ESTIMATORS[kind](preset)
    rows = _rows(spark, features, "train", ("batch",))
    test = _rows(spark, features, "test", (key,))
    models = train.fit_per_batch(rows, estimator, single_class=single_class, parallelism=parallelism)
    for number, model in models.items():
        save_model(model, f"{output}/models/{kind}_batch_{number}")
    voted = ensemble_votes(models, test, [key, "label"])
    save_votes(voted, f"{output}/final", f"{output}/votes")
    votes = spark.read.schema(voted.schema).parquet(f"{output}/votes")
    facts = {"training_batches": len(models)}
    for name in ("numTrees", "maxDepth"):
        if estimator.hasParam(name):
            facts[name] = estimator.getOrDefault(name)
    metrics = ensemble_report(votes, facts=facts)
    write_table(metrics, f"{output}/metrics")
    members = member_accuracy(votes, list(models))
    reached = ensemble_metrics(votes)
    return {
        "votes": votes,
        "metrics": spark.read.schema(metrics.schema).parquet(f"{output}/metrics"),
        "members": members,
        "gain": ensemble_gain(members, reached.select("accuracy").scalar()),
        "verdict": judge(reached.select("accuracy"), target=target),
    }


def compare_runs(metrics: DataFrame, tie_order: tuple[str, ...] = ("rf", "lr")) -> DataFrame:
    """The most accurate model of a metric table written by :func:`train_on_all`."""
    return best_model(metrics, tie_order)


def _kinds(preset: str) -> list[str]:
    settings = train.PRESETS[preset]
    return [kind for kind in ("lr", "rf") if getattr(settings, kind)]
