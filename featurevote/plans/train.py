"""Training presets, fitting on all rows or per batch, cross-validation.

MLlib caches its own compact copy of the rows during a fit, so the feature table is not
persisted here as well: it would be held twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.functions.labels import stable_batch
from featurevote.operators.batches import classes_per_batch
from featurevote.values import CV_FOLDS, CV_METRIC


@dataclass(frozen=True)
class Preset:
    """Settings of one published training run; an empty dict means the model is not trained."""

    lr: dict = field(default_factory=dict)
    rf: dict = field(default_factory=dict)


# The published training settings, by name of the run they belong to.
PRESETS = {
    "basic": Preset(
        lr=dict(maxIter=100, regParam=0.01, elasticNetParam=0.8),
        rf=dict(numTrees=100, maxDepth=10, seed=42),
    ),
    "quick": Preset(
        lr=dict(maxIter=100, regParam=0.01, elasticNetParam=0.0),
        rf=dict(numTrees=100, maxDepth=10, seed=42),
    ),
    "small": Preset(
        lr=dict(maxIter=10, regParam=0.01),
        rf=dict(numTrees=30, maxDepth=8, seed=42),
    ),
    "batched": Preset(
        lr=dict(maxIter=20, regParam=0.01, elasticNetParam=0.0),
        rf=dict(numTrees=50, maxDepth=10, maxBins=32, seed=42),
    ),
    "batch_safe": Preset(
        lr=dict(maxIter=100, regParam=0.01, elasticNetParam=0.8, aggregationDepth=5),
        rf=dict(numTrees=100, maxDepth=10, maxBins=32, subsamplingRate=0.8, seed=42),
    ),
    "fixed": Preset(
        lr=dict(maxIter=100, regParam=0.01, elasticNetParam=0.8, aggregationDepth=5),
        rf=dict(numTrees=100, maxDepth=10, maxBins=32, subsamplingRate=0.8, seed=42),
    ),
    "full": Preset(
        lr=dict(maxIter=20, regParam=0.01, elasticNetParam=0.0, family="binomial"),
        rf=dict(numTrees=50, maxDepth=10, maxBins=32, minInstancesPerNode=1, seed=42),
    ),
    "full_final": Preset(
        lr=dict(maxIter=10, regParam=0.01),
        rf=dict(numTrees=30, maxDepth=8, seed=42),
    ),
    "single_class_batches": Preset(
        lr=dict(maxIter=10, regParam=0.01),
        rf=dict(numTrees=20, maxDepth=8, seed=42),
    ),
    "single_class_batches_keyed": Preset(
        lr=dict(maxIter=10, regParam=0.01),
        rf=dict(numTrees=20, maxDepth=8, seed=42),
    ),
    "mixed_batches": Preset(
        lr=dict(maxIter=20, regParam=0.01),
        rf=dict(numTrees=30, maxDepth=10, seed=42),
    ),
    "mixed_batches_forest": Preset(
        rf=dict(
            numTrees=100, maxDepth=15, minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=42
        ),
    ),
    "configured": Preset(
        lr=dict(maxIter=100, regParam=0.1, elasticNetParam=0.8),
        rf=dict(numTrees=100, maxDepth=10, minInstancesPerNode=1),
    ),
}


def training_rows(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    keep: Sequence[str] = (),
    used_width: int | None = None,
) -> DataFrame:
    """(keep..., features as an ML vector, label as double); nothing else leaves the scan.

    ``used_width`` drops the padding behind that position, which holds zeros only. A linear
    model is the same without it and needs less memory; a forest samples other feature
    subsets then, so its trees differ.
    """
    array = F.col(features).cast("array<double>")
    if used_width is not None:
        array = F.slice(array, 1, used_width)
    return df.select(
        *keep,
        array_to_vector(array).alias("features"),
        F.col(label).cast("double").alias("label"),
    )


def logistic_regression(preset: str = "basic", **overrides) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", **(PRESETS[preset].lr | overrides))


def random_forest(preset: str = "basic", **overrides) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", **(PRESETS[preset].rf | overrides)
    )


def fit_all(rows: DataFrame, estimator):
    """One model on the rows of all batches."""
    return estimator.fit(rows)


class SingleClassBatch(ValueError):
    """A batch holds one class only, so no classifier can be learned from it."""


def fit_per_batch(
    rows: DataFrame,
    estimator,
    batch: str = "batch",
    batches: Sequence | None = None,
    single_class: str = "error",
    parallelism: int = 1,
) -> dict:
    """{batch: model}, one fit per batch, each a distributed job over that batch's rows.

    Read ``rows`` from a table partitioned by ``batch``: each fit then scans only its own
    directory. ``single_class`` decides on batches with one class: ``error``, ``skip``, or
    ``fit`` (the model then always answers that class). ``parallelism`` fits run at once.
    """
    if single_class not in ("error", "skip", "fit"):
        raise ValueError(f"unknown single_class choice: {single_class}")
    if batches is not None:
        rows = rows.where(F.col(batch).isin(list(batches)))
    # One row per batch: as many as there are models to fit.
    report = {r[batch]: r for r in classes_per_batch(rows, "label", batch).collect()}
    lone = sorted(b for b, r in report.items() if not r["trainable"])
    if lone and single_class == "error":
        raise SingleClassBatch(f"batches with a single class: {lone}")
    wanted = sorted(b for b in report if single_class == "fit" or report[b]["trainable"])

    def fit_one(number):
        part = rows.where(F.col(batch) == F.lit(number)).select("features", "label")
        return number, estimator.copy().fit(part)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        target = inheritable_thread_target(rows.sparkSession)(fit_one)
        return dict(pool.map(target, wanted))


def cross_validate(
    rows: DataFrame,
    key: str,
    estimator: LogisticRegression | None = None,
    reg_params: Sequence[float] = (0.01, 0.1),
    folds: int = CV_FOLDS,
    parallelism: int = 2,
) -> CrossValidatorModel:
    """k-fold cross-validation on AUC; folds follow from the key, so reruns agree."""
    estimator = estimator or logistic_regression("small")
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(reg_params)).build()
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName=CV_METRIC),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    folded = rows.withColumn("fold", stable_batch(F.col(key), folds, first=0))
    return validator.fit(folded.select("features", "label", "fold"))


def grid_scores(spark: SparkSession, validated: CrossValidatorModel, reg_params: Sequence[float]) -> DataFrame:
    """(reg_param, mean_auc), one row per grid point."""
    rows = [(float(r), float(m)) for r, m in zip(reg_params, validated.avgMetrics)]
    return spark.createDataFrame(rows, "reg_param double, mean_auc double")
