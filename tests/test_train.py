"""Fits are checked by their optimum and by recomputation, never by accuracy."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import stand_ins as S
from featurevote.functions.vectors import linear_score, logistic, pad_to_width
from featurevote.operators import explore, sinks
from featurevote.plans import ensemble, score, train
from featurevote.sources.models import load_model
from featurevote.sources.tables import read_batches


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return train.training_rows(S.laid_out(spark, sf_dir), keep=["vec_id", "batch"]).cache()


def test_probability_is_the_logistic_of_the_linear_score(rows):
    model = train.fit_all(rows, train.logistic_regression("quick"))
    again = logistic(linear_score(vector_to_array("features"), list(model.coefficients), model.intercept))
    scored = score.score(model, rows).withColumn("again", again)
    worst = scored.select(F.max(F.abs(F.col("score") - F.col("again")))).first()[0]
    assert worst < 1e-12
    assert scored.where((F.col("again") > 0.5).cast("double") != F.col("prediction")).count() == 0


def test_fit_reaches_the_optimum(rows):
    reg = 0.1
    estimator = train.logistic_regression(
        "quick", regParam=reg, standardization=False, tol=1e-10, maxIter=300
    )
    model = estimator.fit(rows)
    local = rows.select(vector_to_array("features").alias("x"), "label").toPandas()
    x, y = np.stack(local["x"]), local["label"].to_numpy()
    w = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    gradient = x.T @ (p - y) / len(y) + reg * w
    assert np.abs(gradient).max() < 1e-5 and abs((p - y).mean()) < 1e-5


def test_padding_does_not_change_a_linear_model(spark, sf_dir):
    padded = S.laid_out(spark, sf_dir).withColumn("features", pad_to_width(F.col("features"), 100))
    whole = train.logistic_regression("quick").fit(train.training_rows(padded))
    short = train.logistic_regression("quick").fit(train.training_rows(padded, used_width=64))
    assert not np.array(whole.coefficients)[64:].any()
    np.testing.assert_allclose(np.array(whole.coefficients)[:64], np.array(short.coefficients), atol=1e-6)


def test_presets_reach_the_estimators():
    assert train.logistic_regression("batch_safe").getAggregationDepth() == 5
    assert train.logistic_regression("configured").getRegParam() == 0.1
    forest = train.random_forest("mixed_batches_forest")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getFeatureSubsetStrategy()) == (100, 15, "sqrt")
    assert train.random_forest("batch_safe").getSubsamplingRate() == 0.8
    assert len(train.PRESETS) == 13


def test_one_model_per_batch(rows):
    models = train.fit_per_batch(rows, train.logistic_regression("small"), parallelism=3)
    assert sorted(models) == [1, 2, 3, 4, 5]
    alone = train.logistic_regression("small").fit(rows.where("batch = 2"))
    np.testing.assert_allclose(np.array(models[2].coefficients), np.array(alone.coefficients), atol=1e-9)
    voted = ensemble.ensemble_votes(models, rows, ["vec_id", "label"])
    assert voted.count() == rows.count()
    single = {r["vec_id"]: r["prediction"] for r in models[4].transform(rows).collect()}
    assert all(single[r["vec_id"]] == r["pred_4"] for r in voted.collect())
    plan = voted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_each_fit_reads_its_own_directories(spark, sf_dir):
    path = sinks.shared_folder(spark)
    sinks.write_table(S.laid_out(spark, sf_dir), path, sinks.FEATURE_LAYOUT)
    stored = train.training_rows(read_batches(spark, path, split="train"), keep=["batch"])
    part = stored.where(F.col("batch") == 3).select("features", "label")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "(batch#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "ReadSchema: struct<features:array<float>>" in plan and "EvalPython" not in plan


def test_forest_votes_like_its_own_prediction(rows):
    model = train.random_forest("small", numTrees=5).fit(rows)
    wide = score.score_all({1: model}, rows, ["vec_id"])
    single = {r["vec_id"]: r["prediction"] for r in model.transform(rows).collect()}
    assert all(single[r["vec_id"]] == r["pred_1"] for r in wide.collect())


def test_single_class_batches(rows):
    mixed = rows.withColumn("batch", F.when(F.col("label") == 1, 1).otherwise(2)).where("batch = 1")
    odd = mixed.unionByName(rows.where("batch = 3"))
    estimator = train.logistic_regression("single_class_batches")
    with pytest.raises(train.SingleClassBatch, match=r"\[1\]"):
        train.fit_per_batch(odd, estimator)
    assert sorted(train.fit_per_batch(odd, estimator, single_class="skip")) == [3]
    fitted = train.fit_per_batch(odd, estimator, single_class="fit")
    assert math.isinf(fitted[1].intercept)
    always = fitted[1].transform(rows).select("prediction").distinct().collect()
    assert [r[0] for r in always] == [1.0]
    with pytest.raises(ValueError):
        train.fit_per_batch(odd, estimator, single_class="whatever")


def test_cross_validation_is_repeatable(spark, rows):
    first = train.cross_validate(rows, "vec_id").avgMetrics
    again = train.cross_validate(rows.repartition(5), "vec_id").avgMetrics
    assert len(first) == 2 and first == pytest.approx(again, abs=1e-6)
    table = train.grid_scores(spark, train.cross_validate(rows, "vec_id", reg_params=[0.5]), [0.5])
    assert table.count() == 1


def test_importances(spark, rows):
    model = train.random_forest("small", numTrees=5).fit(rows)
    importances = explore.feature_importances(spark, model)
    assert importances.count() == 64
    assert importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    top = [r["importance"] for r in explore.top_importances(importances).collect()]
    assert len(top) == 10 and top == sorted(top, reverse=True)


@pytest.mark.parametrize("kind", ["lr", "rf"])
def test_saved_model_scores_the_same(spark, rows, kind):
    estimator = train.logistic_regression("small") if kind == "lr" else train.random_forest("small", numTrees=3)
    model = estimator.fit(rows)
    path = sinks.shared_folder(spark)
    sinks.save_model(model, path)
    sinks.save_model(model, path)
    before = {r["vec_id"]: r["score"] for r in score.score(model, rows).collect()}
    after = {r["vec_id"]: r["score"] for r in score.score(load_model(path, kind), rows).collect()}
    assert before == after


def test_principal_components(spark, sf_dir):
    frame = S.feature_rows(spark, sf_dir)
    model, projected = explore.principal_components(frame, 2, "embedding")
    assert model.explainedVariance[0] >= model.explainedVariance[1]
    x = np.stack(frame.toPandas()["embedding"]).astype(float)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    np.testing.assert_allclose(np.array(model.explainedVariance), want[:2] / want.sum(), rtol=1e-6)
    assert projected.select(F.size("components")).distinct().collect()[0][0] == 2


def test_fresh_models_score_after_verified_writes(spark, sf_dir, rows):
    sinks.write_verified(S.laid_out(spark, sf_dir), sinks.shared_folder(spark)).collect()
    model = train.logistic_regression("small").fit(rows)
    assert score.score(model, rows).count() == rows.count()
    assert len(score.score_all({1: model}, rows, ["vec_id"]).collect()) == rows.count()
