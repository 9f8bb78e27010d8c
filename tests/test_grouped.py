"""Many logistic regressions in one scan for each step, against MLlib's own, one by one."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featurevote.plans import grouped, train


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    made = []
    for i in range(900):
        x = [draw.gauss(0, 1), draw.gauss(5, 20), draw.random(), 3.0]
        y = int(x[0] + 0.05 * x[1] + draw.gauss(0, 1) > 0.3)
        made.append((i, i % 3, x, y))
    return spark.createDataFrame(made, "id long, batch int, features array<double>, label int").repartition(7)


def by_mllib(rows, reg, standardize):
    vectors = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(regParam=reg, standardization=standardize, tol=1e-13, maxIter=500).fit(vectors)


@pytest.mark.parametrize("standardize", [True, False])
def test_every_batch_and_penalty_equals_mllib(rows, standardize):
    fits = grouped.fit_grid(rows, grouped.batch_models(range(3), (0.001, 0.5)), standardize=standardize)
    assert len(fits) == 6 and all(f.gradient <= 1e-9 and f.steps < 15 for f in fits)
    for f in fits:
        (batch,) = f.model.parts
        own = rows.where(F.col("batch") == batch)
        model = by_mllib(own, f.model.reg_param, standardize)
        assert f.n_rows == own.count() == 300
        if standardize:  # a feature without spread has no coefficient
            assert f.coefficients[3] == pytest.approx(0.0, abs=1e-7) or model.coefficients[3] == 0.0
        scores = np.array([r[0] for r in own.orderBy("id").select("features").collect()])
        ours = scores @ np.array(f.coefficients) + f.intercept
        theirs = scores @ model.coefficients.toArray() + model.intercept
        np.testing.assert_allclose(ours, theirs, atol=2e-4)


def test_folds_learn_from_the_other_folds(rows):
    fits = grouped.fit_grid(rows, grouped.fold_models(3, (0.1,)), "batch")
    for f in fits:
        (left_out,) = frozenset(range(3)) - f.model.parts
        model = by_mllib(rows.where(F.col("batch") != left_out), 0.1, True)
        assert f.n_rows == 600
        np.testing.assert_allclose(f.coefficients[:3], model.coefficients.toArray()[:3], atol=1e-5)
    scored = grouped.score_grid(rows, fits, ["id", "batch"], "batch").collect()
    assert len(scored) == 900 and all(r["model"] == f"fold_{r['batch']}_reg_0.1" for r in scored)
    own = grouped.score_grid(rows, fits, ["id", "batch"], "batch", own=True)
    assert own.count() == 1800


def test_validation_equals_mllib(rows):
    vectors = train.training_rows(rows, keep=["id"])
    estimator = train.logistic_regression("small", maxIter=300, tol=1e-12)
    regs = (0.01, 1.0)
    theirs = train.cross_validate(vectors, "id", estimator, regs).avgMetrics
    ours = {r["reg_param"]: r["mean_auc"] for r in grouped.cross_validate_grid(rows, "id", regs).collect()}
    assert [ours[r] for r in regs] == pytest.approx(theirs, abs=2e-4)


def test_wild_features_still_reach_the_minimum(spark):
    draw = random.Random(5)
    made = [(1, [draw.gauss(0, 1) ** 5 * 100, draw.gauss(0, 1)], draw.randrange(2)) for _ in range(300)]
    rows = spark.createDataFrame(made, "batch int, features array<double>, label int")
    (fit,) = grouped.fit_grid(rows, grouped.batch_models([1], (1e-6,)), standardize=False, tol=1e-7)
    assert fit.gradient <= 1e-7


def test_what_cannot_be_fitted_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        grouped.fit_grid(rows, grouped.batch_models([0, 9], (0.1,)))
    with pytest.raises(ValueError, match="no rows"):
        grouped.fit_grid(rows.limit(0), grouped.batch_models([0], (0.1,)))
    apart = spark.createDataFrame([(1, [float(i)], int(i > 3)) for i in range(8)], "batch int, features array<double>, label int")
    with pytest.raises(ValueError, match="not at the minimum"):
        grouped.fit_grid(apart, grouped.batch_models([1], (0.0,)), max_steps=6)


def test_each_step_reads_the_rows_once(rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/rows")
    stored = rows.sparkSession.read.parquet(f"{tmp_path}/rows")
    slim = stored.select(F.col("batch").alias("part"), F.col("features").alias("x"), F.col("label").cast("double").alias("y"))
    fits = [grouped.Fitted(m, np.zeros(5)) for m in grouped.batch_models(range(3), (0.1, 1.0))]
    plan = grouped._sums(slim, 4, fits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
