"""Forests as node tables against the fitted models they come from."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featurevote.operators.sinks import save_model
from featurevote.plans import forest
from featurevote.plans.score import score


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    made = []
    for i in range(600):
        x = [draw.gauss(0, 1) for _ in range(4)]
        made.append((i, x, float(int(x[0] > 0) + int(x[0] + x[1] > 1))))
    return spark.createDataFrame(made, "id long, features array<double>, label double").repartition(5)


def vectors(rows):
    return rows.withColumn("features", array_to_vector("features"))


def fitted(rows, tmp_path, **settings):
    model = RandomForestClassifier(seed=3, **settings).fit(vectors(rows))
    save_model(model, f"{tmp_path}/model")
    return model, forest.read_forest(rows.sparkSession, f"{tmp_path}/model")


@pytest.mark.parametrize("settings", [dict(numTrees=7, maxDepth=6), dict(numTrees=1, maxDepth=0), dict(numTrees=3, maxDepth=12)])
def test_scores_equal_the_model_to_the_last_bit(rows, tmp_path, settings):
    model, nodes = fitted(rows, tmp_path, **settings)
    odd = rows.sparkSession.createDataFrame(
        [(-1, [float("nan")] * 4, 0.0), (-2, [float("inf"), float("-inf"), 0.0, -0.0], 0.0)], rows.schema
    )
    every = rows.union(odd)
    by_nodes = {r["id"]: (r["probability"], r["prediction"], r["score"]) for r in forest.score_forest(every, nodes).collect()}
    by_model = {r["id"]: (r["probability"], r["prediction"], r["score"]) for r in score(model, vectors(every)).collect()}
    assert by_nodes == by_model and len(by_nodes) == 602


def test_importances_equal_the_model(rows, tmp_path):
    model, nodes = fitted(rows, tmp_path, numTrees=5, maxDepth=4)
    found = {r["feature"]: r["importance"] for r in forest.node_importances(nodes, 4).collect()}
    assert found == pytest.approx(dict(enumerate(model.featureImportances.toArray())))


def test_recounting_the_training_rows_gives_the_tree_again(rows, tmp_path):
    tree = RandomForestClassifier(
        numTrees=1, maxDepth=5, seed=3, featureSubsetStrategy="all", bootstrap=False
    ).fit(vectors(rows))
    save_model(tree, f"{tmp_path}/tree")
    nodes = forest.read_forest(rows.sparkSession, f"{tmp_path}/tree")
    want = {(r["tree"], r["node"]): r for r in nodes.collect()}
    for r in forest.recount(rows, nodes).collect():
        known = want[r["tree"], r["node"]]
        assert (r["n"], r["stats"]) == (known["n"], known["stats"])
        assert r["gain"] == pytest.approx(known["gain"], abs=1e-12)


def test_nodes_that_no_row_reaches_count_nothing(rows, tmp_path):
    _, nodes = fitted(rows, tmp_path, numTrees=2, maxDepth=3)
    assert {(r["n"], r["gain"], sum(r["stats"])) for r in forest.recount(rows.limit(0), nodes).collect()} == {(0, 0.0, 0.0)}
    assert {r["importance"] for r in forest.node_importances(forest.recount(rows.limit(0), nodes), 4).collect()} == {0.0}


def test_splits_by_category_are_refused(rows, tmp_path):
    coded = vectors(rows.withColumn("features", F.transform("features", lambda x: F.floor(F.abs(x)).cast("double"))))
    indexed = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=8).fit(coded).transform(coded)
    model = RandomForestClassifier(numTrees=2, seed=1, featuresCol="indexed").fit(indexed)
    save_model(model, f"{tmp_path}/model")
    with pytest.raises(forest.UnsupportedSplit):
        forest.forest_of(forest.read_forest(rows.sparkSession, f"{tmp_path}/model"))


def test_scoring_needs_no_shuffle_and_no_python(rows, tmp_path):
    _, nodes = fitted(rows, tmp_path, numTrees=2, maxDepth=3)
    stored = f"{tmp_path}/rows"
    rows.write.parquet(stored)
    plan = forest.score_forest(rows.sparkSession.read.parquet(stored), nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "UDF" not in plan
