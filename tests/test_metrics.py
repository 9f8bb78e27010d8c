"""Metrics against MLlib's evaluators and brute force, on skewed and missing classes too."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from featurevote.operators import confusion, counts, ranking, summary
from featurevote.plans.evaluate import evaluate_predictions
from featurevote.sources import tables


@pytest.fixture(scope="module")
def scored(spark):
    """A third of all rows share one score; other scores differ."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        score = 0.25 if i % 3 == 0 else round(rng.random(), 6)
        label = int(rng.random() < 0.3 + 0.4 * score)
        rows.append((i, label, score, float(score > 0.5)))
    return spark.createDataFrame(rows, "key int, label int, score double, prediction double").cache()


def brute_auc(rows):
    wins = pairs = 0
    positives = [s for label, s in rows if label == 1]
    negatives = [s for label, s in rows if label == 0]
    for p in positives:
        for n in negatives:
            wins += 1.0 if p > n else 0.5 if p == n else 0.0
            pairs += 1
    return wins / pairs


def test_weighted_metrics_match_evaluator(spark, scored):
    row = confusion.classification_metrics(scored).first()
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1_score": "f1"}
    typed = scored.withColumn("label", F.col("label").cast("double"))
    for name, metric in names.items():
        want = MulticlassClassificationEvaluator(metricName=metric).evaluate(typed)
        assert row[name] == pytest.approx(want, abs=1e-12)
    assert row["n_rows"] == 6000


def test_multiclass_and_never_predicted_class(spark):
    rows = [(0.0, 0.0)] * 5 + [(1.0, 0.0)] * 3 + [(2.0, 2.0)] * 2 + [(1.0, 2.0)] + [(0.0, 3.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    row = confusion.classification_metrics(df).first()
    for name, metric in [("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1_score", "f1")]:
        assert row[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_exact_auc_with_a_hot_score(scored):
    got = ranking.auc_roc(scored).first()["auc_roc"]
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(scored)
    assert got == pytest.approx(want, abs=1e-10)
    sample = [(r["label"], r["score"]) for r in scored.where("key < 900").collect()]
    small = ranking.auc_roc(scored.where("key < 900")).first()["auc_roc"]
    assert small == pytest.approx(brute_auc(sample), abs=1e-12)


@pytest.mark.parametrize("ranges", [1, 2, 3, 17, 400])
def test_auc_does_not_depend_on_the_ranges(scored, ranges):
    want = ranking.auc_roc(scored, ranges=5).first()["auc_roc"]
    assert ranking.auc_roc(scored, ranges=ranges).first()["auc_roc"] == pytest.approx(want, abs=1e-12)


def test_missing_scores_rank_lowest(scored):
    holes = scored.withColumn("score", F.when(F.col("key") % 10 != 0, F.col("score")))
    filled = holes.fillna(-1.0, subset=["score"])
    want = ranking.auc_roc(filled).first()["auc_roc"]
    assert ranking.auc_roc(holes).first()["auc_roc"] == pytest.approx(want, abs=1e-12)
    last = ranking.ranked(holes).orderBy(F.desc("tp"), F.desc("fp")).first()
    assert (last["tp"], last["fp"]) == (last["n_pos"], last["n_neg"])
    assert last["n_pos"] + last["n_neg"] == 6000


def test_auc_per_model(scored):
    both = scored.withColumn("model", F.lit("up")).unionByName(
        scored.withColumn("model", F.lit("down")).withColumn("score", -F.col("score"))
    )
    got = {r["model"]: r["auc_roc"] for r in ranking.auc_roc(both, by=["model"]).collect()}
    assert got["up"] + got["down"] == pytest.approx(1.0)
    assert got["up"] == pytest.approx(ranking.auc_roc(scored).first()["auc_roc"])


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_groups_are_ranked_apart_whatever_the_ranges(spark, ranges):
    draw = random.Random(ranges)
    made = []
    for group in ["a", "b", None, "z"]:
        n = {"a": 700, "b": 3, None: 90, "z": 1}[group]
        made += [(group, draw.choice([0.5, 0.5, draw.random(), None, float("nan"), -0.0, 0.0]), draw.randrange(2)) for _ in range(n)]
    df = spark.createDataFrame(made, "g string, score double, label int").repartition(6)
    got = ranking.ranked(df, by=["g"], ranges=ranges).collect()

    def key(score):
        return float("-inf") if score is None else float("inf") if score != score else score + 0.0

    want = set()
    for group in ["a", "b", None, "z"]:
        rows = [(key(s), y) for g, s, y in made if g == group]
        for at in {s for s, _ in rows}:
            tp, fp = (sum(1 for s, y in rows if s >= at and y == c) for c in (1, 0))
            want.add((group, at, tp, fp, sum(y for _, y in rows), sum(1 - y for _, y in rows)))
    found = {(r["g"], key(r["score"]), r["tp"], r["fp"], r["n_pos"], r["n_neg"]) for r in got}
    assert found == want and len(got) == len(want)


def test_rows_are_read_once_for_all_groups(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.selectExpr("l_linestatus as g", "l_extendedprice as score", "int(l_tax > 0.04) as label")
    df = ranking.auc_roc(lines, by=["g"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Scores are reduced before they travel; the ranges' totals reuse that exchange.
    assert plan.count("FileScan") == 1 and "partial_sum" in plan and "ReusedExchange" in plan


def test_hard_vote_auc_is_ordinary_auc_of_the_vote(scored):
    hard = confusion.hard_vote_metrics(scored).first()["auc_roc"]
    assert hard == pytest.approx(ranking.auc_roc(scored, score="prediction").first()["auc_roc"])
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="prediction", numBins=0)
    assert hard == pytest.approx(evaluator.evaluate(scored))


def test_single_class(spark):
    df = spark.createDataFrame([(1, 0.3, 1.0), (1, 0.9, 0.0)], "label int, score double, prediction double")
    assert ranking.auc_roc(df).first()["auc_roc"] is None
    assert confusion.hard_vote_metrics(df).first()["auc_roc"] is None
    cells = confusion.error_rates(confusion.confusion_cells(df)).first().asDict()
    assert cells == {
        "true_negatives": 0, "false_positives": 0, "false_negatives": 1, "true_positives": 1,
        "false_positive_rate": 0.0, "false_negative_rate": 0.5,
    }


def test_curves_end_where_they_must(scored):
    cumulative = ranking.ranked(scored)
    roc = ranking.roc_curve(cumulative).orderBy("fpr", "tpr").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    assert len(roc) == scored.select("score").distinct().count() + 1
    area = sum(
        (b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(roc, roc[1:])
    )
    assert area == pytest.approx(ranking.auc_roc(scored).first()["auc_roc"], abs=1e-9)
    pr = ranking.precision_recall_curve(cumulative).agg(F.max("recall"), F.min("precision")).first()
    assert pr[0] == 1.0 and 0 < pr[1] < 1


def test_misclassified_whole_and_top(scored):
    df = scored.withColumn("confidence", F.abs(F.col("score") - 0.5))
    whole = ranking.misclassified(df, "key")
    assert whole.count() == df.where("label <> prediction").count()
    top = [r["confidence"] for r in ranking.misclassified(df, "key", 10).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 10
    assert top[0] == whole.agg(F.max("confidence")).first()[0]


def test_best_model_ties(spark):
    df = spark.createDataFrame([("lr", 0.8), ("rf", 0.8), ("other", 0.1)], "model string, accuracy double")
    assert summary.best_model(df, ["rf", "lr"]).first()["best_model"] == "rf"
    assert summary.best_model(df, ["lr", "rf"]).first()["best_model"] == "lr"


def test_judge_bands(spark):
    df = spark.createDataFrame([(0.9,), (0.85,), (0.8,), (0.7,), (0.6,)], "accuracy double")
    rows = summary.judge(df).collect()
    assert [r["verdict"] for r in rows] == ["very effective", "good", "good", "not enough", "not enough"]
    assert [r["target_met"] for r in rows] == [True, True, False, False, False]
    assert rows[2]["target_gap"] == pytest.approx(0.05) and rows[0]["target_gap"] == 0.0
    assert rows[0]["baseline_gain"] == pytest.approx(0.9 - 0.7671)


def test_long_metrics_with_facts(spark):
    wide = spark.createDataFrame([(0.5, 7)], "accuracy double, n_rows bigint")
    rows = {r["metric"]: r["value"] for r in summary.long_metrics(wide, ["accuracy", "n_rows"], facts={"num_trees": 100}).collect()}
    assert rows == {"accuracy": 0.5, "n_rows": 7.0, "num_trees": 100.0}


def test_evaluate_predictions(scored):
    row = evaluate_predictions(scored).first()
    assert row["auc"] == pytest.approx(ranking.auc_roc(scored).first()["auc_roc"])


def test_expected_counts(spark):
    wanted = spark.createDataFrame([("train", 1), ("train", 2)], "split string, batch int")
    have = spark.createDataFrame([("train", 1)] * 3, "split string, batch int")
    got = counts.counts_against_expected(have, wanted, ["split", "batch"])
    assert {(r["batch"], r["n_rows"]) for r in got.collect()} == {(1, 3), (2, 0)}
    total = counts.compare_total(got, 5).first()
    assert (total["actual"], total["difference"], total["complete"]) == (3, -2, False)
    nothing = counts.counts_against_expected(None, wanted, ["split", "batch"])
    assert counts.total_band(nothing).first()["band"] == "empty"
    assert counts.total_band(got, 3).first()["band"] == "enough"


def test_metric_tables(spark):
    seven = tables.metrics_table(spark, [("lr", 0.1, 0.2, 0.3, 0.4, 0.5, 6.0)])
    eight = tables.metrics_table(spark, [("lr", 0.1, 0.2, 0.3, 0.4, 0.5, 6.0, 7)])
    assert len(seven.columns) == 7 and eight.columns[-1] == "training_samples"
    assert [f.name for f in seven.schema if not f.nullable] == ["model", "training_time_seconds"]


def test_metrics_read_the_data_once(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_tax") > 0.04).cast("int").alias("prediction"),
    )
    plan = confusion.hard_vote_metrics(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "partial_count" in plan
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan
