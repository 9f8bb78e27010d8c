"""Joins of votes, majority votes and every measure taken on predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.registry import query, table
from featurevote.functions.vectors import linear_score, logistic
from featurevote.operators import confusion, ranking, summary
from featurevote.operators import votes as O
from featurevote.operators.sinks import shared_folder, write_table
from featurevote.plans import ensemble

METRICS = ("accuracy", "precision", "recall", "f1_score")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- votes -----------------------------------------------------------------------------------


@query(f"WITH {S.ORDER_VOTES} SELECT o_orderkey, v1.label, pred_1, pred_2 FROM v1 JOIN v2 USING (o_orderkey)")
def join_votes(spark, sf_dir):
    (_, first), (_, second), *_ = S.order_votes(spark, sf_dir)
    left = first.withColumnRenamed("prediction", "pred_1")
    right = second.select("o_orderkey", F.col("prediction").alias("pred_2"))
    return O.join_votes(left, right, "o_orderkey")


@query(f"WITH {S.ORDER_VOTES} SELECT * FROM aligned")
def align_votes(spark, sf_dir):
    """Votes of five tables; the third abstains on some keys, which therefore drop out."""
    return O.align_votes(S.order_votes(spark, sf_dir), ["o_orderkey", "label"])


@query(f"WITH {S.ORDER_VOTES} SELECT * FROM aligned")
def align_bucketed_votes(spark, sf_dir):
    """The same from five tables that are saved in buckets by key."""
    keys, run = ["o_orderkey", "label"], uuid.uuid4().hex
    votes, tables = S.order_votes(spark, sf_dir), []
    buckets = O.bucket_count([rows for _, rows in votes], 8)
    for number, rows in votes:
        name = f"votes_{number}_{run}"
        O.save_bucketed_votes(rows, name, keys, buckets, path=shared_folder(spark))
        tables.append((number, name))
    return O.align_bucketed_votes(spark, tables, keys)


@query(f"""WITH {S.ORDER_VOTES}
SELECT o_orderkey, label, round((pred_1 + pred_2 + pred_3 + pred_4 + pred_5) / 5.0) AS ensemble_prediction
FROM aligned""")
def vote_on_aligned(spark, sf_dir):
    wide = O.align_votes(S.order_votes(spark, sf_dir), ["o_orderkey", "label"])
    return O.majority_vote(wide, S.MODELS).select("o_orderkey", "label", "ensemble_prediction")


@query(f"""{S.VOTES} SELECT a.label, (a.n::DOUBLE * b.n) AS joined_rows
FROM (SELECT label, count(*) AS n FROM votes GROUP BY label) a
JOIN (SELECT label, count(*) AS n FROM votes WHERE pred_1 = 1 GROUP BY label) b USING (label)""")
def label_join_fanout(spark, sf_dir):
    votes = S.votes(spark, sf_dir)
    return O.label_join_fanout([votes, votes.where("pred_1 = 1")])


@query(f"""WITH {S.FEATURE_ROWS} SELECT vec_id, round({S.sql_score(1)}, 6) AS score,
       round(1 / (1 + exp(-{S.sql_score(1)})), 6) AS probability FROM feature_rows""")
def linear_scores(spark, sf_dir):
    score = linear_score(F.col("embedding"), S.WEIGHTS[1])
    return S.feature_rows(spark, sf_dir).select(
        "vec_id", F.round(score, 6).alias("score"), F.round(logistic(score), 6).alias("probability")
    )


@query(f"{S.VOTED} SELECT vec_id, label, ensemble_prediction, vote_share FROM voted")
def majority_vote(spark, sf_dir):
    return S.voted(spark, sf_dir).select("vec_id", "label", "ensemble_prediction", "vote_share")


_FOUR = (1, 2, 3, 4)


@query(f"WITH {S.FEATURE_ROWS}, {S.sql_votes(_FOUR)}, {S.sql_voted(_FOUR)} SELECT vec_id, ensemble_prediction FROM voted")
def tied_votes(spark, sf_dir):
    """Four voters, so that splits of two against two occur; they count as 1."""
    return S.voted(spark, sf_dir, _FOUR).select("vec_id", "ensemble_prediction")


@query(f"{S.VOTES} " + " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, round(avg((pred_{m} = label)::INT), 6) AS accuracy FROM votes" for m in S.MODELS))
def member_accuracy(spark, sf_dir):
    return _rounded(ensemble.member_accuracy(S.voted(spark, sf_dir), S.MODELS), "accuracy")


@query(f"WITH {S.ORDER_VOTES} " + " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, count(*) AS n_votes, round(avg((pred_{m} = label)::INT), 6) AS accuracy FROM v{m}"
    for m in S.MODELS))
def model_accuracy(spark, sf_dir):
    """Accuracy of each model over its own votes, from one long table."""
    tagged = [
        df.withColumn("model_id", F.lit(str(m))) for m, df in S.order_votes(spark, sf_dir)
    ]
    votes = tagged[0]
    for part in tagged[1:]:
        votes = votes.unionByName(part)
    return _rounded(O.model_accuracy(votes), "accuracy")


# --- confusion matrix and what follows from it -----------------------------------------------


@query(f"{S.VOTED} SELECT label, ensemble_prediction, count(*) AS count FROM voted GROUP BY ALL ORDER BY ALL")
def confusion_matrix(spark, sf_dir):
    matrix = confusion.confusion_matrix(S.voted(spark, sf_dir), prediction="ensemble_prediction")
    return matrix.orderBy("label", "ensemble_prediction")


_CELLS = """count(*) FILTER (label <> 1 AND ensemble_prediction <> 1) AS true_negatives,
  count(*) FILTER (label <> 1 AND ensemble_prediction = 1) AS false_positives,
  count(*) FILTER (label = 1 AND ensemble_prediction <> 1) AS false_negatives,
  count(*) FILTER (label = 1 AND ensemble_prediction = 1) AS true_positives"""


@query(f"{S.VOTED} SELECT {_CELLS} FROM voted")
def confusion_cells(spark, sf_dir):
    return confusion.confusion_cells(S.voted(spark, sf_dir), prediction="ensemble_prediction")


@query(f"""{S.VOTED}, cells AS (SELECT {_CELLS} FROM voted)
SELECT round(CASE WHEN false_positives + true_negatives > 0
         THEN false_positives / (false_positives + true_negatives)::DOUBLE ELSE 0 END, 6) AS false_positive_rate,
       round(CASE WHEN false_negatives + true_positives > 0
         THEN false_negatives / (false_negatives + true_positives)::DOUBLE ELSE 0 END, 6) AS false_negative_rate
FROM cells""")
def error_rates(spark, sf_dir):
    rates = confusion.error_rates(confusion_cells(spark, sf_dir))
    return _rounded(rates, "false_positive_rate", "false_negative_rate").select(
        "false_positive_rate", "false_negative_rate"
    )


def _ensemble_metric(spark, sf_dir, name):
    metrics = ensemble.ensemble_metrics(S.voted(spark, sf_dir))
    return metrics.select(F.round(name, 6).alias(name))


_ENSEMBLE = f"{S.VOTED}, {S.sql_metrics('voted', 'label', 'ensemble_prediction')}"


@query(f"{_ENSEMBLE} SELECT round(accuracy, 6) AS accuracy FROM metrics")
def accuracy(spark, sf_dir):
    return _ensemble_metric(spark, sf_dir, "accuracy")


@query(f'{_ENSEMBLE} SELECT round("precision", 6) AS "precision" FROM metrics')
def weighted_precision(spark, sf_dir):
    return _ensemble_metric(spark, sf_dir, "precision")


@query(f"{_ENSEMBLE} SELECT round(recall, 6) AS recall FROM metrics")
def weighted_recall(spark, sf_dir):
    return _ensemble_metric(spark, sf_dir, "recall")


@query(f"{_ENSEMBLE} SELECT round(f1_score, 6) AS f1_score FROM metrics")
def weighted_f1(spark, sf_dir):
    return _ensemble_metric(spark, sf_dir, "f1_score")


@query(f"""{S.VOTED}, {S.sql_auc("voted", "ensemble_prediction", "label")}
SELECT round(auc_roc, 6) AS auc_roc FROM auc""")
def auc_hard_vote(spark, sf_dir):
    return _ensemble_metric(spark, sf_dir, "auc_roc")


@query(f"""{S.VOTED}, {S.sql_auc("voted", "vote_share", "label")} SELECT round(auc_roc, 6) AS auc_roc FROM auc""")
def auc_vote_share(spark, sf_dir):
    return _rounded(ensemble.vote_share_auc(S.voted(spark, sf_dir)), "auc_roc")


@query(f"""WITH lines AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         (l_linenumber % 3)::INTEGER AS prediction, l_linestatus AS model FROM lineitem),
{S.sql_metrics("lines", "label", "prediction", "model")}
SELECT model, n_rows, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM metrics""")
def metrics_three_classes(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = table(spark, sf_dir, "lineitem").select(
        label.alias("label"),
        (F.col("l_linenumber") % 3).alias("prediction"),
        F.col("l_linestatus").alias("model"),
    )
    return _rounded(confusion.classification_metrics(lines, by=["model"]), *METRICS)


# --- score order -----------------------------------------------------------------------------


@query(f"""WITH {S.SCORED_DOCUMENTS}, {S.sql_auc("scored_documents", "score", "label")}
SELECT round(auc_roc, 6) AS auc_roc FROM auc""")
def auc_scores(spark, sf_dir):
    return _rounded(ranking.auc_roc(S.scored_documents(spark, sf_dir)), "auc_roc")


@query(f"""WITH lines AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_extendedprice * (1 - l_discount) AS score FROM lineitem), {S.sql_auc("lines", "score", "label")}
SELECT round(auc_roc, 6) AS auc_roc FROM auc""")
def auc_many_scores(spark, sf_dir):
    return _rounded(ranking.auc_roc(S.scored_lines(spark, sf_dir)), "auc_roc")


_CUMULATIVE = f"""WITH {S.SCORED_DOCUMENTS}, by_score AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
  FROM scored_documents GROUP BY score),
cumulative AS (
  SELECT score, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp,
         sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp,
         sum(pos) OVER ()::DOUBLE AS n_pos, sum(neg) OVER ()::DOUBLE AS n_neg FROM by_score)"""


@query(f"""{_CUMULATIVE} SELECT round(score, 6) AS score, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr
FROM cumulative UNION ALL SELECT NULL, 0.0, 0.0""")
def roc_curve(spark, sf_dir):
    curve = ranking.roc_curve(ranking.ranked(S.scored_documents(spark, sf_dir)))
    return _rounded(curve, "score", "fpr", "tpr")


@query(f"""{_CUMULATIVE} SELECT round(score, 6) AS score, round(tp / n_pos, 6) AS recall,
       round(tp / (tp + fp), 6) AS "precision" FROM cumulative""")
def precision_recall_curve(spark, sf_dir):
    curve = ranking.precision_recall_curve(ranking.ranked(S.scored_documents(spark, sf_dir)))
    return _rounded(curve, "score", "recall", "precision")


@query(f"""{S.PREDICTIONS} SELECT vec_id, label, prediction, round(abs(score), 6) AS confidence
FROM predictions WHERE label <> prediction ORDER BY abs(score) DESC, vec_id LIMIT 20""")
def misclassified(spark, sf_dir):
    """The twenty most confident mistakes."""
    scored = S.predictions(spark, sf_dir).withColumn("confidence", F.abs("score"))
    worst = ranking.misclassified(scored, "vec_id", 20)
    return _rounded(worst.select("vec_id", "label", "prediction", "confidence"), "confidence")


# --- summaries -------------------------------------------------------------------------------

_PER_MODEL = f"""{S.MODEL_PREDICTIONS}, {S.sql_metrics("model_predictions", "label", "prediction", "model")},
{S.sql_auc("model_predictions", "score", "label", "model")}"""


@query(f"""{_PER_MODEL} SELECT model, n_rows, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(auc_roc, 6) AS auc_roc
FROM metrics JOIN auc USING (model)""")
def model_metrics(spark, sf_dir):
    path = shared_folder(spark)
    write_table(S.model_predictions(spark, sf_dir).drop("vec_id"), path)
    metrics = summary.model_metrics(spark.read.parquet(path))
    return _rounded(metrics, *METRICS, "auc_roc")


@query(f"""{_ENSEMBLE} SELECT metric, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, accuracy AS value FROM metrics
  UNION ALL SELECT 'precision', "precision" FROM metrics UNION ALL SELECT 'recall', recall FROM metrics
  UNION ALL SELECT 'f1_score', f1_score FROM metrics UNION ALL SELECT 'auc_roc', hard_auc FROM metrics
  UNION ALL SELECT 'n_rows', n_rows::DOUBLE FROM metrics UNION ALL SELECT 'training_batches', 5.0)""")
def ensemble_report(spark, sf_dir):
    """The flagship: five voters, their majority, every metric as one row."""
    report = ensemble.ensemble_report(S.voted(spark, sf_dir), facts={"training_batches": 5})
    return _rounded(report, "value")


@query(f"""{_ENSEMBLE}, members AS (""" + " UNION ALL ".join(
    f"SELECT avg((pred_{m} = label)::INT) AS accuracy FROM votes" for m in S.MODELS) + """)
SELECT round((SELECT avg(accuracy) FROM members), 6) AS mean_accuracy, round(accuracy, 6) AS ensemble_accuracy,
       round(accuracy - (SELECT avg(accuracy) FROM members), 6) AS gain FROM metrics""")
def ensemble_gain(spark, sf_dir):
    voted = S.voted(spark, sf_dir)
    reached = ensemble.ensemble_metrics(voted).select("accuracy").scalar()
    gain = summary.ensemble_gain(ensemble.member_accuracy(voted, S.MODELS), reached)
    return _rounded(gain, "mean_accuracy", "ensemble_accuracy", "gain")


@query(f"""{S.MODEL_PREDICTIONS}, acc AS (
  SELECT model, avg((label = prediction)::INT) AS accuracy FROM model_predictions GROUP BY model)
SELECT model AS best_model, round(accuracy, 6) AS best_accuracy FROM acc ORDER BY accuracy DESC, model DESC LIMIT 1""")
def best_model(spark, sf_dir):
    """Equal accuracies go to the later model."""
    metrics = confusion.classification_metrics(S.model_predictions(spark, sf_dir), by=["model"])
    order = [f"model_{m}" for m in reversed(S.MODELS)]
    return _rounded(summary.best_model(metrics, order), "best_accuracy")


@query(f"""{S.MODEL_PREDICTIONS}, acc AS (
  SELECT model, avg((label = prediction)::INT) AS accuracy FROM model_predictions GROUP BY model)
SELECT model, accuracy >= 0.5 AS target_met, round(greatest(0.5 - accuracy, 0), 6) AS target_gap,
       round(accuracy - 0.48, 6) AS baseline_gain,
       CASE WHEN accuracy > 0.51 THEN 'very effective' WHEN accuracy > 0.49 THEN 'good' ELSE 'not enough' END AS verdict
FROM acc""")
def judge(spark, sf_dir):
    """Targets set where these weak models differ."""
    metrics = confusion.classification_metrics(S.model_predictions(spark, sf_dir), by=["model"])
    judged = summary.judge(metrics, target=0.5, baseline=0.48, high=0.51, medium=0.49)
    return _rounded(judged, "target_gap", "baseline_gain").select(
        "model", "target_met", "target_gap", "baseline_gain", "verdict"
    )


_TWO = f"""WITH {S.FEATURE_ROWS}, {S.sql_votes(S.MODELS, "votes_a")}, {S.sql_voted(S.MODELS, "votes_a", "voted_a")},
{S.sql_votes(S.MORE_MODELS, "votes_b")}, {S.sql_voted(S.MORE_MODELS, "votes_b", "voted_b")},
both_voted AS (SELECT 'first' AS model, label, ensemble_prediction FROM voted_a
  UNION ALL SELECT 'second', label, ensemble_prediction FROM voted_b),
{S.sql_metrics("both_voted", "label", "ensemble_prediction", "model")}"""


def _two_ensembles(spark, sf_dir):
    pair = {"first": S.voted(spark, sf_dir), "second": S.voted(spark, sf_dir, S.MORE_MODELS)}
    return ensemble.compare_ensembles(pair, tie_order=["second", "first"])


@query(f"""{_TWO} SELECT model, n_rows, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(hard_auc, 6) AS auc_roc FROM metrics""")
def compare_ensembles(spark, sf_dir):
    return _rounded(_two_ensembles(spark, sf_dir)[0], *METRICS, "auc_roc")


@query(f"""{_TWO} SELECT model AS best_model, round(accuracy, 6) AS best_accuracy FROM metrics
ORDER BY accuracy DESC, model DESC LIMIT 1""")
def better_ensemble(spark, sf_dir):
    return _rounded(_two_ensembles(spark, sf_dir)[1], "best_accuracy")
