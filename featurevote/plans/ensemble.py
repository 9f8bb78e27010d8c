"""Per-batch models voting on test rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurevote.operators.confusion import hard_vote_metrics
from featurevote.operators.ranking import auc_roc
from featurevote.operators.summary import METRIC_COLUMNS, best_model, long_metrics
from featurevote.operators.votes import majority_vote, vote_name
from featurevote.plans.score import score_all


def ensemble_votes(models: Mapping[int, object], test_rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., pred_k..., ensemble_prediction, vote_share) for every test row."""
    return majority_vote(score_all(models, test_rows, keep), list(models))


def member_accuracy(voted: DataFrame, model_ids: Sequence[int | str], label: str = "label") -> DataFrame:
    """(model_id, accuracy) of each voter of a wide vote table, in one aggregation."""
    hits = [
        F.avg((F.col(vote_name(m)) == F.col(label)).cast("double")).alias(str(m)) for m in model_ids
    ]
    return voted.agg(*hits).unpivot([], [str(m) for m in model_ids], "model_id", "accuracy")


def ensemble_metrics(voted: DataFrame, label: str = "label") -> DataFrame:
    """One row: n_rows, accuracy, precision, recall, f1_score and auc_roc of the hard vote."""
    return hard_vote_metrics(voted, label, "ensemble_prediction")


def vote_share_auc(voted: DataFrame, label: str = "label") -> DataFrame:
    """One row: AUC of the share of positive votes."""
    return auc_roc(voted, "vote_share", label)


def ensemble_report(
    voted: DataFrame, label: str = "label", facts: Mapping[str, float] | None = None
) -> DataFrame:
    """(metric, value): the ensemble's metrics, its row count and given run facts."""
    return long_metrics(ensemble_metrics(voted, label), [*METRIC_COLUMNS, "n_rows"], facts=facts)


def compare_ensembles(
    ensembles: Mapping[str, DataFrame], tie_order: Sequence[str], label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """(one metric row per ensemble, the winner), from any number of voted tables."""
    tables = [
        ensemble_metrics(voted, label).withColumn("model", F.lit(name))
        for name, voted in ensembles.items()
    ]
    metrics = tables[0]
    for table in tables[1:]:
        metrics = metrics.unionByName(table)
    return metrics, best_model(metrics, tie_order)
