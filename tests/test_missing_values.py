"""Missing, empty and infinite values in scores and partition columns."""

import math

from featurevote.operators import ranking, sinks


def test_infinite_and_missing_scores_are_ranked(spark):
    scores = [(math.inf, 1), (-math.inf, 0), (None, 1), (0.5, 1), (0.5, 0), (math.inf, 0)]
    df = spark.createDataFrame(scores, "score double, label int")
    value = [(-math.inf if s is None else s, y) for s, y in scores]
    pairs = [(a > b) + (a == b) / 2 for a, x in value if x for b, y in value if not y]
    assert abs(ranking.auc_roc(df).first()[0] - sum(pairs) / len(pairs)) < 1e-12
    only_missing = spark.createDataFrame([(None, 1), (None, 0)], "score double, label int")
    assert ranking.auc_roc(only_missing).first()[0] == 0.5


def test_missing_and_empty_partition_values_are_compared(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("", 4)], "g string, v int")
    report = sinks.write_batches_verified(df, str(tmp_path / "t"), ["g"]).collect()
    assert sorted((r.g or "", r.n_input, r.n_saved, r.ok) for r in report) == [("", 3, 3, True), ("a", 1, 1, True)]
    source = df.selectExpr("g", "CAST(v AS BIGINT) AS length")
    same = sinks.verify_ingest(source, source, ["g"]).collect()
    assert all(r.complete for r in same) and len(same) == 2
    lost = sinks.verify_ingest(source, source.where("length <> 3"), ["g"]).collect()
    assert {r.g: r.complete for r in lost} == {"a": True, None: False}
