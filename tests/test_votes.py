"""Alignment and majority votes: ties, abstentions, independence from layout."""

import pytest
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from featurevote.operators import votes as O
from featurevote.plans import ensemble


def vote_table(spark, rows):
    return spark.createDataFrame(rows, "path string, label int, prediction double")


def five_tables(spark, n=200):
    tables = []
    for m in range(1, 6):
        rows = [(f"p{i}", i % 2, float((i * m + i // 3) % 2)) for i in range(n) if not (m == 3 and i % 7 == 0)]
        tables.append((m, rows))
    return tables


def test_alignment_equals_folded_joins(spark):
    tables = [(m, vote_table(spark, rows)) for m, rows in five_tables(spark)]
    wide = O.align_votes(tables, ["path", "label"])
    folded = None
    for m, df in tables:
        named = df.select("path", "label", F.col("prediction").alias(f"pred_{m}"))
        folded = named if folded is None else O.join_votes(folded, named, ["path", "label"])
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, folded.select(wide.columns).collect()))
    assert wide.count() == sum(1 for i in range(200) if i % 7)


def test_alignment_needs_one_shuffle(spark):
    tables = [(m, vote_table(spark, rows)) for m, rows in five_tables(spark)]
    wide = O.majority_vote(O.align_votes(tables, ["path", "label"]), range(1, 6))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_vote_does_not_depend_on_row_order_or_partitions(spark):
    def run(parts):
        tables = [
            (m, vote_table(spark, list(reversed(rows)) if parts % 2 else rows).repartition(parts))
            for m, rows in five_tables(spark)
        ]
        voted = O.majority_vote(O.align_votes(tables, ["path", "label"]), range(1, 6))
        return {r["path"]: r["ensemble_prediction"] for r in voted.collect()}

    assert run(1) == run(4) == run(7)


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A key that fills a third of a vote table still gives one row."""
    tables = []
    for m in range(1, 4):
        rows = spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("path"),
            F.lit(1).alias("label"),
            F.lit(float(m % 2)).alias("prediction"),
        )
        tables.append((m, rows))
    wide = O.align_votes(tables, ["path", "label"])
    assert wide.count() == 2001
    assert wide.where("path = 'hot'").select("pred_1", "pred_2", "pred_3").first() == (1.0, 0.0, 1.0)
    assert "partial_max" in wide._jdf.queryExecution().executedPlan().toString()


def test_even_split_counts_as_one(spark):
    names = [f"pred_{m}" for m in range(1, 11)]
    df = spark.createDataFrame(
        [[1.0] * 5 + [0.0] * 5, [1.0] * 4 + [0.0] * 6, [1.0] * 10], names
    )
    got = [r["ensemble_prediction"] for r in O.majority_vote(df, range(1, 11)).collect()]
    assert got == [1.0, 0.0, 1.0]


def test_fanout_estimate_equals_the_join_it_avoids(spark):
    a = spark.createDataFrame([(0,)] * 3 + [(1,)] * 5 + [(2,)], "label int")
    b = spark.createDataFrame([(0,)] * 4 + [(1,)] * 2, "label int")
    c = spark.createDataFrame([(0,)] * 2 + [(1,)] * 6, "label int")
    joined = a.join(b, "label").join(c, "label")
    want = dict(Counter(r["label"] for r in joined.collect()))
    got = {r["label"]: int(r["joined_rows"]) for r in O.label_join_fanout([a, b, c]).collect()}
    assert got == want


def test_member_accuracy_forms_agree(spark):
    rows = [(i, i % 2, *[float((i * m + 1) % 3 == 0) for m in range(1, 4)]) for i in range(60)]
    wide = spark.createDataFrame(rows, "path int, label int, pred_1 double, pred_2 double, pred_3 double")
    from_wide = {r["model_id"]: r["accuracy"] for r in ensemble.member_accuracy(wide, [1, 2, 3]).collect()}
    long = O.long_votes(wide, ["path", "label"], [1, 2, 3])
    assert long.count() == 180
    from_long = {r["model_id"]: r["accuracy"] for r in O.model_accuracy(long).collect()}
    assert from_wide == from_long
    want = defaultdict(float)
    for r in rows:
        for m in range(1, 4):
            want[str(m)] += (r[1 + m] == r[1]) / len(rows)
    assert all(abs(want[k] - v) < 1e-12 for k, v in from_long.items())


def test_alignment_drops_missing_keys_and_refuses_differing_votes(spark):
    a = spark.createDataFrame([("x", 1, 1.0), (None, 1, 0.0), ("z", 0, 1.0)], "path string, label int, prediction double")
    b = spark.createDataFrame([("x", 1, None), (None, 1, 1.0)], "path string, label int, prediction double")
    rows = O.align_votes([(1, a), (2, b)], ["path", "label"]).collect()
    assert [tuple(r) for r in rows] == [("x", 1, 1.0, None)]
    assert O.align_votes([(1, a.union(a)), (2, b)], ["path", "label"]).count() == 1
    other = a.selectExpr("path", "label", "1 - prediction AS prediction")
    with pytest.raises(Exception, match="differing votes"):
        O.align_votes([(1, a.union(other)), (2, b)], ["path", "label"]).collect()
