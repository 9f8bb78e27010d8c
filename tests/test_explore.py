"""Quantiles at sizes beyond a sketch's accuracy, and scans that need no content."""

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from featurevote.operators import explore, quantiles


def test_quantiles_are_exact_beyond_ten_thousand_values(spark):
    n, shares = 150_001, (0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0)
    hot = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1e-3)
    spread = F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")
    df = spark.range(n).select(F.array(spread, hot, F.exp(F.col("id") * 1e-3), F.lit(None).cast("double")).alias("features"))
    found = {r["position"]: r["quantiles"] for r in explore.feature_quantiles(df, shares).collect()}
    ids = np.arange(n)
    columns = [ids * 1.0, np.where(ids % 3 == 0, 7.0, ids * 1e-3)]
    for position, values in enumerate(columns):
        ordered = np.sort(values)
        assert found[position] == [ordered[max(1, int(np.ceil(q * n))) - 1] for q in shares]
    assert np.allclose(found[2], [np.exp((max(1, int(np.ceil(q * n))) - 1) * 1e-3) for q in shares], rtol=1e-9)
    assert found[3] is None


def disc(values, share):
    ordered = sorted(values, key=lambda v: (v != v, v))
    return ordered[max(1, math.ceil(share * len(ordered))) - 1]


def test_quantiles_of_odd_columns(spark):
    draw, nan, inf = random.Random(1), float("nan"), float("inf")
    n = 6_000
    columns = [
        [draw.choice([1.0, 2.0]) for _ in range(n)],  # two values only
        [5.0] * n,
        [draw.choice([nan, -inf, inf, 0.0, -1.5]) for _ in range(n)],
        [nan] * n,
        [draw.gauss(0, 1) if i % 2 else 0.25 for i in range(n)],
        [float(i // 2000) for i in range(n)],
        [draw.choice([None, draw.random()]) for i in range(n)],
    ]
    made = [([c[i] for c in columns] + ([] if i % 5 else [float(i)]),) for i in range(n)]
    df = spark.createDataFrame(made, "features array<double>").repartition(6)
    shares = (0.0, 1 / 3, 0.5, 0.9, 1.0)
    found = {r["position"]: r["quantiles"] for r in explore.feature_quantiles(df, shares).collect()}
    columns.append([float(i) for i in range(0, n, 5)])
    for position, values in enumerate(columns):
        want = [disc([v for v in values if v is not None], q) for q in shares]
        assert str(found[position]) == str(want), position
    assert explore.feature_quantiles(df.limit(0)).collect() == []


def test_a_pass_shuffles_sketches_only(spark, tmp_path):
    spark.range(100).select(F.array(F.col("id").cast("double")).alias("x")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    sent = []
    collect = type(rows).collect
    try:
        type(rows).collect = lambda df: sent.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df)
        quantiles._pass(rows, 1, [[(-math.inf, math.inf)]], (0.5,))
    finally:
        type(rows).collect = collect
    (plan,) = sent
    assert plan.count("Exchange hashpartitioning(block") == plan.count("Exchange") == 1
    assert "partial_kll_sketch_agg_double" in plan


def test_scanning_files_reads_no_content(spark, sf_dir):
    df = entry_point.queries()["scan_files"](spark, sf_dir)
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["name"]: r["length"] for r in df.collect()} == {f: os.path.getsize(f"{sf_dir}/{f}") for f in os.listdir(sf_dir)}
