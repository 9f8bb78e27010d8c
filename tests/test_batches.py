"""Stable batches, verified writes, partition pruning, and label polarity."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalog import stand_ins as S
from featurevote import values
from featurevote.functions import labels as L
from featurevote.functions import vectors as V
from featurevote.operators import batches, sinks
from featurevote.operators import votes as votes_ops
from featurevote.sources import tables


def test_batches_partition_the_keys_and_ignore_layout(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    one = {r[0]: r[1] for r in batches.with_batch(orders, "o_orderkey").collect()}
    two = {r[0]: r[1] for r in batches.with_batch(orders.repartition(7), "o_orderkey").collect()}
    assert one == two and set(one.values()) == {1, 2, 3, 4, 5}
    sizes = [r["n_rows"] for r in batches.batch_sizes(batches.with_batch(orders, "o_orderkey")).collect()]
    assert sum(sizes) == len(one) and max(sizes) < 1.3 * min(sizes)


def test_random_batches_are_disjoint_and_whole(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    parts = [{r[0] for r in p.collect()} for p in batches.random_batches(orders)]
    assert len(parts) == 5 and sum(map(len, parts)) == len(set().union(*parts)) == orders.count()


def test_label_map_is_explicit(spark):
    df = spark.createDataFrame([("REAL",), ("FAKE",), ("",)], "name string")
    kept = df.select(L.label_to_int(F.col("name")).alias("v")).collect()
    swapped = df.select(L.label_to_int(F.col("name"), values.LABEL_TO_INT_SWAPPED).alias("v")).collect()
    assert [r["v"] for r in kept] == [1, 0, None] and [r["v"] for r in swapped] == [0, 1, None]
    back = spark.createDataFrame([(1,), (0,)], "v int").select(L.int_to_label(F.col("v")).alias("n"))
    assert [r["n"] for r in back.collect()] == ["REAL", "FAKE"]


def test_paths(spark):
    df = spark.createDataFrame([("a://h/train/REAL/x.jpg",), ("a://h/none/x.jpg",), ("x",)], "path string")
    rows = df.select(
        L.label_from_path(F.col("path")).alias("label"),
        L.path_segment(F.col("path"), 2).alias("parent"),
        L.tag_if_contains(F.col("path"), "REAL", "REAL", "FAKE").alias("tag"),
    ).collect()
    assert [r["label"] for r in rows] == ["REAL", "", ""]
    assert [r["parent"] for r in rows] == ["REAL", "none", None]
    assert [r["tag"] for r in rows] == ["REAL", "FAKE", "FAKE"]


def test_row_identity_ignores_layout(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", L.row_identity(F.col("url")).alias("id"))
    first = dict(map(tuple, pages.collect()))
    assert first == dict(map(tuple, pages.repartition(9).collect())) and len(set(first.values())) == len(first)


def test_padding_and_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0] * 6,), (None,)], "x array<float>")
    rows = df.select(
        V.pad_to_width(F.col("x"), 4).alias("padded"), V.or_zero_vector(F.col("x"), 4).alias("filled")
    ).collect()
    assert rows[0]["padded"] == [1.0, 2.0, 0.0, 0.0] and rows[1]["padded"] == [1.0] * 4
    assert rows[2]["padded"] is None and rows[2]["filled"] == [0.0] * 4


def test_whole_numbers_survive_in_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    assert df.select(V.as_doubles(F.col("x")).alias("x")).first()["x"] == [1.0, 2.0, 3.0]


def test_verified_write_and_pruned_read(spark, sf_dir):
    path = sinks.shared_folder(spark)
    laid_out = S.laid_out(spark, sf_dir)
    report = sinks.write_verified(laid_out, path).collect()
    assert all(r["ok"] for r in report) and sum(r["n_saved"] for r in report) == laid_out.count()
    part = tables.read_batches(spark, path, split="train", labels=[1], max_batch=2)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    wanted = laid_out.where("split = 'train' and label = 1 and batch <= 2")
    assert part.count() == wanted.count()


def test_verified_write_of_nothing(spark, sf_dir):
    empty = S.laid_out(spark, sf_dir).where("vec_id < 0")
    assert sinks.write_verified(empty, sinks.shared_folder(spark)).count() == 0
    report = sinks.write_batches_verified(empty, sinks.shared_folder(spark))
    assert report.count() == 0


def test_lost_rows_are_reported(spark, sf_dir):
    source = S.laid_out(spark, sf_dir)
    target = source.where("not (batch = 2 and split = 'train')")
    report = sinks.verify_ingest(
        source.withColumn("length", F.lit(1)), target.withColumn("length", F.lit(1)), ("split", "batch")
    )
    lost = [(r["split"], r["batch"]) for r in report.collect() if not r["complete"]]
    assert lost == [("train", 2)]


def test_missing_directories_are_skipped(spark, sf_dir):
    path = sinks.shared_folder(spark)
    sinks.write_table(S.laid_out(spark, sf_dir), path, ("batch",))
    found = tables.read_existing_tables(spark, [f"{path}/batch=1", f"{path}/batch=77"])
    assert found.count() == S.laid_out(spark, sf_dir).where("batch = 1").count()
    assert tables.read_existing_tables(spark, [f"{path}/batch=77"]) is None


def test_parent_of_unnamed_directories_cannot_be_read(spark, sf_dir):
    path = sinks.shared_folder(spark)
    sinks.write_table(S.laid_out(spark, sf_dir), f"{path}/REAL/batch_1")
    with pytest.raises(AnalysisException, match="UNABLE_TO_INFER_SCHEMA"):
        spark.read.parquet(path)


def test_vector_and_array_tables_do_not_mix(spark, sf_dir):
    rows = S.feature_rows(spark, sf_dir).select(V.as_doubles(F.col("embedding")).alias("features"))
    vectors = rows.select(V.array_to_vector("features").alias("features"))
    with pytest.raises(AnalysisException, match="INCOMPATIBLE_COLUMN_TYPE"):
        batches.union_all([rows, vectors]).count()


def test_spread_layout_writes_every_row(spark, sf_dir):
    laid_out = S.laid_out(spark, sf_dir)
    spread = sinks.spread_for_layout(laid_out, ["split", "label"], "vec_id", 3)
    path = sinks.shared_folder(spark)
    sinks.write_table(spread, path, ("split", "label"))
    files = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).collect()}
    assert spark.read.parquet(path).count() == laid_out.count() and len(files) <= 12


def test_classes_per_batch(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1)], "batch int, label int")
    rows = {r["batch"]: (r["n_classes"], r["n_rows"], r["trainable"]) for r in batches.classes_per_batch(df).collect()}
    assert rows == {1: (2, 2, True), 2: (1, 2, False)}


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_quotas_differ_by_one_row_at_most(spark, ranges):
    draw = random.Random(ranges)
    rows = [(i, draw.choice(["hot", "hot", "hot", "cold", None]), "x") for i in range(2000)] + [(5000, "lone", "x")]
    df = spark.createDataFrame(rows, "key int, label string, other string").repartition(5)
    got = batches.quota_batches(df, "key", 7, by=["label"], ranges=ranges)
    assert got.columns == ["key", "label", "other", "batch"] and got.count() == len(rows)
    sizes = {}
    for r in got.groupBy("label", "batch").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(max(s) - min(s) <= 1 and len(s) == 7 for label, s in sizes.items() if label != "lone") and sizes["lone"] == [1]
    again = batches.quota_batches(df.orderBy("other", "key"), "key", 7, by=["label"], ranges=5)
    assert sorted(got.collect(), key=str) == sorted(again.collect(), key=str)
    whole = [r["count"] for r in batches.quota_batches(df, "key", 4).groupBy("batch").count().collect()]
    assert sorted(whole) == [500, 500, 500, 501]


def stored_batches(spark, path):
    rows = [(i, float(i), "train" if i % 3 else "test", i % 2, i % 4) for i in range(400)] + [(999, 1.0, None, 0, 0)]
    df = spark.createDataFrame(rows, "id int, value double, split string, label int, batch int")
    sinks.write_with_manifest(df, f"{path}/table", f"{path}/manifest")
    return df


def wrong(spark, path):
    found = sinks.check_batches(spark, f"{path}/table", f"{path}/manifest").where("not ok")
    return sorted((r["split"], r["label"], r["batch"]) for r in found.collect())


def test_changed_short_and_missing_batches_are_found_and_alone_rewritten(spark, tmp_path):
    df, table = stored_batches(spark, tmp_path), tmp_path / "table"
    assert wrong(spark, tmp_path) == []
    layout = list(sinks.FEATURE_LAYOUT)

    def put(rows):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(str(table))

    put(df.where("split = 'train' and label = 0 and batch = 2").withColumn("value", F.col("value") + (F.col("id") == 2).cast("int")))
    put(df.where("split = 'test' and label = 1 and batch = 3 and id > 20"))
    twice = df.where("split = 'train' and label = 1 and batch = 1")
    put(twice.union(twice.limit(1)))
    lost = table / "split=test" / "label=0" / "batch=0"
    for part in lost.iterdir():
        part.unlink()
    damaged = [("test", 0, 0), ("test", 1, 3), ("train", 0, 2), ("train", 1, 1)]
    assert wrong(spark, tmp_path) == damaged

    def places():
        return {p.relative_to(table): p.stat().st_mtime_ns for p in table.rglob("*.parquet")}

    before = places()
    told = sinks.rewrite_batches(df, str(table), f"{tmp_path}/manifest").collect()
    assert all(r["ok"] for r in told) and len(told) == 9
    touched = {str(p.parent) for p, time in places().items() if before.get(p) != time}
    assert touched == {f"split={s}/label={la}/batch={b}" for s, la, b in damaged}
    read = spark.read.schema(df.schema).parquet(str(table))
    assert sorted(map(str, read.select(df.columns).collect())) == sorted(map(str, df.collect()))
    more = df.limit(1).withColumn("batch", F.lit(77))
    more.write.mode("append").partitionBy(*layout).parquet(str(table))
    assert [b for _, _, b in wrong(spark, tmp_path)] == [77]


def test_bucketed_votes_meet_without_an_exchange(spark, tmp_path):
    draw = random.Random(8)
    votes = []
    for model in (1, 2, 3):
        rows = [(k, k % 2, draw.choice([0.0, 1.0, None])) for k in range(500) if draw.random() < 0.8]
        rows += [(None, 0, 1.0)] + rows[:5]
        votes.append((model, spark.createDataFrame(rows, "key int, label int, prediction double")))
    tables = []
    for model, df in votes:
        votes_ops.save_bucketed_votes(df, f"bucketed_{model}", ["key", "label"], 4, path=f"{tmp_path}/{model}")
        tables.append((model, f"bucketed_{model}"))
    aligned = votes_ops.align_bucketed_votes(spark, tables, ["key", "label"])
    want = votes_ops.align_votes(votes, ["key", "label"])
    assert sorted(map(str, aligned.collect())) == sorted(map(str, want.collect())) and aligned.count() > 100
    assert "Exchange" not in aligned._jdf.queryExecution().executedPlan().toString()
    clash = spark.createDataFrame([(1, 1, 0.0), (1, 1, 1.0)], "key int, label int, prediction double")
    votes_ops.save_bucketed_votes(clash, "bucketed_clash", ["key", "label"], 4, path=f"{tmp_path}/clash")
    with pytest.raises(Exception, match="differing votes"):
        votes_ops.align_bucketed_votes(spark, [(1, "bucketed_clash")], ["key", "label"]).collect()


def test_buckets_grow_with_the_largest_vote_table(spark):
    votes = [spark.range(n).selectExpr("id AS key", "1.0D AS prediction") for n in (10, 1001, 0)]
    assert votes_ops.bucket_count(votes, rows=100) == 11
    assert votes_ops.bucket_count(votes, 8) == 8
    assert votes_ops.bucket_count(votes[2:]) == 1
