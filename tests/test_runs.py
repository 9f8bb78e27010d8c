"""Whole runs on hand-made images and on the stored test vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import stand_ins as S
from featurevote.__main__ import main, parser
from featurevote.operators import sinks
from featurevote.plans import runs
from tests.png import write_png


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(3)
    for split, n in (("train", 12), ("test", 4)):
        for i in range(n):
            write_png(root / split / "REAL" / f"{i}.png", rng.integers(0, 120, (6, 5, 3)))
            write_png(root / split / "FAKE" / f"{i}.png", rng.integers(120, 256, (4, 7, 3)))
    (root / "train" / "REAL" / "broken +1.png").write_bytes(b"no image")
    write_png(root / "elsewhere" / "REAL" / "x.png", np.zeros((2, 2, 3)))
    return str(root)


def test_from_files_to_predictions(spark, raw, capsys):
    features, output = sinks.shared_folder(spark), sinks.shared_folder(spark)
    main(["extract", "--input", raw, "--output", features, "--glob", "*.png", "--batches", "2"], spark)
    stored = spark.read.parquet(features)
    sizes = {(r["split"], r["label"]): r["count"] for r in stored.groupBy("split", "label").count().collect()}
    assert stored.where("not is_valid").count() == 1
    assert sizes == {("train", 1): 13, ("train", 0): 12, ("test", 1): 4, ("test", 0): 4}
    assert stored.where("split = 'test'").select("batch").distinct().collect()[0][0] == 1
    report = runs.extract(spark, raw, sinks.shared_folder(spark), n_batches=3, name_glob="*.png")
    told = report.collect()
    assert sum(r["n_input"] for r in told if r["ok"]) == 33
    left_out = [(r["split"], r["label"], r["batch"], r["n_input"], r["n_saved"]) for r in told if not r["ok"]]
    assert left_out == [(None, 1, None, 1, 0)]
    main(["train", "--features", features, "--output", output, "--preset", "small"], spark)
    metrics = {r["model"]: r for r in spark.read.parquet(f"{output}/metrics").collect()}
    assert sorted(metrics) == ["lr", "rf"] and metrics["lr"]["training_samples"] == 24
    assert metrics["lr"]["accuracy"] == 1.0
    counted = {(r["split"], r["label"]): (r["n_rows"], r["n_invalid"]) for r in spark.read.parquet(f"{output}/rows").collect()}
    assert counted == {("train", 1): (13, 1), ("train", 0): (12, 0), ("test", 1): (4, 0), ("test", 0): (4, 0)}
    found = sinks.shared_folder(spark)
    main(
        ["predict", "--input", raw, "--output", found, "--model", f"{output}/models/lr", "--kind", "lr",
         "--glob", "*.png"],
        spark,
    )
    predicted = spark.read.parquet(found)
    assert predicted.count() == 34 and predicted.where("not is_valid").count() == 1
    wrong = predicted.where("is_valid and (label = 'REAL') <> (prediction = 1)")
    assert wrong.where(~F.col("path").contains("elsewhere")).count() == 0
    capsys.readouterr()


def test_ensemble_run_writes_what_it_reports(spark, sf_dir):
    features, output = sinks.shared_folder(spark), sinks.shared_folder(spark)
    sinks.write_table(S.laid_out(spark, sf_dir), features, sinks.FEATURE_LAYOUT)
    result = runs.train_ensemble(
        spark, features, output, "lr", "small", key="vec_id", parallelism=3, target=0.5
    )
    n_test = spark.read.parquet(features).where("split = 'test'").count()
    votes = spark.read.parquet(f"{output}/votes")
    final = spark.read.parquet(f"{output}/final")
    assert votes.count() == final.count() == n_test
    assert votes.columns[:2] == ["vec_id", "label"] and final.columns == ["label", "ensemble_prediction"]
    metrics = {r["metric"]: r["value"] for r in result["metrics"].collect()}
    hits = final.where("label = ensemble_prediction").count()
    assert metrics["accuracy"] == pytest.approx(hits / n_test) and metrics["training_batches"] == 5
    members = [r["accuracy"] for r in result["members"].collect()]
    gain = result["gain"].first()
    assert gain["mean_accuracy"] == pytest.approx(sum(members) / 5)
    assert gain["gain"] == pytest.approx(metrics["accuracy"] - sum(members) / 5)
    assert result["verdict"].first()["target_met"] == (metrics["accuracy"] >= 0.5)


def test_test_rows_of_one_class_have_no_auc(spark, sf_dir):
    features, output = sinks.shared_folder(spark), sinks.shared_folder(spark)
    rows = S.laid_out(spark, sf_dir).where("split = 'train' or label = 1")
    sinks.write_table(rows, features, sinks.FEATURE_LAYOUT)
    runs.train_on_all(spark, features, output, "small", key="vec_id")
    found = {r["model"]: r for r in spark.read.parquet(f"{output}/metrics").collect()}
    assert sorted(found) == ["lr", "rf"]
    assert all(r["auc_roc"] is None and 0 <= r["accuracy"] <= 1 for r in found.values())


def test_split_and_class_are_read_below_the_root(spark, tmp_path):
    root = tmp_path / "train" / "REAL" / "raw"
    for place in ("test/FAKE", "train/REAL", "FAKE"):
        write_png(root / place / "x.png", np.zeros((2, 2, 3)))
    found = sinks.shared_folder(spark)
    stats = sinks.ingest_files(spark, str(root), found, "*.png")
    rows = sorted((r["split"], r["label"]) for r in spark.read.parquet(found).select("split", "label").collect())
    assert stats["total_files"] == 3 and rows == [("test", "FAKE"), ("train", "FAKE"), ("train", "REAL")]


def test_forest_only_preset(spark, sf_dir):
    assert runs._kinds("mixed_batches_forest") == ["rf"] and runs._kinds("basic") == ["lr", "rf"]


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["train", "--features", "x"])
    assert parser().parse_args(["ingest", "--input", "a", "--output", "b", "--max-files", "3"]).max_files == 3
