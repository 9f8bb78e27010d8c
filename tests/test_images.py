"""File scans, preparation, features, ingest and inference on hand-made images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurevote.functions.labels import label_to_int
from featurevote.operators import explore, features, prepare, sinks
from featurevote.plans import infer, train
from featurevote.sources import files
from tests.png import write_png

KNOWN = np.array(
    [[[10, 20, 30], [10, 20, 31], [0, 0, 0], [255, 255, 255]],
     [[10, 20, 30], [40, 50, 60], [1, 2, 3], [4, 5, 6]]],
    dtype=np.uint8,
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    write_png(root / "train" / "REAL" / "known.png", KNOWN)
    write_png(root / "train" / "FAKE" / "flat.png", np.full((3, 3, 3), 200))
    write_png(root / "train" / "FAKE" / "grey.png", np.full((5, 4), 77))
    write_png(root / "test" / "REAL" / "dark.png", np.full((2, 2, 3), 3))
    write_png(root / "other" / "loose.png", np.full((2, 6, 3), 9))
    (root / "train" / "FAKE" / "broken.png").write_bytes(b"not an image")
    (root / "train" / "FAKE" / "notes.txt").write_bytes(b"ignore me")
    return str(root)


def by_name(df, *columns):
    rows = df.select(F.element_at(F.split("path", "/"), -1).alias("name"), *columns).collect()
    return {r["name"]: r for r in rows}


def test_scan_counts_without_opening_files(spark, folder):
    df = files.read_files(spark, folder, "*.png", recursive=True)
    assert df.count() == 6
    assert files.read_files(spark, folder, recursive=True).count() == 7
    plan = df.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert sinks.count_files(spark, folder + "/nowhere") == 0


def test_both_scans_spell_paths_alike(spark, tmp_path):
    for name in ("a b.png", "c+d.png", "e%20f.png", "g[1].png", "ü.png"):
        write_png(tmp_path / "x y" / name, np.zeros((1, 1, 3)))
    raw = {r["path"] for r in files.read_files(spark, str(tmp_path), recursive=True).collect()}
    assert raw == {r["path"] for r in files.read_images(spark, str(tmp_path)).collect()} and len(raw) == 5


def test_first_files_open_no_others(spark, tmp_path):
    for name in ("a[1].bin", "b*.bin", "c.bin", "d {x}.bin"):
        (tmp_path / name).write_bytes(name.encode())
    rows = files.read_first_files(spark, str(tmp_path), 2).collect()
    assert sorted(bytes(r["content"]).decode() for r in rows) == ["a[1].bin", "b*.bin"]
    assert files.read_first_files(spark, str(tmp_path), 9).count() == 4
    assert files.read_first_files(spark, str(tmp_path), 9, name_glob="*.none").count() == 0


def test_prepare_labels_and_keeps_valid(spark, folder):
    checked = prepare.with_validity(prepare.with_label(files.read_images(spark, folder, "*.png")))
    rows = by_name(checked, "label", "is_valid")
    assert rows["broken.png"]["is_valid"] is False and rows["known.png"]["is_valid"] is True
    assert rows["loose.png"]["label"] == "" and rows["flat.png"]["label"] == "FAKE"
    prepared = by_name(prepare.prepare(spark, folder, "*.png"), "label")
    assert sorted(prepared) == ["dark.png", "flat.png", "grey.png", "known.png", "loose.png"]


def test_features_without_resampling(spark, folder):
    images = files.read_images(spark, folder, "*.png")
    rows = by_name(features.image_features(images, resample=None), "features", "is_valid")
    vector = np.array(rows["known.png"]["features"])
    assert len(vector) == 2048
    for c in range(3):
        channel = KNOWN[:, :, c].reshape(-1)
        np.testing.assert_allclose(
            vector[256 * c : 256 * c + 256], np.bincount(channel, minlength=256) / 8
        )
        np.testing.assert_allclose(
            vector[768 + 4 * c : 772 + 4 * c],
            [channel.mean(), channel.std(), channel.min(), channel.max()],
        )
    assert rows["broken.png"]["is_valid"] is False and not any(rows["broken.png"]["features"])
    flat = np.array(rows["flat.png"]["features"])
    assert flat[[200, 456, 712]].tolist() == [1, 1, 1] and flat[:768].sum() == 3
    assert np.array(rows["grey.png"]["features"])[[77, 333, 589]].tolist() == [1, 1, 1]


@pytest.mark.parametrize("method", ["cubic", "nearest"])
def test_features_at_full_size(spark, folder, method):
    images = files.read_images(spark, folder, "*.png")
    rows = by_name(features.image_features(images, layout="global", resample=method), "features")
    flat = rows["flat.png"]["features"]
    pixels = 224 * 224
    assert flat[200] == pixels and flat[768] == 200 and flat[768 + 10] == 3 * pixels
    assert len(rows["known.png"]["features"]) == 2048 and sum(rows["known.png"]["features"][:768]) == 3 * pixels


def test_embedding_hook(spark, folder):
    def make_model():
        return lambda batch: batch.mean(axis=(2, 3)).astype(np.float64)

    images = files.read_images(spark, folder, "*.png")
    rows = by_name(features.embed_images(images, make_model, width=3, chunk=2), "features", "is_valid")
    want = (200 / 255 - np.array([0.485, 0.456, 0.406])) / np.array([0.229, 0.224, 0.225])
    np.testing.assert_allclose(rows["flat.png"]["features"], want, atol=1e-4)
    assert rows["broken.png"]["features"] == [0.0, 0.0, 0.0] and not rows["broken.png"]["is_valid"]


def test_dimensions_and_sizes(spark, folder):
    images = prepare.prepare(spark, folder, "*.png")
    sizes = {(r["height"], r["width"]): r["n_images"] for r in explore.image_dimensions(images).collect()}
    assert sizes == {(2, 4): 1, (3, 3): 1, (5, 4): 1, (2, 2): 1, (2, 6): 1}
    row = explore.file_sizes(files.read_files(spark, folder, "*.txt", recursive=True)).first()
    assert (row["n_files"], row["total_bytes"]) == (1, 9)


def test_ingest_and_verify(spark, folder):
    target = sinks.shared_folder(spark)
    stats = sinks.ingest_files(spark, folder + "/train", target, "*.png")
    assert stats["total_files"] == 4 and stats["failed_files"] == 0
    source = prepare.with_label(files.read_files(spark, folder + "/train", "*.png", recursive=True))
    source = source.withColumn("split", F.lit("train"))
    rows = sinks.verify_ingest(source, spark.read.parquet(target)).collect()
    assert len(rows) == 2 and all(r["complete"] for r in rows)
    none = sinks.ingest_files(spark, folder, sinks.shared_folder(spark), "*.none")
    assert none == {"total_files": 0, "total_size": 0, "failed_files": 0}
    few = sinks.shared_folder(spark)
    assert sinks.ingest_files(spark, folder + "/train", few, "*.png", max_files=2)["total_files"] == 2
    rows = sinks.verify_ingest(source, spark.read.parquet(few)).collect()
    assert not all(r["complete"] for r in rows) and sum(r["target_files"] for r in rows) == 2


def test_inference_from_files(spark, folder):
    rows = infer.image_rows(spark, folder, name_glob="*.png").where("is_valid and label <> ''")
    labeled = rows.withColumn("label", label_to_int(F.col("label")))
    model = train.fit_all(train.training_rows(labeled), train.logistic_regression("small"))
    model_path, output = sinks.shared_folder(spark), sinks.shared_folder(spark)
    sinks.save_model(model, model_path)
    predictions = infer.predict_files(spark, folder, output, model_path, "lr", name_glob="*.png")
    found = by_name(predictions, "label", "prediction", "probability", "is_valid")
    assert len(found) == 6 and found["known.png"]["prediction"] == 1.0
    assert found["flat.png"]["prediction"] == 0.0 and not found["broken.png"]["is_valid"]
    assert abs(sum(found["grey.png"]["probability"]) - 1) < 1e-9


def test_a_broken_file_is_reported_and_does_not_stop_the_run(spark, tmp_path):
    for name, size in (("a", 10), ("b", 20), ("c", 3_000), ("d", 1)):
        folder = tmp_path / "raw" / "train" / "REAL"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.jpg").write_bytes(bytes(size))
    # A checksum that does not fit: Hadoop's file system fails while reading this file.
    (folder / ".b.jpg.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x01\x02\x03\x04")
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    with pytest.raises(Exception, match="b.jpg"):
        files.read_files(spark, source, "*.jpg", recursive=True).collect()
    stats = sinks.ingest_files(spark, source, target, max_bytes=1_000)
    assert stats == {"total_files": 4, "total_size": 3_031, "failed_files": 2}
    status = by_name(sinks.ingest_status(spark, source, target, max_bytes=1_000), "length", "bytes", "error")
    assert {n: (r["length"], r["bytes"], r["error"]) for n, r in status.items()} == {
        "a.jpg": (10, 10, None),
        "b.jpg": (20, None, "unreadable"),
        "c.jpg": (3_000, None, "too long"),
        "d.jpg": (1, 1, None),
    }
    again = sinks.ingest_files(spark, source, str(tmp_path / "few"), max_files=2)
    assert again == {"total_files": 2, "total_size": 30, "failed_files": 1}
    listed = files.read_files(spark, source, "*.jpg", recursive=True)
    cut = spark.read.parquet(target).withColumn("stored", F.least("stored", F.lit(4)))
    told = by_name(files.file_status(listed, cut, 1_000), "error")
    assert told["a.jpg"]["error"] == "cut short" and told["d.jpg"]["error"] is None


def test_a_run_of_which_every_file_failed_has_a_status(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for name in ("train/REAL/a.bin", "test/FAKE/b.bin"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(b"0123456789")
    stats = sinks.ingest_files(spark, str(source), target, "*.bin", max_bytes=9)
    assert stats == {"total_files": 2, "total_size": 20, "failed_files": 2}
    status = by_name(sinks.ingest_status(spark, str(source), target, "*.bin", max_bytes=9), "length", "bytes", "error")
    assert {n: tuple(r)[1:] for n, r in status.items()} == {n: (10, None, "too long") for n in ("a.bin", "b.bin")}
    raw = files.read_files(spark, str(source), "*.bin", recursive=True).withColumns({"split": F.lit("s"), "label": F.lit("l")})
    assert [tuple(r) for r in sinks.verify_ingest(raw, sinks.read_ingested(spark, target)).collect()] == [("s", "l", 2, 20, 0, 0, False)]


def test_kernel_runs_once_and_only_where_needed(spark, folder):
    rows = features.image_features(prepare.with_label(files.read_images(spark, folder, "*.png")))

    def kernels(df):
        return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    assert kernels(rows.where("is_valid and label = 'REAL'").select("path", "features")) == 1
    assert kernels(rows.groupBy("label", "is_valid").count()) == 0
    content = F.col("image.data")
    counted = rows.select("path", features.byte_counts(content, 3).alias("counts"))
    assert kernels(features.histogram_rows(counted, "counts", "path")) == 1


def plain_png(content: bytes) -> np.ndarray:
    """Decoder for the files of these tests: one IDAT chunk, no row filter."""
    import struct
    import zlib

    width, height, _, colour = struct.unpack(">IIBB", content[16:26])
    start = content.index(b"IDAT") + 4
    size = struct.unpack(">I", content[start - 8 : start - 4])[0]
    lines = np.frombuffer(zlib.decompress(content[start : start + size]), dtype=np.uint8)
    values = lines.reshape(height, -1)[:, 1:]
    return values.reshape(height, width, 3) if colour == 2 else np.repeat(values[:, :, None], 3, axis=2)


def test_features_of_encoded_bytes_equal_those_of_the_image_source(spark, folder):
    raw = files.read_files(spark, folder, "*.png", recursive=True)
    from_bytes = by_name(features.decoded_features(raw, plain_png), "features", "is_valid")
    images = files.read_images(spark, folder, "*.png")
    from_images = by_name(features.image_features(images), "features", "is_valid")
    assert sorted(from_bytes) == sorted(from_images)
    for name, row in from_bytes.items():
        assert row["is_valid"] == from_images[name]["is_valid"]
        np.testing.assert_allclose(row["features"], from_images[name]["features"], atol=1e-12)
    checked = by_name(raw.withColumn("ok", features.decodes(F.col("content"), plain_png)), "ok")
    assert [n for n, r in checked.items() if not r["ok"]] == ["broken.png"]


def test_filter_on_decoded_rows_decodes_once(spark, folder):
    raw = files.read_files(spark, folder, "*.png", recursive=True)
    valid = features.decoded_features(raw, plain_png).where("is_valid").select("path", "features")
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and valid.count() == 5


def test_missing_decoder_is_an_error_not_a_bad_image(spark, folder):
    try:
        import PIL  # noqa: F401
    except ImportError:
        raw = files.read_files(spark, folder, "*.png", recursive=True)
        with pytest.raises(Exception, match="Pillow"):
            features.decoded_features(raw).collect()


def write_jpeg(spark, path, grey: int, size: int = 32):
    """Flat JPEG by the JVM's own encoder."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(size, size, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    pixels = image.getRaster()
    for y in range(size):
        for x in range(size):
            for band in range(3):
                pixels.setSample(x, y, band, grey)
    path.parent.mkdir(parents=True, exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def test_default_settings_on_jpeg_files(spark, tmp_path):
    write_jpeg(spark, tmp_path / "train" / "REAL" / "a.jpg", 180)
    write_jpeg(spark, tmp_path / "train" / "FAKE" / "b.jpg", 40)
    write_png(tmp_path / "train" / "FAKE" / "other.png", np.full((2, 2, 3), 1))
    rows = by_name(features.image_features(prepare.prepare(spark, str(tmp_path))), "label", "features")
    assert sorted((n, r["label"]) for n, r in rows.items()) == [("a.jpg", "REAL"), ("b.jpg", "FAKE")]
    for name, grey in (("a.jpg", 180), ("b.jpg", 40)):
        vector = np.array(rows[name]["features"])
        assert abs(vector[:768].sum() - 3) < 1e-9 and all(abs(vector[768 + 4 * c] - grey) < 3 for c in range(3))


def test_large_batches_are_worked_off_in_slices(spark, monkeypatch):
    # The kernels travel with the function, and this one with them.
    def few_rows(counts, layout, rows=features.feature_rows):
        if len(counts) > 256:
            raise ValueError("too many rows at once")
        return rows(counts, layout)

    monkeypatch.setattr(features, "feature_rows", few_rows)
    rows = spark.range(1000, numPartitions=1).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(repeat(chr(id % 100 + 20), 6) AS BINARY)) AS content")
    image = F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("nChannels"), F.col("content").alias("data"))
    tables = [
        features.byte_features(rows),
        features.image_features(rows.withColumn("image", image), resample=None),
        features.image_features(rows.withColumn("image", image), resample="nearest"),
        features.decoded_features(rows, lambda b: np.frombuffer(b, dtype=np.uint8).reshape(1, 2, 3), resample=None),
    ]
    want = {i: (i % 7 != 0, float(i % 100 + 20) if i % 7 else 0.0) for i in range(1000)}
    for table in tables:
        told = table.select("id", "is_valid", F.col("features")[3 * 256].alias("mean")).collect()
        assert len(told) == 1000 and {r["id"]: (r["is_valid"], round(r["mean"], 6)) for r in told} == want
    sums = rows.select("id", F.aggregate(features.byte_counts("content", 3), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"))
    assert {r["id"]: r["n"] for r in sums.collect()} == {i: 6 if i % 7 else 0 for i in range(1000)}
