"""Image headers read from bytes, against files that Spark itself decodes, and on damaged bytes."""

import zlib

import numpy as np
import pytest

from featurevote.operators import explore, prepare
from featurevote.sources import files
from tests.png import write_png
from tests.test_images import write_jpeg


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("headers")
    write_png(root / "REAL" / "a.png", np.zeros((3, 70, 3)))
    write_png(root / "FAKE" / "b.png", np.ones((260, 5)))
    write_jpeg(spark, root / "REAL" / "c.jpg", 90, 17)
    whole = (root / "REAL" / "a.png").read_bytes()
    (root / "REAL" / "cut.png").write_bytes(whole[:-3])
    (root / "REAL" / "flipped.png").write_bytes(whole[:20] + bytes([whole[20] ^ 1]) + whole[21:])
    (root / "REAL" / "short.png").write_bytes(whole[:19])
    (root / "FAKE" / "cut.jpg").write_bytes((root / "REAL" / "c.jpg").read_bytes()[:-2])
    (root / "FAKE" / "start.jpg").write_bytes(b"\xff\xd8")
    (root / "FAKE" / "text.jpg").write_bytes(b"no image")
    (root / "other.png").write_bytes(whole)
    return str(root)


def by_name(df):
    return {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_sizes_equal_those_of_decoded_images(spark, folder):
    raw = files.read_files(spark, folder, recursive=True)
    told = by_name(prepare.with_header(raw.select("path", "content")))
    decoded = by_name(prepare.with_validity(files.read_images(spark, folder)))
    assert {n for n, r in told.items() if r["is_valid"]} == {"a.png", "b.png", "c.jpg", "other.png"}
    for name in ("a.png", "b.png", "c.jpg"):
        assert decoded[name]["is_valid"]
        assert (told[name]["height"], told[name]["width"]) == (decoded[name]["image"]["height"], decoded[name]["image"]["width"])
    assert {n: r["format"] for n, r in told.items()} == {
        "a.png": "png", "b.png": "png", "c.jpg": "jpeg", "cut.png": "png", "flipped.png": "png", "short.png": "png",
        "cut.jpg": "jpeg", "start.jpg": "jpeg", "text.jpg": None, "other.png": "png",
    }
    assert told["start.jpg"]["height"] is None and told["short.png"]["height"] is None


def test_prepared_files_and_dimensions(spark, folder):
    raw = files.read_files(spark, folder, recursive=True).select("path", "content")
    kept = by_name(prepare.prepare_files(raw))
    assert {n: r["label"] for n, r in kept.items()} == {"a.png": "REAL", "b.png": "FAKE", "c.jpg": "REAL", "other.png": ""}
    sizes = explore.image_dimensions(prepare.prepare_files(raw), ["label"], image=None).collect()
    assert {(r["label"], r["height"], r["width"], r["n_images"]) for r in sizes} == {
        ("REAL", 3, 70, 1), ("FAKE", 260, 5, 1), ("REAL", 17, 17, 1), ("", 3, 70, 1),
    }


def test_odd_bytes(spark):
    def png(width, height):
        header = b"IHDR" + width.to_bytes(4) + height.to_bytes(4) + bytes([8, 2, 0, 0, 0])
        return b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0d" + header + zlib.crc32(header).to_bytes(4) + b"\x00\x00\x00\x00IEND\xaeB`\x82"

    # A segment that holds what looks like a frame header, and one that leads nowhere.
    trap = b"\xff\xc0\x00\x11\x08\x00\x63\x00\x63\x03" + bytes(9)
    frame = b"\xff\xc2\x00\x11\x08\x00\x07\x01\x00\x03" + bytes(9)
    hidden = b"\xff\xd8\xff\xfe" + (2 + len(trap)).to_bytes(2) + trap + frame + b"\xff\xd9"
    rows = [(1, None), (2, b""), (3, png(0, 5)), (4, png(9, 5)), (5, hidden), (6, b"\xff\xd8\xff\xe0\x00\x00" + frame + b"\xff\xd9")]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r["id"]: (r["format"], r["height"], r["width"], r["is_valid"]) for r in prepare.with_header(df).collect()}
    assert got == {
        1: (None, None, None, False),
        2: (None, None, None, False),
        3: ("png", 5, 0, False),
        4: ("png", 5, 9, True),
        5: ("jpeg", 7, 256, True),
        6: ("jpeg", None, None, False),
    }


def test_no_python_is_needed(spark, folder):
    raw = files.read_files(spark, folder, recursive=True).select("path", "content")
    plan = prepare.with_header(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
