"""Count-based statistics against NumPy on the plain values."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featurevote.functions import rasters
from featurevote.values import FEATURE_WIDTH

bytes_of_any_length = st.binary(min_size=3, max_size=400)


@settings(max_examples=150, deadline=None)
@given(bytes_of_any_length)
def test_global_statistics(data):
    v = np.frombuffer(data, dtype=np.uint8)
    got = rasters.global_statistics(rasters.channel_counts(v)[None])[0]
    want = [
        v.mean(), v.std(), v.min(), v.max(), np.median(v), np.percentile(v, 25), np.percentile(v, 75),
        v.var(), int(v.max()) - int(v.min()), v.sum(dtype=np.int64), len(v), np.count_nonzero(v),
    ]
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-9)


@settings(max_examples=100, deadline=None)
@given(bytes_of_any_length)
def test_channel_statistics_and_layout(data):
    v = np.frombuffer(data, dtype=np.uint8)
    counts = rasters.channel_counts(v)[None]
    row = rasters.feature_rows(counts, "per_channel")[0]
    assert len(row) == FEATURE_WIDTH
    np.testing.assert_allclose(row[:768].sum(), 3.0)
    for c in range(3):
        channel = v[c::3]
        np.testing.assert_array_equal(
            np.round(row[256 * c : 256 * (c + 1)] * len(channel)), np.bincount(channel, minlength=256)
        )
        np.testing.assert_allclose(
            row[768 + 4 * c : 772 + 4 * c],
            [channel.mean(), channel.std(), channel.min(), channel.max()],
            atol=1e-9,
        )
    assert not row[780:].any()
    raw = rasters.feature_rows(counts, "global")[0]
    assert raw[:768].sum() == len(v) and not raw[780:].any()


def test_narrow_layout_is_cut():
    counts = rasters.channel_counts(np.arange(30, dtype=np.uint8))[None]
    assert rasters.feature_rows(counts, "global", width=100).shape == (1, 100)


def test_unknown_layout():
    with pytest.raises(ValueError):
        rasters.feature_rows(np.zeros((1, 3, 256), dtype=np.int64), "other")


def test_to_rgb_reverses_channels_and_widens_grey():
    bgr = bytes([1, 2, 3, 4, 5, 6])
    assert rasters.to_rgb(bgr, 1, 2, 3).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert rasters.to_rgb(bytes([9, 8]), 2, 1, 1).tolist() == [[[9, 9, 9]], [[8, 8, 8]]]
    assert rasters.to_rgb(bytes([1, 2, 3, 255]), 1, 1, 4).tolist() == [[[3, 2, 1]]]
    assert rasters.to_rgb(b"", -1, -1, -1) is None
    assert rasters.to_rgb(b"abc", 2, 2, 3) is None


@pytest.mark.parametrize("method", ["cubic", "nearest"])
def test_resample_keeps_constant_images(method):
    flat = np.full((37, 51, 3), 200, dtype=np.uint8)
    out = rasters.resample_raster(flat, 224, 224, method)
    assert out.shape == (224, 224, 3) and out.dtype == np.uint8 and (out == 200).all()


def test_resample_nearest_by_brute_force():
    raster = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    out = rasters.resample_raster(raster, 11, 3, "nearest")
    for y in range(11):
        for x in range(3):
            assert (out[y, x] == raster[int((y + 0.5) * 5 / 11), int((x + 0.5) * 7 / 3)]).all()


def test_resample_cubic_by_brute_force():
    raster = np.random.default_rng(2).integers(0, 256, (6, 9, 3), dtype=np.uint8)
    across = np.zeros((6, 4, 3))

    def weight(t):
        t = abs(t)
        if t < 1:
            return 1.5 * t**3 - 2.5 * t**2 + 1
        return -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    def line(values, target):
        scale = len(values) / target
        stretch = max(scale, 1.0)
        out = []
        for i in range(target):
            w = [weight((j + 0.5 - (i + 0.5) * scale) / stretch) for j in range(len(values))]
            out.append(min(max(int(np.floor(np.dot(w, values) / sum(w) + 0.5)), 0), 255))
        return out

    for y in range(6):
        for c in range(3):
            across[y, :, c] = line(raster[y, :, c].astype(float), 4)
    want = np.stack(
        [[line(across[:, x, c], 8) for x in range(4)] for c in range(3)], axis=-1
    ).transpose(1, 0, 2)
    got = rasters.resample_raster(raster, 8, 4, "cubic")
    assert np.abs(got.astype(int) - want).max() <= 1
    assert (got == want).mean() > 0.99


def test_standardized_tensor():
    raster = np.full((2, 2, 3), 255, dtype=np.uint8)
    tensor = rasters.standardized_tensor(raster)
    assert tensor.shape == (3, 2, 2) and tensor.dtype == np.float32
    np.testing.assert_allclose(
        tensor[:, 0, 0], [(1 - 0.485) / 0.229, (1 - 0.456) / 0.224, (1 - 0.406) / 0.225], rtol=1e-5
    )


@pytest.mark.parametrize("layout", ["per_channel", "global"])
def test_no_bytes_give_zeros(layout):
    counts = rasters.channel_counts(np.zeros(0, dtype=np.uint8))[None]
    assert not rasters.feature_rows(counts, layout).any()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 600), st.sampled_from([1, 3, 4]), st.sampled_from(["nearest", "cubic", None]), st.integers(0, 99))
def test_counts_equal_those_of_the_copied_raster(height, width, channels, method, seed):
    data = np.random.default_rng(seed).integers(0, 256, height * width * channels, dtype=np.uint8).tobytes()
    size = (224, 224) if method == "nearest" else (12, 20)
    raster = rasters.to_rgb(data, height, width, channels)
    if method:
        raster = rasters.resample_raster(raster, *size, method)
    got = rasters.image_counts(data, height, width, channels, method, size)
    np.testing.assert_array_equal(got, rasters.channel_counts(raster))
    assert rasters.image_counts(data[:-1], height, width, channels, method, size) is None
    assert rasters.image_counts(None, height, width, channels, method, size) is None


def test_long_rows_need_no_full_matrix_of_weights():
    raster = np.random.default_rng(3).integers(0, 256, (1, 40_000, 3), dtype=np.uint8)
    tracemalloc.start()
    out = rasters.resample_raster(raster, 224, 224)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Weights of all places for all others would take 72 MB.
    assert out.shape == (224, 224, 3) and peak < 20 << 20
    assert (40_000, 224) not in rasters._WEIGHTS


def test_tall_rasters_are_brought_to_size_in_strips(monkeypatch):
    raster = np.random.default_rng(4).integers(0, 256, (301, 40, 3), dtype=np.uint8)
    want = rasters.resample_raster(raster, 224, 224)
    monkeypatch.setattr(rasters, "STRIP_VALUES", 1000)
    np.testing.assert_array_equal(rasters.resample_raster(raster, 224, 224), want)
