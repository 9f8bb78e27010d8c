"""NumPy kernels that run inside Arrow batches: bytes -> counts -> fixed-width features.

Everything after the byte counting works on 256-bin counts, never on pixels: mean,
deviation, extremes and interpolated percentiles of 8-bit data follow exactly from them.
"""

from __future__ import annotations

import numpy as np

from featurevote.values import (
    CHANNEL_MEAN,
    CHANNEL_STD,
    FEATURE_WIDTH,
    HISTOGRAM_BINS,
)

_LEVELS = np.arange(HISTOGRAM_BINS, dtype=np.float64)
# Cubic weights kept: those of so many sizes, of up to so many numbers each (1 MB); longer ones are made anew.
MEMO_SIZES = 64
LONG_WEIGHTS = 1 << 17
# Target places that share a band, and raster values that are held as doubles at once.
BAND = 16
STRIP_VALUES = 1 << 20
_WEIGHTS: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}


def _planes(data, height: int, width: int, n_channels: int) -> np.ndarray | None:
    """(height, width, 3) in RGB order from row-wise BGR(A) bytes, (height, width, 1) from grey ones; None if
    they are not readable. A view of the bytes."""
    if data is None or height <= 0 or width <= 0 or n_channels not in (1, 3, 4):
        return None
    if len(data) != height * width * n_channels:
        return None
    raster = np.frombuffer(data, dtype=np.uint8).reshape(height, width, n_channels)
    return raster if n_channels == 1 else raster[:, :, 2::-1]


def to_rgb(data: bytes, height: int, width: int, n_channels: int) -> np.ndarray | None:
    """Raster in RGB order from row-wise BGR(A) or grey bytes; None if it is not readable."""
    raster = _planes(data, height, width, n_channels)
    return np.repeat(raster, 3, axis=2) if raster is not None and n_channels == 1 else raster


def image_counts(
    data, height: int, width: int, n_channels: int, resample: str | None, size: tuple[int, int]
) -> np.ndarray | None:
    """(3, 256) counts of the raster brought to ``size``, as of :func:`to_rgb`; None if it is not readable.

    Grey is counted once. The nearest pixels are not copied out: a pixel counts as often as it is taken.
    """
    raster = _planes(data, height, width, n_channels)
    if raster is None:
        return None
    if resample == "nearest":
        counts = _nearest_counts(raster, *size)
    else:
        counts = channel_counts(resample_raster(raster, *size, resample) if resample else raster, raster.shape[2])
    return np.repeat(counts, 3, axis=0) if n_channels == 1 else counts


def _taken(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that nearest-pixel resampling takes, and how often each."""
    places = ((np.arange(target) + 0.5) * size / target).astype(np.intp)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return places[first], np.diff(first, append=target)


def _nearest_counts(raster: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, times_down = _taken(raster.shape[0], height)
    cols, times_across = _taken(raster.shape[1], width)
    taken = raster.take(rows, axis=0).take(cols, axis=1)
    times = np.multiply.outer(times_down, times_across).reshape(-1)
    planes = taken.reshape(-1, raster.shape[2])
    return np.stack(
        [np.bincount(planes[:, c], weights=times, minlength=HISTOGRAM_BINS) for c in range(planes.shape[1])]
    ).astype(np.int64)


def _cubic_weights(size: int, target: int) -> list[tuple[int, np.ndarray]]:
    """Cubic-convolution weights (a = -0.5), widened when shrinking, for BAND target places after the other:
    the first source place that counts, and rows of weights from there on. All others are zero."""
    found = _WEIGHTS.get((size, target))
    if found is None:
        found = _new_cubic_weights(size, target)
        if sum(w.size for _, w in found) <= LONG_WEIGHTS:
            if len(_WEIGHTS) >= MEMO_SIZES:
                _WEIGHTS.clear()
            _WEIGHTS[size, target] = found
    return found


def _new_cubic_weights(size: int, target: int) -> list[tuple[int, np.ndarray]]:
    scale = size / target
    stretch = max(scale, 1.0)
    bands = []
    for start in range(0, target, BAND):
        centre = (np.arange(start, min(start + BAND, target))[:, None] + 0.5) * scale
        first = max(int(np.floor(centre[0, 0] - 2 * stretch)) - 1, 0)
        last = min(int(np.ceil(centre[-1, 0] + 2 * stretch)) + 1, size)
        t = np.abs((np.arange(first, last)[None, :] + 0.5 - centre) / stretch)
        near = 1.5 * t**3 - 2.5 * t**2 + 1.0
        far = -0.5 * t**3 + 2.5 * t**2 - 4.0 * t + 2.0
        weights = np.where(t < 1.0, near, np.where(t < 2.0, far, 0.0))
        bands.append((first, weights / weights.sum(axis=1, keepdims=True)))
    return bands


def _weighted(planes: np.ndarray, target: int) -> np.ndarray:
    """Planes whose last axis is brought to ``target`` places, in whole levels."""
    bands = _cubic_weights(planes.shape[-1], target)
    return _whole_levels(np.concatenate([planes[..., a : a + w.shape[1]] @ w.T for a, w in bands], axis=-1))


def resample_raster(raster: np.ndarray, height: int, width: int, method: str = "cubic") -> np.ndarray:
    """Raster of the wanted size by cubic convolution or by nearest pixel."""
    h, w = raster.shape[:2]
    if (h, w) == (height, width):
        return raster
    if method == "nearest":
        rows = ((np.arange(height) + 0.5) * h / height).astype(np.intp)
        cols = ((np.arange(width) + 0.5) * w / width).astype(np.intp)
        return raster.take(rows, axis=0).take(cols, axis=1)
    # Across first, then down, rounding to whole levels after each pass.
    planes = raster.transpose(2, 0, 1)
    rows = max(1, STRIP_VALUES // (planes.shape[0] * w))
    strips = [_weighted(planes[:, a : a + rows].astype(np.float64), width).astype(np.uint8) for a in range(0, h, rows)]
    across = np.concatenate(strips, axis=1).transpose(0, 2, 1)
    return _weighted(across.astype(np.float64), height).astype(np.uint8).transpose(2, 1, 0)


def _whole_levels(planes: np.ndarray) -> np.ndarray:
    # The nearest level, halves up; the little on top makes a half one whatever the order of its sum.
    return np.clip(np.floor(planes + (0.5 + 1e-9)), 0, 255)


def channel_counts(interleaved: np.ndarray, n_channels: int = 3) -> np.ndarray:
    """256-bin counts of each channel of interleaved bytes, any length."""
    flat = interleaved.reshape(-1)
    return np.stack(
        [np.bincount(flat[c::n_channels], minlength=HISTOGRAM_BINS) for c in range(n_channels)]
    )


def moments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, population variance, sum) over the last axis of 256-bin counts."""
    n = counts.sum(axis=-1)
    total = (counts * _LEVELS).sum(axis=-1)
    safe = np.maximum(n, 1)
    mean = total / safe
    variance = (counts * (_LEVELS - mean[..., None]) ** 2).sum(axis=-1) / safe
    return n, mean, variance, total


def extremes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value that occurs, 0 where none does."""
    present = counts > 0
    low = present.argmax(axis=-1)
    high = HISTOGRAM_BINS - 1 - present[..., ::-1].argmax(axis=-1)
    high = np.where(present.any(axis=-1), high, 0)
    return low.astype(np.float64), high.astype(np.float64)


def percentile(counts: np.ndarray, q: float) -> np.ndarray:
    """Linearly interpolated percentile (0..1) of the counted values, 0 where there are none."""
    cumulative = counts.cumsum(axis=-1)
    rank = q * np.maximum(cumulative[..., -1] - 1, 0)
    below = np.floor(rank)
    lower = (cumulative <= below[..., None]).sum(axis=-1)
    upper = (cumulative <= np.ceil(rank)[..., None]).sum(axis=-1)
    return np.where(cumulative[..., -1] > 0, lower + (upper - lower) * (rank - below), 0.0)


def per_channel_statistics(counts: np.ndarray) -> np.ndarray:
    """Mean, deviation, min, max of each channel: (rows, channels, 256) -> (rows, channels*4)."""
    _, mean, variance, _ = moments(counts)
    low, high = extremes(counts)
    return np.stack([mean, np.sqrt(variance), low, high], axis=-1).reshape(len(counts), -1)


def global_statistics(counts: np.ndarray) -> np.ndarray:
    """The 12 statistics over all channels together: (rows, channels, 256) -> (rows, 12)."""
    pooled = counts.sum(axis=1)
    n, mean, variance, total = moments(pooled)
    low, high = extremes(pooled)
    return np.stack(
        [
            mean,
            np.sqrt(variance),
            low,
            high,
            percentile(pooled, 0.5),
            percentile(pooled, 0.25),
            percentile(pooled, 0.75),
            variance,
            high - low,
            total,
            n.astype(np.float64),
            (n - pooled[:, 0]).astype(np.float64),
        ],
        axis=-1,
    )


def feature_rows(counts: np.ndarray, layout: str, width: int = FEATURE_WIDTH) -> np.ndarray:
    """Feature vectors from (rows, 3, 256) counts.

    ``per_channel``: histograms as shares of the pixels, then 4 statistics per channel.
    ``global``: raw histogram counts, then 12 statistics over all channels.
    """
    histogram = counts.astype(np.float64)
    if layout == "per_channel":
        histogram = histogram / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
        statistics = per_channel_statistics(counts)
    elif layout == "global":
        statistics = global_statistics(counts)
    else:
        raise ValueError(f"unknown feature layout: {layout}")
    used = np.concatenate([histogram.reshape(len(counts), -1), statistics], axis=1)[:, :width]
    out = np.zeros((len(counts), width))
    out[:, : used.shape[1]] = used
    return out


def standardized_tensor(raster: np.ndarray) -> np.ndarray:
    """Channels-first float32 raster scaled to [0, 1] and standardized per channel."""
    scaled = (raster.astype(np.float32) / 255.0 - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_STD)
    return np.ascontiguousarray(scaled.transpose(2, 0, 1))
