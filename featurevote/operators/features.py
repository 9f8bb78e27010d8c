"""Bytes and images to fixed-width feature arrays, one Arrow pass, no shuffle.

Only the raster column crosses to the Python worker; keys, labels and batches stay in the
JVM. Each row is reduced to 256-bin counts as soon as it is seen, and an Arrow batch is worked
off in slices of SLICE_ROWS rows: a row's counts and features take far more space than most
rasters, so a worker never holds those of a whole batch.

``is_valid`` is a JVM expression on lengths and sizes. A filter on it therefore moves below
the kernel instead of running the kernel a second time, and counting rows runs no kernel.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurevote.functions import rasters
from featurevote.functions.rasters import (
    channel_counts,
    feature_rows,
    global_statistics,
    image_counts,
    per_channel_statistics,
    resample_raster,
    standardized_tensor,
    to_rgb,
)
from featurevote.functions.vectors import standardized
from featurevote.values import (
    CHANNEL_MEAN,
    CHANNEL_STD,
    FEATURE_WIDTH,
    HISTOGRAM_BINS,
    IMAGE_HEIGHT,
    IMAGE_WIDTH,
)

# Executors need no installed copy of the kernels: they travel with the serialized function.
cloudpickle.register_pickle_by_value(rasters)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GLOBAL_STATISTICS = (
    "mean", "std", "min", "max", "median", "p25", "p75", "var", "range", "sum", "len", "nonzero",
)
CHANNEL_STATISTICS = ("mean", "std", "min", "max")
# Rows whose counts and features a worker holds at once, about 50 KB each.
SLICE_ROWS = 128


def _list_array(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def _byte_view(scalar: pa.BinaryScalar) -> np.ndarray:
    buffer = scalar.as_buffer()
    return np.frombuffer(buffer if buffer is not None else b"", dtype=np.uint8)


def _slices(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of each batch in slices of SLICE_ROWS rows, without a copy."""
    for columns in batches:
        for start in range(0, len(columns[0]), SLICE_ROWS):
            yield tuple(c.slice(start, SLICE_ROWS) for c in columns)


def _sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return (column for (column,) in _slices((b,) for b in batches))


def _count_rows(content: pa.Array, n_channels: int) -> np.ndarray:
    counts = np.zeros((len(content), n_channels, HISTOGRAM_BINS), dtype=np.int64)
    for i, scalar in enumerate(content):
        counts[i] = channel_counts(_byte_view(scalar), n_channels)
    return counts


def byte_counts(content: Column, n_channels: int = 1) -> Column:
    """256-bin counts per channel of interleaved bytes, as one flat ``array<bigint>``."""

    @F.arrow_udf("array<bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in _sliced(batches):
            yield _list_array(_count_rows(column, n_channels).reshape(len(column), -1))

    return count(content)


def byte_statistics(content: Column, layout: str, n_channels: int = 3) -> Column:
    """Statistics of interleaved bytes: 4 per channel, or the 12 over all channels."""

    @F.arrow_udf("array<double>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        statistics = per_channel_statistics if layout == "per_channel" else global_statistics
        for column in _sliced(batches):
            yield _list_array(statistics(_count_rows(column, n_channels)))

    return describe(content)


def byte_features(df: DataFrame, content: str = "content", layout: str = "per_channel") -> DataFrame:
    """Add ``features`` and ``is_valid`` from raw interleaved three-channel bytes.

    Empty or missing bytes keep their row, with a zero vector and ``is_valid`` false.
    """

    @F.arrow_udf("array<double>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in _sliced(batches):
            yield _list_array(feature_rows(_count_rows(column, 3), layout))

    return df.withColumns(
        {
            "features": extract(F.col(content)),
            "is_valid": F.coalesce(F.octet_length(content) > 0, F.lit(False)),
        }
    )


def image_features(
    images: DataFrame,
    image: str = "image",
    layout: str = "per_channel",
    resample: str | None = "cubic",
) -> DataFrame:
    """Add ``features`` and ``is_valid`` from an image struct column.

    The raster is brought to 224 x 224 first (``cubic`` or ``nearest``; ``None`` keeps its
    size). Unreadable images keep their row, with a zero vector and ``is_valid`` false.
    """

    @F.arrow_udf("array<double>")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, height, width, channels in _slices(batches):
            counts = np.zeros((len(data), 3, HISTOGRAM_BINS), dtype=np.int64)
            shapes = zip(height.to_pylist(), width.to_pylist(), channels.to_pylist())
            for i, (scalar, (h, w, c)) in enumerate(zip(data, shapes)):
                found = image_counts(scalar.as_buffer(), h or 0, w or 0, c or 0, resample, (IMAGE_HEIGHT, IMAGE_WIDTH))
                if found is not None:
                    counts[i] = found
            yield _list_array(feature_rows(counts, layout))

    return images.withColumns(
        {"features": extract(*_raster_columns(image)), "is_valid": is_readable(image)}
    )


def decoded_features(
    df: DataFrame,
    decode: Callable[[bytes], np.ndarray] | None = None,
    content: str = "content",
    layout: str = "per_channel",
    resample: str | None = "cubic",
) -> DataFrame:
    """Add ``features`` and ``is_valid`` from encoded image bytes, such as an ingested table's.

    ``decode`` turns the bytes of one file into (height, width, 3) RGB and may raise; by
    default Pillow does it, if the executors have it. Rows that fail keep a zero vector. Put
    filters on other columns before this step: none moves below it, so it runs once.
    """
    decode = decode or pillow_rgb

    @F.arrow_udf("struct<features:array<double>,is_valid:boolean>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in _sliced(batches):
            counts = np.zeros((len(column), 3, HISTOGRAM_BINS), dtype=np.int64)
            for i, scalar in enumerate(column):
                raster = _decoded(scalar.as_py(), decode)
                if raster is not None:
                    if resample:
                        raster = resample_raster(raster, IMAGE_HEIGHT, IMAGE_WIDTH, resample)
                    counts[i] = channel_counts(raster)
            readable = counts.any(axis=(1, 2))
            yield pa.StructArray.from_arrays(
                [_list_array(feature_rows(counts, layout)), pa.array(readable)],
                names=["features", "is_valid"],
            )

    extracted = df.withColumn("_extracted", extract.asNondeterministic()(F.col(content)))
    kept = [c for c in df.columns if c not in ("features", "is_valid")]
    return extracted.select(*kept, "_extracted.features", "_extracted.is_valid")


def decodes(content: Column, decode: Callable[[bytes], np.ndarray] | None = None) -> Column:
    """Whether encoded image bytes can be decoded to a raster with both sides above zero."""
    decode = decode or pillow_rgb

    @F.arrow_udf("boolean")
    def check(column: pa.Array) -> pa.Array:
        return pa.array([_decoded(scalar.as_py(), decode) is not None for scalar in column])

    return check(content)


def pillow_rgb(content: bytes) -> np.ndarray:
    """RGB raster by Pillow."""
    import io

    try:
        from PIL import Image
    except ImportError as error:
        raise MissingDecoder("install Pillow on the executors or pass a decoder") from error
    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


class MissingDecoder(RuntimeError):
    """No decoder is available; unlike a broken file this fails the job."""


def _decoded(content: bytes | None, decode: Callable[[bytes], np.ndarray]) -> np.ndarray | None:
    if content is None:
        return None
    try:
        raster = decode(content)
    except MissingDecoder:
        raise
    except Exception:
        return None
    return raster if raster.ndim == 3 and raster.size and raster.shape[2] == 3 else None


def embed_images(
    images: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    image: str = "image",
    width: int = FEATURE_WIDTH,
    resample: str = "cubic",
    chunk: int = 32,
) -> DataFrame:
    """Add ``features`` from a caller-supplied batch model over standardized rasters.

    ``make_model`` runs once per task and returns a function from (n, 3, 224, 224) float32
    to (n, width). Unreadable images get a zero vector and ``is_valid`` false.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make_model()
        for data, height, width_px, channels in _slices(batches):
            out = np.zeros((len(data), width))
            waiting: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if waiting:
                    out[[i for i, _ in waiting]] = model(np.stack([t for _, t in waiting]))
                    waiting.clear()

            for i, raster in enumerate(_rasters(data, height, width_px, channels, resample)):
                if raster is not None:
                    waiting.append((i, standardized_tensor(raster)))
                if len(waiting) >= chunk:
                    flush()
            flush()
            yield _list_array(out)

    return images.withColumns(
        {"features": embed(*_raster_columns(image)), "is_valid": is_readable(image)}
    )


def is_readable(image: str = "image") -> Column:
    """Whether the image struct holds a raster: positive sides and as many bytes as they ask for."""
    data, height, width, channels = _raster_columns(image)
    sized = (height > 0) & (width > 0) & channels.isin(1, 3, 4)
    whole = F.octet_length(data) == height.cast("bigint") * width * channels
    return F.coalesce(sized & whole, F.lit(False))


def standardized_channels(df: DataFrame, value_columns: tuple[str, str, str]) -> DataFrame:
    """Replace three byte-valued channel columns by their standardized values."""
    return df.withColumns(
        {
            name: standardized(F.col(name), mean, std)
            for name, mean, std in zip(value_columns, CHANNEL_MEAN, CHANNEL_STD)
        }
    )


def histogram_rows(df: DataFrame, counts: str, key: str) -> DataFrame:
    """Long form of a counts array: (key, channel, bin, n), empty bins left out."""
    bins = F.lit(HISTOGRAM_BINS)
    return (
        # Outer, because a plain explode would first filter on the counts and so compute them twice.
        df.select(key, F.posexplode_outer(counts).alias("position", "n"))
        .where("n > 0")
        .select(
            key,
            (F.col("position") / bins).cast("int").alias("channel"),
            (F.col("position") % bins).cast("int").alias("bin"),
            F.col("n").cast("bigint").alias("n"),
        )
    )


def _raster_columns(image: str) -> list[Column]:
    return [F.col(f"{image}.{field}") for field in ("data", "height", "width", "nChannels")]


def _rasters(data, height, width, channels, resample) -> Iterator[np.ndarray | None]:
    for row in zip(data, height, width, channels):
        content, h, w, c = (cell.as_py() for cell in row)
        raster = to_rgb(content, h or 0, w or 0, c or 0)
        if raster is not None and resample:
            raster = resample_raster(raster, IMAGE_HEIGHT, IMAGE_WIDTH, resample)
        yield raster
