"""Format, size and soundness of encoded images from their bytes, without decoding a pixel.

Column expressions only: a PNG's first chunk with its checksum and its end, a JPEG's segments up to the
frame header and its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two formats.
PNG_SIGNATURE = "89504E470D0A1A0A"
PNG_HEADER_START = "0000000D49484452"  # length 13 and the name of the header chunk
PNG_END = "0000000049454E44AE426082"  # empty last chunk with its checksum
JPEG_START = "FFD8"
JPEG_END = "FFD9"
# Frame headers are C0 to CF but for C4, C8 and CC.
JPEG_FRAMES = tuple(f"C{d}" for d in "01235679ABDEF")
# Segments that a walk looks at before the frame header; real files have a few.
MAX_SEGMENTS = 256


def _number(content: Column, start: Column | int, length: int) -> Column:
    """Big-endian number of `length` bytes from the 1-based place on; missing behind the end."""
    part = F.hex(F.substring(content, F.lit(start) if isinstance(start, int) else start, F.lit(length)))
    return F.when(F.length(part) == 2 * length, F.conv(part, 16, 10).cast("bigint"))


def _starts(content: Column, text: str, start: int = 1) -> Column:
    return F.hex(F.substring(content, F.lit(start), F.lit(len(text) // 2))) == text


def _ends(content: Column, text: str) -> Column:
    n = len(text) // 2
    return F.hex(F.substring(content, F.length(content) - n + 1, F.lit(n))) == text


def _jpeg_frame(content: Column) -> Column:
    """(height, width) of the frame header, found by walking from segment to segment; else missing."""
    start = F.struct(
        F.lit(3).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("height"), F.lit(None).cast("bigint").alias("width")
    )

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        marker = F.hex(F.substring(content, at.cast("int"), F.lit(2)))
        length = _number(content, (at + 2).cast("int"), 2)
        is_frame = F.substring(marker, 3, 2).isin(*JPEG_FRAMES)
        sound = F.startswith(marker, F.lit("FF")) & (length >= 2)
        there = (at > 0) & state["height"].isNull()
        height, width = _number(content, (at + 5).cast("int"), 2), _number(content, (at + 7).cast("int"), 2)
        # A place of 0 ends the walk, at the frame header or where no segment begins.
        following = F.when(F.coalesce(there & sound & ~is_frame, F.lit(False)), at + 2 + length).otherwise(F.lit(0))
        found = F.coalesce(there & sound & is_frame, F.lit(False))
        return F.struct(
            following.cast("bigint").alias("at"),
            F.when(found, height).otherwise(state["height"]).alias("height"),
            F.when(found, width).otherwise(state["width"]).alias("width"),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_SEGMENTS)), start, step)
    return F.struct(walked["height"].alias("height"), walked["width"].alias("width"))


def image_header(content: Column) -> Column:
    """(format, height, width, is_valid) of encoded bytes.

    ``format`` is png, jpeg or missing. ``is_valid`` needs both sides above zero, and a whole file: for PNG
    the header chunk's checksum and the closing chunk, for JPEG the end mark. Missing or foreign bytes
    have no format and are not valid.
    """
    content = F.coalesce(content, F.lit(b""))
    is_png = _starts(content, PNG_SIGNATURE) & _starts(content, PNG_HEADER_START, 9)
    is_jpeg = _starts(content, JPEG_START)
    checksum = F.crc32(F.substring(content, F.lit(13), F.lit(17)))
    whole_png = (checksum == _number(content, 30, 4)) & _ends(content, PNG_END)

    def told(frame: Column) -> Column:
        height = F.when(is_png, _number(content, 21, 4)).when(is_jpeg, frame["height"])
        width = F.when(is_png, _number(content, 17, 4)).when(is_jpeg, frame["width"])
        whole = F.when(is_png, whole_png).when(is_jpeg, _ends(content, JPEG_END))
        return F.struct(
            F.when(is_png, "png").when(is_jpeg, "jpeg").alias("format"),
            height.cast("int").alias("height"),
            width.cast("int").alias("width"),
            F.coalesce((height > 0) & (width > 0) & whole, F.lit(False)).alias("is_valid"),
        )

    none = F.lit(None).cast("struct<height:bigint,width:bigint>")
    frame = F.when(is_jpeg, _jpeg_frame(content)).otherwise(none)
    return F.get(F.transform(F.array(frame), told), F.lit(0))
