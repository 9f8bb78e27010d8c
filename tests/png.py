"""Hand-made PNG files, written with zlib only."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(path: Path, rgb: np.ndarray) -> None:
    """8-bit PNG of (h, w, 3) RGB or (h, w) grey values."""
    height, width = rgb.shape[:2]
    colour = 2 if rgb.ndim == 3 else 0
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    lines = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(height))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n"
        + _chunk(b"IHDR", header)
        + _chunk(b"IDAT", zlib.compress(lines))
        + _chunk(b"IEND", b"")
    )
