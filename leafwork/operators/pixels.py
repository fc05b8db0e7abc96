"""What an image's pixels tell: decoding of PNG files, one colour, black and white, hashes of bytes.

Files that cannot be decoded here (other formats, interlaced or damaged ones) are never called solid or black and white.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from leafwork.operators.notation import python_column

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray | None:
    """Height x width x 3 (or x 1 for grey) of an 8-bit, not interlaced PNG, without its alpha; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette, head = 8, [], None, None
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            at += 12 + size
        width, height, depth, colour, _, _, interlaced = head
        if depth != 8 or interlaced or not width or not height:
            return None
        n = _CHANNELS[colour]
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
        out = np.zeros((height, width * n), np.uint8)
        above = np.zeros(width * n, np.uint8)
        for y in range(height):
            above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, n)
    except (ValueError, KeyError, TypeError, struct.error, zlib.error):
        return None
    out = out.reshape(height, width, n)
    if colour == 3:
        return None if palette is None or out.max() >= len(palette) else palette[out[:, :, 0]]
    return out[:, :, : 1 if n < 3 else 3]


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A row of PNG bytes without its filter: none, left, above, mean, or the nearest of left, above and corner."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("an unknown filter")
    out, up = row.astype(int).tolist(), above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - n], up[i - n]) if i >= n else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def _shrunk(pixels: np.ndarray, most: int = 100) -> np.ndarray:
    """At most `most` rows and columns, each the mean of those it stands for; a smaller image as it is."""
    if max(pixels.shape[:2]) <= most:
        return pixels.astype(float)
    for axis in (0, 1):
        n = pixels.shape[axis]
        edges = np.unique(np.linspace(0, n, min(n, most) + 1).astype(int))
        count = np.diff(edges).reshape([-1, 1, 1] if axis == 0 else [1, -1, 1])
        pixels = np.add.reduceat(pixels.astype(float), edges[:-1], axis=axis) / count
    return pixels


def channel_deviation(data: bytes | None) -> float | None:
    """The mean of the channels' standard deviations of an image of at most 100 x 100 (larger ones are averaged down); None if unknown."""
    pixels = decode_png(bytes(data)) if data else None
    return None if pixels is None else float(_shrunk(pixels).std(axis=(0, 1)).mean())


def grey_share(data: bytes | None) -> float | None:
    """The share of pixels whose channels differ by less than 30 together, on bytes that wrap around; None if unknown."""
    pixels = decode_png(bytes(data)) if data else None
    if pixels is None:
        return None
    if pixels.shape[2] == 1:
        return 1.0
    r, g, b = (pixels[:, :, k] for k in range(3))
    return float((((r - g) + (g - b) + (r - b)) < 30).mean())


def with_pixels(images: DataFrame) -> DataFrame:
    """Adds md5, std_mean (null: unknown), solid, bw_share and black_and_white to images (bytes)."""
    deviation, share = (python_column(images, "bytes", f, "double") for f in (channel_deviation, grey_share))
    made = images.withColumns({"md5": F.md5("bytes"), "std_mean": deviation, "bw_share": share})
    return made.withColumns({"solid": F.coalesce(F.col("std_mean") < 10, F.lit(False)), "black_and_white": F.coalesce(F.col("bw_share") > 0.9, F.lit(False))})
