"""Images as rows: what their headers say, and pixels of PNG images, on Arrow batches of contents.

Headers are read for PNG, JPEG, GIF, BMP and WebP. Pixels are decoded, resized and encoded here for PNG images of 8 bits
(grey, RGB, with or without alpha, not interlaced); other formats need an image library, which `pixels` takes as a pair of
functions, and without one they are an error of their row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipelines import MOST_BYTES, MOST_PIXELS

INFO = "format string, width int, height int, color_model string, has_alpha boolean"
_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels and names of PNG colour types.
_KINDS = {0: (1, "gray", False), 2: (3, "rgb", False), 3: (1, "paletted", False), 4: (2, "gray", True), 6: (4, "rgba", True)}


def info(data: bytes) -> tuple | None:
    """(format, width, height, color_model, has_alpha) from the header, or None."""
    try:
        if data[:8] == _PNG and data[12:16] == b"IHDR":
            width, height, _, kind = struct.unpack(">IIBB", data[16:26])
            _, name, alpha = _KINDS[kind]
            return "png", width, height, name, alpha or b"tRNS" in data[:4096]
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10]), "paletted", False
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            bits = struct.unpack("<H", data[28:30])[0]
            return "bmp", width, abs(height), "paletted" if bits <= 8 else "rgb", bits == 32
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, KeyError, IndexError):
        pass
    return None


def _webp(data: bytes) -> tuple | None:
    if data[12:16] == b"VP8X":
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "ycbcr", bool(data[20] & 16)
    if data[12:16] == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "rgba", bool(bits >> 28 & 1)
    if data[12:16] == b"VP8 ":
        width, height = struct.unpack("<HH", data[26:30])
        return "webp", width & 0x3FFF, height & 0x3FFF, "ycbcr", False
    return None


def _jpeg(data: bytes) -> tuple | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
            return "jpeg", width, height, {1: "gray", 3: "ycbcr", 4: "cmyk"}.get(parts, "ycbcr"), False
        at += 2 if mark == 0x01 or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def decode_png(data: bytes) -> np.ndarray:
    """Height by width by channels."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if bits != 8 or interlaced or kind not in (0, 2, 4, 6):
        raise ValueError("unsupported PNG image")
    if width * height > MOST_PIXELS:
        raise ValueError("too many pixels")
    n, at, parts = _KINDS[kind][0], 8, []
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    raw = zlib.decompressobj().decompress(b"".join(parts), height * (1 + width * n))
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y, line in enumerate(lines):
        out[y] = above = _unfilter(int(line[0]), line[1:], above, n)
    return out.reshape(height, width, n)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line of bytes from its differences to the left (1), above (2), their mean (3) or the nearest predictor (4)."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out, up = np.zeros(len(line) + n, np.int32), np.concatenate([np.zeros(n, np.int32), above])
    for i, x in enumerate(line.tolist(), n):
        left, over, corner = int(out[i - n]), int(up[i]), int(up[i - n])
        if kind == 3:
            guess = (left + over) // 2
        else:
            guess = min((abs(over - corner), 0, left), (abs(left - corner), 1, over), (abs(left + over - 2 * corner), 2, corner))[2]
        out[i] = (x + guess) & 0xFF
    return out[n:].astype(np.uint8)


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    height, width, n = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * n)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def _weights(size: int, to: int) -> np.ndarray:
    """to by size weights of the Catmull-Rom kernel, widened where the image shrinks."""
    scale = size / to
    wide = max(1.0, scale)
    centre = (np.arange(to) + 0.5) * scale - 0.5
    t = np.abs(np.arange(size)[None, :] - centre[:, None]) / wide
    w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(np.float64), (1, 0))
    both = np.tensordot(_weights(pixels.shape[1], width), rows, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def image_info(images: DataFrame, content: str = "content") -> DataFrame:
    """images with format, width, height, color_model, has_alpha (null for what is no image) and size in bytes."""

    @F.pandas_udf(INFO)
    def read(data: pd.Series) -> pd.DataFrame:
        rows = [info(bytes(x[: 1 << 16])) if x is not None else None for x in data]
        return pd.DataFrame([r or (None,) * 5 for r in rows], columns=["format", "width", "height", "color_model", "has_alpha"])

    return images.withColumn("i", read(content)).select(*images.columns, "i.*", F.octet_length(content).alias("size"))


def pixels(images: DataFrame, sizes: dict[str, tuple[int, int]], library: tuple[Callable[[bytes], np.ndarray], Callable[[np.ndarray], bytes]] | None = None) -> DataFrame:
    """key, name, width, height, content, error: each image (key, content) in each size (0 by 0: as it is). The shorter
    side follows the aspect ratio. One row that fails gives its error, null content, and no other row's."""
    read, write = library or (decode_png, encode_png)

    def one(data: bytes, width: int, height: int) -> tuple:
        if len(data) > MOST_BYTES:
            raise ValueError("too large")
        image = read(data)
        h, w = image.shape[:2]
        if width and height:
            ratio = w / h
            width, height = (width, max(1, int(width / ratio))) if ratio > width / height else (max(1, int(height * ratio)), height)
            image = resize(image, width, height)
        return image.shape[1], image.shape[0], write(image), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, data in zip(b["key"], b["content"], strict=True):
                for name, size in sizes.items():
                    try:
                        out.append((key, name, *one(bytes(data or b""), *size)))
                    except (ValueError, zlib.error, struct.error) as e:
                        out.append((key, name, None, None, None, str(e)))
            made = pd.DataFrame(out, columns=["key", "name", "width", "height", "content", "error"])
            yield made.astype({"width": "Int32", "height": "Int32"})

    return images.select("key", "content").mapInPandas(run, "key string, name string, width int, height int, content binary, error string")
