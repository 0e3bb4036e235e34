"""Image files as rows, and decoding without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, tiff

# Suffixes that count as images.
SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def list_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, content of image files; names are filtered before contents are read. Earlier annotated output is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.lower("path")
    return files.where(F.regexp_extract(name, r"\.([a-z]+)$", 1).isin(*SUFFIXES) & ~name.rlike(r"_annotated\.(jpg|png)$")).select("path", "content")


def _png(b: bytes) -> np.ndarray:
    at, data, palette, alpha = 8, [], None, False
    width = height = depth = kind = 0
    while at < len(b):
        n, tag = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + n]
        at += n + 12
        if tag == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            if lace:
                raise ValueError("interlaced PNG")
        elif tag == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            data.append(body)
        elif tag == b"IEND":
            break
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    bits = ch * depth
    line, step = (width * bits + 7) // 8, max(1, bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    up = np.zeros(line, np.uint8)
    for y in range(height):
        f, row = raw[y, 0], raw[y, 1:].copy()
        if f == 1:
            for i in range(step):
                row[i::step] = np.cumsum(row[i::step], dtype=np.uint8)
        elif f == 2:
            row += up
        elif f in (3, 4):
            r, u = row.tolist(), up.tolist()
            for i in range(line):
                a, c = (r[i - step], u[i - step]) if i >= step else (0, 0)
                if f == 3:
                    r[i] = (r[i] + (a + u[i]) // 2) & 255
                else:
                    p = a + u[i] - c
                    pa, pb, pc = abs(p - a), abs(p - u[i]), abs(p - c)
                    r[i] = (r[i] + (a if pa <= pb and pa <= pc else u[i] if pb <= pc else c)) & 255
            row = np.array(r, np.uint8)
        elif f:
            raise ValueError("unknown PNG filter")
        out[y] = up = row
    if depth == 16:
        img = out.view(">u2").astype(np.uint16)
    elif depth == 8:
        img = out
    else:
        img = np.unpackbits(out, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth)[::-1])
        img = img[:, :width].astype(np.uint8)
        if kind == 0:
            img = (img * (255 // ((1 << depth) - 1))).astype(np.uint8)
    img = img.reshape(height, width, ch)
    if kind == 3:
        img = palette[img[..., 0]]
    elif kind in (0, 4):
        img = np.repeat(img[..., :1], 3, axis=2)
    return img[..., :3][..., ::-1]


def _bmp(b: bytes) -> np.ndarray:
    start, (width, height), bits, packed = *struct.unpack("<I", b[10:14]), struct.unpack("<ii", b[18:26]), *struct.unpack("<H", b[28:30]), *struct.unpack("<I", b[30:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("BMP of this kind")
    line = (width * bits // 8 + 3) // 4 * 4
    img = np.frombuffer(b, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, -1)[..., :3]
    return img[::-1] if height > 0 else img


def decode(b: bytes) -> np.ndarray:
    """8-bit BGR; deeper images are scaled by their largest value. ValueError for what can't be read."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            img = _png(b)
        elif b[:2] == b"BM":
            img = _bmp(b)
        elif b[:3] == b"\xff\xd8\xff":
            img = jpeg.decode(b)
        elif b[:4] in (b"II*\0", b"MM\0*"):
            img = tiff.decode(b)
        else:
            raise ValueError("no decoder for this format")
    except (struct.error, zlib.error, KeyError, IndexError, TypeError) as e:
        raise ValueError(f"broken image: {e}") from e
    if img.dtype != np.uint8:
        img = (img * (255.0 / max(1, int(img.max(initial=0))))).astype(np.uint8)
    return np.ascontiguousarray(img)


def encode_png(bgr: np.ndarray) -> bytes:
    """8-bit RGB PNG."""
    h, w = bgr.shape[:2]
    raw = np.zeros((h, 1 + w * 3), np.uint8)
    raw[:, 1:] = bgr[..., ::-1].reshape(h, -1)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")
