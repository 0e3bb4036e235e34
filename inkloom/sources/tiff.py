"""TIFF (first image, strips or tiles; uncompressed, PackBits, LZW or deflate; gray, RGB, palette) without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIZES = {1: "B", 3: "H", 4: "I"}


def _packbits(b: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(b):
        n = b[at]
        if n < 128:
            out += b[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += b[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def _lzw(b: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, last, width, acc, bits = [], [], b"", 9, 0, 0
    for byte in b:
        acc, bits = (acc << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table):
            raise ValueError("broken LZW code")
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def decode(b: bytes) -> np.ndarray:
    """Gray, or blue, green, red; 8 or 16 bits as in the file."""
    order = {b"II*\0": "<", b"MM\0*": ">"}[b[:4]]
    (at,) = struct.unpack(order + "I", b[4:8])
    (n,) = struct.unpack(order + "H", b[at : at + 2])
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", b[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in _SIZES:
            form = f"{order}{count}{_SIZES[kind]}"
            size, where = struct.calcsize(form), at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack(order + "I", b[where : where + 4])
            tags[tag] = struct.unpack(form, b[where : where + size])
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, depth, packed, meaning, samples, layout = one(256, 0), one(257, 0), one(258, 1), one(259, 1), one(262, 1), one(277, 1), one(284, 1)
    if packed not in _UNPACK or depth not in (1, 8, 16) or meaning not in (0, 1, 2, 3) or (layout != 1 and samples > 1) or (depth == 1 and samples > 1) or one(339, 1) != 1 or not width or not height:
        raise ValueError("TIFF of this kind")
    tiled = 322 in tags
    wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // wide), -(-height // high)
    line = (wide * samples * depth + 7) // 8
    dtype = np.dtype(order + "u2") if depth == 16 else np.dtype(np.uint8)
    img = np.zeros((down * high, across * wide, samples), np.uint16 if depth == 16 else np.uint8)
    for i, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = i // across * high, i % across * wide
        rows = high if tiled else min(high, height - y)
        raw = np.frombuffer(_UNPACK[packed](b[start : start + size]), np.uint8)
        if len(raw) < rows * line:
            raise ValueError("truncated TIFF")
        part = raw[: rows * line].reshape(rows, line)
        part = np.unpackbits(part, axis=1)[:, :wide, None] * np.uint8(255) if depth == 1 else part.reshape(-1).view(dtype).reshape(rows, wide, samples).astype(img.dtype)
        if one(317, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=img.dtype)
        img[y : y + rows, x : x + wide] = part
    img = img[:height, :width]
    if meaning == 3:
        palette = (np.array(tags[320]) >> 8).astype(np.uint8).reshape(3, -1).T
        return palette[img[..., 0]][..., ::-1]
    if meaning == 0:
        img = np.iinfo(img.dtype).max - img
    return img[..., :3][..., ::-1] if meaning == 2 else np.repeat(img[..., :1], 3, axis=2)
