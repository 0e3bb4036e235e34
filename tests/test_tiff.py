import struct
import zlib

import numpy as np
import pytest

from inkloom.sources.images import decode


def lzw(data):
    """An encoder with the early change of code width that the format has."""
    acc, bits, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word], width)
        table[word + c] = len(table) + 2
        size = len(table) + 2
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = c
        if size >= 4094:
            put(table[word], width)
            put(256, 12)
            table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    if word:
        put(table[word], width)
    size = len(table) + 3
    put(257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12)
    put(0, 8)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def encode(img, packed=1, order="<", meaning=None, rows=7, predictor=1, tile=0, palette=None):
    h, w = img.shape[:2]
    samples = 1 if img.ndim == 2 else img.shape[2]
    x = img.reshape(h, w, samples)
    parts = [x[y : y + rows] for y in range(0, h, rows)]
    if tile:
        x = np.pad(x, ((0, -h % tile), (0, -w % tile), (0, 0)))
        parts = [x[a : a + tile, b : b + tile] for a in range(0, h, tile) for b in range(0, w, tile)]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1) for p in parts]
    strips = [PACK[packed](p.astype(p.dtype.newbyteorder(order)).tobytes()) for p in parts]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [img.itemsize * 8] * samples), 259: ("H", [packed]), 262: ("H", [meaning if meaning is not None else 2 if samples > 2 else 1]), 277: ("H", [samples]), 317: ("H", [predictor])}
    tags |= {322: ("I", [tile]), 323: ("I", [tile])} if tile else {278: ("I", [rows])}
    body, where = b"".join(strips), 8
    offsets = [where + sum(map(len, strips[:i])) for i in range(len(strips))]
    tags |= {324 if tile else 273: ("I", offsets), 325 if tile else 279: ("I", [len(s) for s in strips])}
    if palette is not None:
        tags[320] = ("H", palette)
    extra, entries, start = b"", b"", 8 + len(body)
    for tag, (form, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", start + len(extra)), extra + raw
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + raw.ljust(4, b"\0")
    at = start + len(extra)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + body + extra + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4


def picture(h, w, seed=0):
    r = np.random.default_rng(seed)
    return (np.cumsum(r.integers(-3, 4, (h, w, 3)), axis=1) + 128).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("packed", [1, 5, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(packed, order):
    img = picture(60, 83)
    assert (decode(encode(img, packed, order))[..., ::-1] == img).all()
    assert (decode(encode(img, packed, order, predictor=2, rows=60))[..., ::-1] == img).all()
    assert (decode(encode(img, packed, order, tile=32))[..., ::-1] == img).all()
    gray = img[..., 0]
    assert (decode(encode(gray, packed, order))[..., 1] == gray).all()
    assert (decode(encode(gray, packed, order, meaning=0))[..., 1] == 255 - gray).all()


def test_sixteen_bits_and_palette():
    deep = (np.arange(600).reshape(20, 30) * 100).astype(np.uint16)
    for order in "<>":
        got = decode(encode(deep, order=order))
        assert got.dtype == np.uint8 and (got[..., 0] == (deep * (255 / deep.max())).astype(np.uint8)).all()
    index = (np.arange(200) % 4).reshape(10, 20).astype(np.uint8)
    palette = [c * 257 for k in range(3) for c in [(10 + 50 * k + 9 * i) % 256 for i in range(256)]]
    assert decode(encode(index, meaning=3, palette=palette))[0, 1].tolist() == [119, 69, 19]


def test_broken_files():
    good = encode(picture(20, 20), 5)
    for bad in (good[:40], good[:8], b"II*\0", encode(picture(20, 20))[:-40], good[:8] + b"\xff" * 60 + good[68:]):
        with pytest.raises(ValueError):
            decode(bad)
