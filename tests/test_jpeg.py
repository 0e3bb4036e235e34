import struct

import numpy as np
import pytest

from inkloom.sources import jpeg
from inkloom.sources.images import decode


class Bits:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def put(self, value, n):
        self.acc, self.n = self.acc << n | value, self.n + n
        while self.n >= 8:
            self.n -= 8
            byte = self.acc >> self.n & 255
            self.out += bytes([byte, 0]) if byte == 255 else bytes([byte])
        self.acc &= (1 << self.n) - 1

    def end(self):
        if self.n:
            self.put((1 << 8 - self.n) - 1, 8 - self.n)
        data, self.out = bytes(self.out), bytearray()
        return data


def encode(rgb, sampling=((1, 1),) * 3, restart=0, quant=1):
    """A baseline file with flat code tables: all 8-bit symbols but two have codes of 8 bits."""
    h, w = rgb.shape[:2]
    gray = rgb.ndim == 2
    x = rgb.astype(float)
    planes = [x] if gray else [0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2], 128 - 0.168736 * x[..., 0] - 0.331264 * x[..., 1] + 0.5 * x[..., 2], 128 + 0.5 * x[..., 0] - 0.418688 * x[..., 1] - 0.081312 * x[..., 2]]
    sampling = sampling[: len(planes)]
    mh, mv = max(a for a, _ in sampling), max(b for _, b in sampling)
    cols, rows = -(-w // (8 * mh)), -(-h // (8 * mv))
    blocks = []
    for p, (sh, sv) in zip(planes, sampling, strict=True):
        p = np.pad(p, ((0, rows * 8 * mv - h), (0, cols * 8 * mh - w)), mode="edge")
        p = p.reshape(p.shape[0] * sv // mv, mv // sv, p.shape[1] * sh // mh, mh // sh).mean(axis=(1, 3)) - 128
        b = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        blocks.append(np.round(jpeg.DCT @ b @ jpeg.DCT.T / quant).astype(int).reshape(*b.shape[:2], 64)[..., jpeg.ZIGZAG])
    symbols = [s for s in range(256) if s not in (0xFE, 0xFF)]
    code = {s: i for i, s in enumerate(symbols)}
    bits, body, last, number = Bits(), b"", [0] * len(planes), 0
    size = lambda v: int(abs(v)).bit_length()
    amount = lambda v: v if v > 0 else v + (1 << size(v)) - 1
    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            body += bits.end() + bytes([0xFF, 0xD0 + number % 8])
            number, last = number + 1, [0] * len(planes)
        uy, ux = divmod(unit, cols)
        for i, (sh, sv) in enumerate(sampling):
            for k in range(sh * sv):
                c = blocks[i][uy * sv + k // sh, ux * sh + k % sh].tolist()
                d, last[i] = c[0] - last[i], c[0]
                bits.put(code[size(d)], 8)
                bits.put(amount(d), size(d)) if d else None
                zeros = 0
                for v in c[1 : max([j for j in range(64) if c[j]], default=0) + 1]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        bits.put(code[0xF0], 8)
                        zeros -= 16
                    bits.put(code[zeros << 4 | size(v)], 8)
                    bits.put(amount(v), size(v))
                    zeros = 0
                if not c[63]:
                    bits.put(code[0], 8)
    body += bits.end()
    part = lambda tag, b: bytes([0xFF, tag]) + struct.pack(">H", len(b) + 2) + b
    n = len(planes)
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, bytes([0]) + bytes([quant] * 64)) + part(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)))
    for table in (0, 0x10):
        out += part(0xC4, bytes([table]) + bytes([0] * 7 + [254] + [0] * 8) + bytes(symbols))
    out += part(0xDD, struct.pack(">H", restart)) if restart else b""
    return out + part(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + body + b"\xff\xd9"


def picture(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), 60 + (x + y) % 120 / 2], axis=2).astype(np.uint8)


def test_zigzag():
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64)) and jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]


@pytest.mark.parametrize(("shape", "sampling", "restart"), [((40, 56), ((1, 1),) * 3, 0), ((37, 51), ((1, 1),) * 3, 3), ((64, 64), ((2, 2), (1, 1), (1, 1)), 0), ((33, 70), ((2, 1), (1, 1), (1, 1)), 2), ((1, 1), ((1, 1),) * 3, 0)])
def test_round_trip(shape, sampling, restart):
    rgb = picture(*shape)
    got = decode(encode(rgb, sampling, restart))[..., ::-1].astype(int)
    assert got.shape == rgb.shape
    off = np.abs(got - rgb)
    assert off.max() <= 3 if sampling[0] == (1, 1) else off.mean() < 8


def test_gray_and_quantised():
    gray = picture(50, 60)[..., 0]
    got = decode(encode(gray)).astype(int)
    assert (got[..., 0] == got[..., 2]).all() and np.abs(got[..., 0] - gray).max() <= 2
    assert np.abs(decode(encode(gray, quant=8)).astype(int)[..., 0] - gray).mean() < 6


def test_broken_files():
    good = encode(picture(24, 24))
    for bad in (good[:30], good[:200], good[: len(good) // 2], b"\xff\xd8\xff", good.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            decode(bad)
