"""Baseline JPEG (Huffman-coded, sequential, 8 bits) without an image library.

Entropy-coded bits are read by tables of 16-bit prefixes; all blocks of a
component are then dequantised and transformed as one array. Sub-sampled
components are repeated. Progressive, lossless and arithmetic-coded files are
a ValueError.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Where the k-th coefficient of a scan stands in a block: along the diagonals, up and down in turn.
ZIGZAG = np.array([y * 8 + x for _, _, y, x in sorted((x + y, x if (x + y) % 2 == 0 else y, y, x) for y in range(8) for x in range(8))])
_K = np.arange(8)
#: The cosine transform's matrix: rows are frequencies.
DCT = np.cos((2 * _K + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of the code that each 16-bit number begins with; length 0 where none does."""
    out: list[tuple[int, int]] = []
    k = 0
    for length in range(1, 17):
        for s in symbols[k : k + counts[length - 1]]:
            out += [(length, s)] * (1 << 16 - length)
        k += counts[length - 1]
    return (out + [(0, 0)] * (65536 - len(out)))[:65536]


class Component:
    def __init__(self, ident: int, sampling: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, sampling >> 4, sampling & 15, quant
        self.dc: list = []
        self.ac: list = []
        self.wide = 0
        self.blocks = np.zeros((0, 64), np.int32)


def _scan(raw: bytes, comps: list[Component], rows: int, cols: int, restart: int) -> None:
    """Fills the components' blocks. rows, cols: of units that hold all components' blocks, or of blocks for a single component."""
    pieces = re.split(rb"\xff+[\xd0-\xd7]", raw)
    alone = len(comps) == 1
    flat = [[0] * c.blocks.size for c in comps]
    per = restart or rows * cols
    zig = ZIGZAG.tolist()
    for at, piece in enumerate(pieces):
        data = piece.replace(b"\xff\x00", b"\xff")
        size, pos, acc, n = len(data), 0, 0, 0
        last = [0] * len(comps)
        for unit in range(at * per, min((at + 1) * per, rows * cols)):
            uy, ux = divmod(unit, cols)
            for i, c in enumerate(comps):
                dc, ac, out = c.dc, c.ac, flat[i]
                for b in range(1 if alone else c.h * c.v):
                    base = (uy * c.wide + ux if alone else (uy * c.v + b // c.h) * c.wide + ux * c.h + b % c.h) * 64
                    k = 0
                    while k < 64:
                        if n < 32:
                            word = data[pos : pos + 8]
                            pos += 8
                            if len(word) < 8:
                                if pos > size + 64:
                                    raise ValueError("truncated JPEG")
                                word = word.ljust(8, b"\0")
                            acc = (acc & (1 << n) - 1) << 64 | int.from_bytes(word, "big")
                            n += 64
                        length, symbol = (ac if k else dc)[acc >> n - 16 & 0xFFFF]
                        if not length:
                            raise ValueError("broken JPEG code")
                        n -= length
                        bits = symbol & 15
                        if k:
                            if not bits:
                                if symbol != 0xF0:
                                    break
                                k += 16
                                continue
                            k += symbol >> 4
                            if k > 63:
                                raise ValueError("broken JPEG block")
                        value = 0
                        if bits:
                            n -= bits
                            value = acc >> n & (1 << bits) - 1
                            if not value >> bits - 1:
                                value -= (1 << bits) - 1
                        if k:
                            out[base + zig[k]] = value
                        else:
                            last[i] += value
                            out[base] = last[i]
                        k += 1
    for c, x in zip(comps, flat, strict=True):
        c.blocks = np.array(x, np.int32).reshape(-1, 64)


def decode(b: bytes) -> np.ndarray:
    """8-bit BGR."""
    at, quants, tables, comps, restart, adobe, seen = 2, {}, {}, {}, 0, None, set()
    height = width = 0
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise ValueError("broken JPEG marker")
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        (n,) = struct.unpack(">H", b[at + 2 : at + 4])
        body = b[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                deep = 1 + (body[0] >> 4 > 0)
                q = np.frombuffer(body, ">u2" if deep == 2 else np.uint8, 64, 1).astype(np.float64)
                quants[body[0] & 15] = np.zeros(64)
                quants[body[0] & 15][ZIGZAG] = q
                body = body[1 + 64 * deep :]
        elif kind == 0xC4:
            while body:
                many = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif kind in (0xC0, 0xC1):
            bits, height, width, many = struct.unpack(">BHHB", body[:6])
            if bits != 8 or many not in (1, 3) or not height or not width:
                raise ValueError("JPEG of this kind")
            comps = {body[6 + 3 * i]: Component(*body[6 + 3 * i : 9 + 3 * i]) for i in range(many)}
            most_h, most_v = max(c.h for c in comps.values()), max(c.v for c in comps.values())
            units = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for c in comps.values():
                c.wide = units[0] * c.h
                c.blocks = np.zeros((c.wide * units[1] * c.v, 64), np.int32)
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("progressive, lossless or arithmetic JPEG")
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            mine = []
            for i in range(body[0]):
                c = comps[body[1 + 2 * i]]
                c.dc, c.ac = tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]
                mine.append(c)
            end = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S).search(b, at)
            raw = b[at : end.start() if end else len(b)]
            if len(mine) == 1:
                c = mine[0]
                _scan(raw, mine, -(-height * c.v // (8 * most_v)), -(-width * c.h // (8 * most_h)), restart)
            else:
                _scan(raw, mine, units[1], units[0], restart)
            seen |= {c.ident for c in mine}
            at = end.start() if end else len(b)
    if not comps or len(seen) < len(comps):
        raise ValueError("JPEG without image")
    planes = []
    for c in comps.values():
        x = (c.blocks * quants[c.quant]).reshape(-1, c.wide, 8, 8)
        x = np.einsum("ki,rckl,lj->ricj", DCT, x, DCT, optimize=True).reshape(-1, c.wide * 8) + 128
        if most_v % c.v or most_h % c.h:
            raise ValueError("JPEG sampling of this kind")
        planes.append(x.repeat(most_v // c.v, axis=0).repeat(most_h // c.h, axis=1)[:height, :width])
    if len(planes) == 1:
        rgb = np.stack(planes * 3, axis=2)
    elif adobe == 0:
        rgb = np.stack(planes, axis=2)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)[..., ::-1]
