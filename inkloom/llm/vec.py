"""Vectorised text kernels: words, hashes and windows of a whole Arrow column at once.

All functions work on the column's UTF-8 bytes without making a Python object
per word, so a batch costs a few passes of numpy over its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(keep) -> np.ndarray:
    """Byte-class table: True where a byte belongs to a word."""
    t = np.zeros(256, bool)
    for b in keep:
        t[b] = True
    return t


#: Words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
NON_SPACE = table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words are runs of a-z, A-Z, 0-9 and non-ASCII: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ before lower-casing.
ALNUM = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    lo, hi = int(off[0]), int(off[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, off - lo


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other byte changes."""
    return _LOWER[raw]


def words(raw: np.ndarray, off: np.ndarray, keep: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; those of text i are first[i] to first[i + 1]. No word spans two texts."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = keep[raw]
    st = m.copy()
    st[1:] &= ~m[:-1]
    cut = off[1:-1]
    cut = cut[cut < n]
    st[cut] = m[cut]
    en = np.empty(n, bool)
    en[-1] = m[-1]
    en[:-1] = m[:-1] & ~m[1:]
    inner = cut[cut > 0]
    en[inner - 1] = m[inner - 1]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(starts, off)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, little-endian; past the end come zeros."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 256


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, alike wherever the range lies: eight bytes at a time, mixed after each."""
    size = ends - starts
    word = eights(raw)
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ (word[starts] & _HEAD[np.minimum(size, 8)]))
    at = np.flatnonzero(size > 8)
    for done in range(8, LONG_WORD, 8):
        if not len(at):
            return h
        h[at] = mix(h[at] ^ (word[starts[at] + done] & _HEAD[np.minimum(size[at] - done, 8)]))
        at = at[size[at] > done + 8]
    for i in at.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _steps(k: int) -> list[int]:
    """Offsets of the eights that cover k bytes."""
    return [*range(0, k - 7, 8), *([k - 8] if k % 8 and k > 8 else [])] or [0]


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on; the high bits are the best."""
    n = max(0, len(raw) - k + 1)
    word, out = eights(raw), np.zeros(n, np.uint64)
    for i, step in enumerate(_steps(k)):
        x = word[step : step + n] & _HEAD[min(k, 8)]
        x ^= x >> np.uint64(29)
        x *= _ODD[i % 8]
        out += x
        out *= _ODD[3]
        out ^= out >> np.uint64(32)
    out *= _ODD[4]
    return out


def byte_prints(raw: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each of the positions on."""
    word, out = eights(raw), np.full(len(at), k, np.uint64)
    for step in _steps(k):
        out = mix(out ^ (word[at + step] & _HEAD[min(k, 8)]))
    return out


def owner(first: np.ndarray) -> np.ndarray:
    """The text's index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (also across texts: mask with whole())."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[j : j + n]
    return mix(out)


def whole(own: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k items lie in one text."""
    n = len(own) - k + 1
    return own[:n] == own[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


def cover(hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of k items that starts where hit is True."""
    d = np.zeros(n + k + 1, np.int32)
    d[: len(hit)] += hit
    d[k : k + len(hit)] -= hit
    return np.cumsum(d[:n]) > 0


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges start, start + 1, ... in one array."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def slices(batch, limit: int = 4 << 20, column: str | int = "text"):
    """A batch or table in pieces whose texts have about limit bytes; a longer text is a piece of its own."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = buffers(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
