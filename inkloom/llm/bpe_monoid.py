"""Byte-level BPE encoding and decoding by tree reduction.

A token sequence is an element of a monoid whose product is "encode the
concatenation". encode() halves a byte string until the parts are single bytes
or short, then joins neighbours: the last tokens of the left part and the first
of the right are encoded again as one window, which grows on either side until
it gives back, unchanged, the token at each of its inner ends with the same
merges as outside; tokens beyond such a seam can't change. decode()
concatenates up the tree: bytes of tokens, then of pieces, then of texts.

Pieces (matches of the split pattern) are independent, so texts are split
first, and each distinct piece is encoded once per worker. Both operators map
batches; there is no shuffle. Defined results: null and empty texts have no
ids; repeated rows give a row each; other columns of the input are kept.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vec
from .arrow_tokens import Kept
from .common import Memo

#: Distinct pieces in a generation of a worker's cache; a bound of memory, without effect on results.
CACHE_PIECES = 100_000
#: Parts of texts in its arrays.
CACHE_PARTS = 200_000
#: Text that is encoded at once.
SLICE_BYTES = 3 << 19
#: Bytes up to which a part is encoded by plain merging instead of being halved.
LEAF_BYTES = 16
_NONE = 1 << 60
#: Last bytes of white space, or of characters some of which are white space.
_SPACE_END = vec.table([*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])


def _merge(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """Plain BPE: merges the pair of least rank, leftmost first, until no pair has a rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    get = ranks.get
    rank = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
    while rank:
        best = min(rank)
        if best == _NONE:
            break
        i = rank.index(best)
        parts[i] += parts.pop(i + 1)
        del rank[i]
        if i:
            rank[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        if i < len(rank):
            rank[i] = get(parts[i] + parts[i + 1], _NONE)
    return parts


class Monoid:
    """Token sequences under 'encode the concatenation'."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b next to each other stay as they are. A sequence is the encoding of its bytes if and only if each adjacent pair is."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            got = self.pairs[key] = _merge(self.ranks, a + b) == [a, b]
        return got

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left or right
        i = j = 1  # tokens of either side in the window
        while True:
            mid = _merge(self.ranks, b"".join(left[-i:]) + b"".join(right[:j]))
            ok_left = i >= len(left) or self.apart(left[-i - 1], mid[0])
            ok_right = j >= len(right) or self.apart(mid[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + mid + right[j:]
            i = i if ok_left else min(len(left), i * 2)
            j = j if ok_right else min(len(right), j * 2)

    def encode(self, data: bytes) -> list[bytes]:
        if data in self.ranks:
            return [data]
        if len(data) <= self.leaf:
            return _merge(self.ranks, data)
        # leaves left to right, joined like the carries of a binary counter: the same tree, without recursion depth
        stack: list[tuple[int, list[bytes]]] = []
        for at in range(0, len(data), self.leaf):
            level, part = 0, _merge(self.ranks, data[at : at + self.leaf])
            while stack and stack[-1][0] == level:
                part, level = self.join(stack.pop()[1], part), level + 1
            stack.append((level, part))
        out = stack.pop()[1]
        while stack:
            out = self.join(stack.pop()[1], out)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Leaves:
    """Plain merging of many short byte strings at once: one numpy step merges one pair in each of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                x, y = ranks.get(t[:i]), ranks.get(t[i:])
                if x is not None and y is not None:
                    pairs[x * self.size + y] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = np.where((x < 0) | (y < 0), -1, x * self.size + y)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return self.rank[np.where(self.keys[at] == key, at, len(self.keys))]

    def encode(self, data: list[bytes]) -> list[bytes]:
        """The ids of each string as little-endian 32-bit integers."""
        raw, off = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data])))
        n = np.diff(off)
        width = int(n.max(initial=1))
        col = np.arange(width)
        ids = np.where(col < n[:, None], self.byte[raw[np.minimum(off[:-1, None] + col, len(raw) - 1)]], -1)
        rank = np.full((len(data), width), _NONE, np.int64)
        rank[:, :-1] = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(data), width - 1)
        live = np.arange(len(data))
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            ok = best < _NONE
            live, at, best = live[ok], at[ok], best[ok]
            if not len(live):
                break
            move = np.minimum(col + (col > at[:, None]), width - 1)  # what stands right of the pair moves left
            rows = live[:, None]
            new, kept = ids[rows, move], rank[rows, move]
            new[:, -1], kept[:, -1] = -1, _NONE
            here = np.arange(len(live))
            new[here, at] = best
            kept[here, at] = self.pair(best, new[here, np.minimum(at + 1, width - 1)])
            kept[here, at] = np.where(at + 1 < width, kept[here, at], _NONE)
            left = np.maximum(at - 1, 0)
            before = self.pair(new[here, left], best)
            kept[here, left] = np.where(at > 0, before, kept[here, left])
            ids[live], rank[live] = new, kept
        n = (ids >= 0).sum(axis=1)
        flat = ids[ids >= 0].astype("<i4").tobytes()
        ends = np.cumsum(n) * 4
        return [flat[a:b] for a, b in zip((ends - n * 4).tolist(), ends.tolist(), strict=True)]


class Codec:
    """Texts to ids as little-endian 32-bit integers, and back.

    A text is cut before each space that follows no white space: there the
    pattern always ends a match and starts another. So the ids of such a part
    are kept, in arrays, besides those of matches of parts with several.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.monoid = Monoid(self.ranks)
        self.forget()
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            by_id[i] = b
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.ends = np.cumsum([len(x) for x in by_id])
        self.sizes = np.array([len(x) for x in by_id], np.int64)

    @cached_property
    def leaves(self) -> Leaves:
        return Leaves(self.ranks)

    def forget(self) -> None:
        """Drops what is kept of texts, so that an idle worker holds little."""
        self.pieces, self.parts = Memo(CACHE_PIECES), Kept(CACHE_PARTS, np.dtype("<i4"))
        self.monoid.pairs.clear()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of matches: of short ones together, of others each by the tree."""
        out, short = [], []
        for i, x in enumerate(pieces):
            b = x.encode()
            r = self.ranks.get(b)
            if r is not None:
                out.append(struct.pack("<i", r))
            elif len(b) <= self.monoid.leaf:
                out.append(b)
                short.append(i)
            else:
                ids = [self.ranks[t] for t in self.monoid.encode(b)]
                out.append(struct.pack(f"<{len(ids)}i", *ids))
        if short:
            for i, x in zip(short, self.leaves.encode([out[i] for i in short]), strict=True):
                out[i] = x
        return out

    def _fresh(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and sizes of distinct parts. Letters are one match, with a space before them or not."""
        parts = parts.to_pylist()
        cut = [None if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) else self.find(x) for x in parts]
        pieces: set[str] = set()
        for x in cut:
            if x:
                pieces.update(x)
        lack = self.pieces.lack(pieces)
        self.pieces.new.update(zip(lack, self._ids(lack), strict=True))
        get = self.pieces.new.__getitem__
        alone = iter(self._ids([x for x, c in zip(parts, cut, strict=True) if c is None]))
        ids = [next(alone) if x is None else b"".join(map(get, x)) for x in cut]
        return np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)"""
        raw, off = vec.buffers(texts)
        start = np.zeros(len(raw) + 1, bool)
        start[1:-1] = (raw[1:] == 0x20) & ~_SPACE_END[raw[:-1]]
        start[off] = True
        start = np.flatnonzero(start)  # the last one is the end
        parts = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start), pa.py_buffer(raw)).dictionary_encode()
        flat, begin, size = self.parts.get(parts.dictionary, self._fresh)
        of = parts.indices.to_numpy()
        size = size[of]
        ends = np.concatenate(([0], np.cumsum(size)))
        return flat[vec.ranges(begin[of], size)], ends[np.searchsorted(start, off)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, off = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        return self.bytes[vec.ranges(self.ends[ids] - n, n)]


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(texts: pa.Array, c: Codec) -> pa.Array:
    """A list<int32> array of ids."""
    ids, off = c.encode_column(texts)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))


def decode_ids(ids: pa.ListArray, c: Codec) -> pa.Array:
    """A binary array of the decoded bytes; null ids give empty bytes."""
    if ids.null_count:
        ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
    off, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    flat = flat[off[0] : off[-1]]
    size = np.concatenate(([0], np.cumsum(c.sizes[flat])))
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(size[off - off[0]].astype(np.int32).tobytes()), pa.py_buffer(c.decode(flat).tobytes())])


def _rows(batch: pa.RecordBatch, source: str) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, 500) for at in range(0, batch.num_rows, 500))


def _bytes(batch: pa.RecordBatch, source: str) -> Iterator[pa.RecordBatch]:
    return vec.slices(batch, SLICE_BYTES, source)


def _map(df: DataFrame, source: str, column: str, kind: T.DataType, f, pieces=_rows, end=lambda: None) -> DataFrame:
    """The frame with one more column, made of `source` batch by batch."""
    common.batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch, source):
                yield pa.RecordBatch.from_arrays([*part.columns, f(part.column(part.schema.get_field_index(source)))], names=[*part.schema.names, column])
        end()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, kind)]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column `ids` (array of int); a column of that name is replaced."""
    return _map(df.drop(ids), text, ids, T.ArrayType(T.IntegerType()), lambda col: encode_texts(col, codec(path, pattern)), _bytes, lambda: codec(path, pattern).forget())


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the column `decoded` (binary); a column of that name is replaced."""
    return _map(df.drop(decoded), ids, decoded, T.BinaryType(), lambda col: decode_ids(col, codec(path, pattern)))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    path, pattern = vocabulary()
    both = decode(encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
