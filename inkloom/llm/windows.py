"""Windows of L units (words or bytes) that also start in a document with a smaller doc_id.

Documents are dealt out to chunks of a few MB; that one shuffle of texts serves
three readings of it.

1. A chunk samples its windows by minimisers: the anchor of a window is the
   least hash of the K-unit grams in it, so equal windows have equal anchors,
   and neighbouring windows mostly share one. Consecutive windows of one anchor
   make a run (of L windows at most). Runs are named by their content, so equal
   runs have one name wherever they lie. The distinct (anchor, name) pairs of a
   chunk leave it, to buckets of anchors.
2. A bucket answers which of them two runs or more have an anchor in common
   with, and asks one chunk, the first that has it, for the content of each
   named run; all chunks send the least and the largest doc_id that a run has.
   So of a text, however many copies it has, one travels.
3. With the content of all its runs, the bucket's resolver (the operator's own
   method) finds equal windows, and the documents that they are in: all
   decisions are made there, also those within a chunk. The answers come back
   to the chunks, where the units that windows cover are marked.

An anchor with HOT_NAMES runs or more of different content has its windows
dealt out singly, by their own hash, so that what meets in one bucket is one
window. Groups are bounded by the size of a chunk or bucket, and the number of
both follows the input; rows between them are never more than the keys that
chunks have. A null doc_id counts as larger than all others. Rows of one chunk
come by a hash of doc_id, text and the partition that they are read from, so
neither many rows of one doc_id nor many equal rows meet in one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

#: From so many different runs on, the windows of an anchor are dealt out singly.
HOT_NAMES = 4096
LAST = np.iinfo(np.int64).max
#: Bytes of an anchor and of a name that travel.
ANCHOR, NAME = 5, 6
APART, SHARED, ASKED, HOT = 0, 1, 2, 3
SENT = "chunk int, bucket int, anchors binary, names binary, several binary"
ASKS = "chunk int, bucket int, state binary"
GIVEN = "chunk int, bucket int, least binary, more binary, sizes binary, content binary"
FOUND = "chunk int, bucket int, state binary, earlier binary, other binary"


def pack(x: np.ndarray) -> bytes:
    return pack_bytes(np.ascontiguousarray(x).tobytes())


def pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def unpack_bytes(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True) if b else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(unpack_bytes(b), dtype)


def narrow(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def wide(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in a column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


class Keys:
    """Distinct (anchor, name) pairs of items, by buckets: key of each item (in the order of `order`), and each key's least and largest id."""

    def __init__(self, ids: np.ndarray, anchor: np.ndarray, name: np.ndarray, buckets: int, base: int = 0):
        major = vec.mix(anchor)
        order = np.argsort(major)
        sort = major[order]
        # the few that share an anchor are put in order by name
        same = np.zeros(len(sort) + 1, bool)
        same[1:-1] = sort[1:] == sort[:-1]
        at = np.flatnonzero(same[1:] | same[:-1])
        order[at] = order[at][np.lexsort((name[order[at]], sort[at]))]
        self.order, name = order, name[order]
        new = _heads(sort, name)
        head = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.rep, self.anchor, self.name = order[head], anchor[order[head]], name[head]
        self.bucket = base + ((sort[head] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ids = ids[order]
        self.least = np.minimum.reduceat(ids, head) if len(head) else ids
        self.most = np.maximum.reduceat(ids, head) if len(head) else ids

    def buckets(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the keys."""
        at = np.flatnonzero(_heads(self.bucket))
        return list(zip(self.bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(self.rep)] if len(at) else [], strict=True))


class Units:
    """The units of a chunk's texts, and the runs of their windows."""

    def __init__(self, t: pa.Table, kind: str, size: int, k: int):
        self.kind, self.size = kind, size
        self.raw, self.off = vec.buffers(t.column("text"))
        ids = t.column("doc_id")
        self.ids = np.where(np.asarray(ids.is_null()), LAST, ids.fill_null(0).to_numpy())
        if kind == "bytes":
            self.first, self.count = self.off, len(self.raw)
            low = self._low_bytes(k)
        else:
            self.starts, self.ends, self.first = vec.words(self.raw, self.off)
            self.count = len(self.starts)
            h = vec.span_hashes(self.raw, self.starts, self.ends)
            self.all_prints = vec.grams(h, size)
            low = vec.sliding_min(vec.grams(h, k) >> np.uint64(24), size - k + 1)
        # maximal runs of one anchor within a text, cut into pieces of at most `size` windows
        n = len(low)
        new = _heads(low)
        new[self.first[self.first < n]] = True
        head = np.flatnonzero(new)
        own = np.searchsorted(self.first, head, side="right") - 1
        stop = np.minimum(np.append(head[1:], n), self.first[own + 1] - size + 1)
        ok = stop > head
        head, own, m = head[ok], own[ok], (stop - head)[ok]
        pieces = -(-m // size)
        nth = vec.ranges(np.zeros(len(m), np.int64), pieces)
        self.start = np.repeat(head, pieces) + nth * size
        self.windows = np.minimum(np.repeat(m, pieces) - nth * size, size)
        self.anchor = low[self.start]
        self.doc = self.ids[np.repeat(own, pieces)]

    def _low_bytes(self, k: int) -> np.ndarray:
        """Anchors of all windows, in blocks that fit in a processor's cache."""
        n, span = max(0, len(self.raw) - self.size + 1), self.size - k + 1
        out = np.empty(n, np.uint64)
        for at in range(0, n, 1 << 16):
            to = min(n, at + (1 << 16))
            out[at:to] = vec.sliding_min(vec.byte_grams(self.raw[at : to + self.size - 1], k) >> np.uint64(24), span)
        return out

    def prints(self, at: np.ndarray) -> np.ndarray:
        """A hash of the window at each position."""
        return vec.byte_prints(self.raw, at, self.size) if self.kind == "bytes" else self.all_prints[at]

    def runs(self, buckets: int) -> Keys:
        """The distinct runs by anchor and name. A run's first and last window hold all of its content."""
        name = self.prints(self.start) * np.uint64(0x9E3779B97F4A7C15) ^ self.prints(self.start + self.windows - 1)
        name = vec.mix(name + self.windows.astype(np.uint64)) & np.uint64((1 << 8 * NAME) - 1)
        return Keys(self.doc, self.anchor, name, buckets)

    def singles(self, pieces: np.ndarray, buckets: int) -> tuple[Keys, np.ndarray]:
        """The distinct windows of some pieces by their hash, in buckets of their own; and the windows' positions."""
        at = vec.ranges(self.start[pieces], self.windows[pieces])
        p = self.prints(at)
        return Keys(np.repeat(self.doc[pieces], self.windows[pieces]), p, p, buckets, buckets), at

    def content(self, start: np.ndarray, m: np.ndarray) -> bytes:
        """What a resolver needs of m windows each from start."""
        if self.kind == "bytes":
            return self.raw[vec.ranges(start, m + self.size - 1)].tobytes()
        return self.all_prints[vec.ranges(start, m)].tobytes()


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int32() if n in ("chunk", "bucket") else pa.binary()) for n, c in zip(names, cols, strict=True)})


def _send(key: tuple, t: pa.Table, kind: str, size: int, k: int, buckets: int) -> pa.Table:
    runs, chunk = Units(t, kind, size, k).runs(buckets), key[0].as_py()
    several = runs.least < runs.most
    return _table([(chunk, b, narrow(runs.anchor[i:j], ANCHOR), narrow(runs.name[i:j], NAME), np.packbits(several[i:j]).tobytes()) for b, i, j in runs.buckets()], SENT)


class Board:
    """What a bucket knows of the keys of all chunks: their number by chunk, and for each key its state and run."""

    def __init__(self, t: pa.Table, hot: int):
        t = t.sort_by("chunk")
        self.chunks = t.column("chunk").to_pylist()
        anchors = [wide(x.as_py(), ANCHOR) for x in t.column("anchors")]
        self.sizes = np.array([len(x) for x in anchors], np.int64)
        anchor = np.concatenate([np.zeros(0, np.uint64), *anchors])
        name = np.concatenate([np.zeros(0, np.uint64), *(wide(x.as_py(), NAME) for x in t.column("names"))])
        several = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(t.column("several"), self.sizes.tolist(), strict=True))])
        order = np.lexsort((name, anchor))
        a, s = anchor[order], name[order]
        group, run = np.cumsum(_heads(a)) - 1, _heads(a, s)
        count = np.bincount(group)
        shared = ((count > 1) | (np.bincount(group, weights=several[order]) > 0))[group]
        state = np.where(shared, np.where(run, ASKED, SHARED), APART)
        state[(np.bincount(group, weights=run) >= hot)[group]] = HOT
        self.state, self.run = np.empty(len(a), np.uint8), np.empty(len(a), np.int64)
        self.state[order] = state
        self.run[order] = np.cumsum(run) - 1

    def by_chunk(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        at = np.concatenate(([0], np.cumsum(self.sizes))).tolist()
        return [(c, self.state[i:j], self.run[i:j]) for c, i, j in zip(self.chunks, at[:-1], at[1:], strict=True)]


def _ask(key: tuple, t: pa.Table, hot: int) -> pa.Table:
    return _table([(c, key[0].as_py(), pack(state)) for c, state, _ in Board(t, hot).by_chunk() if state.any()], ASKS)


def _state(runs: Keys, rows: pa.Table) -> np.ndarray:
    """The state of each key of a chunk, from its buckets' answers."""
    answer = {b.as_py(): unpack(x.as_py(), np.uint8) for b, x in zip(rows.column("bucket"), rows.column("state"), strict=True) if x.as_py()}
    return np.concatenate([np.zeros(0, np.uint8), *(answer.get(b, np.zeros(j - i, np.uint8)) for b, i, j in runs.buckets())])


def _give(key: tuple, t: pa.Table, asks: pa.Table, kind: str, size: int, k: int, buckets: int) -> pa.Table:
    if not t.num_rows or not asks.num_rows:
        return _table([], GIVEN)
    u, chunk, out = Units(t, kind, size, k), key[0].as_py(), []
    runs = u.runs(buckets)
    state = _state(runs, asks)
    for b, i, j in runs.buckets():
        here = i + np.flatnonzero((state[i:j] == SHARED) | (state[i:j] == ASKED))
        if state[i:j].any():
            asked = runs.rep[here[state[here] == ASKED]]
            m = u.windows[asked]
            out.append((chunk, b, pack(runs.least[here]), pack(runs.most[here] - runs.least[here]), pack(m.astype(np.uint8)), pack_bytes(u.content(u.start[asked], m))))
    hot = np.sort(runs.order[state[runs.of] == HOT])
    if len(hot):
        one, at = u.singles(hot, buckets)
        for b, i, j in one.buckets():
            out.append((chunk, b, pack(one.least[i:j]), pack(one.most[i:j] - one.least[i:j]), pack(np.ones(j - i, np.uint8)), pack_bytes(u.content(at[one.rep[i:j]], np.ones(j - i, np.int64)))))
    return _table(out, GIVEN)


def _resolve(key: tuple, sent: pa.Table, given: pa.Table, size: int, buckets: int, hot: int, resolver: Callable) -> pa.Table:
    """For the runs of each chunk: which of their windows an earlier document has, and which another has."""
    if not given.num_rows:
        return _table([], FOUND)
    bucket = key[0].as_py()
    by = {r["chunk"]: r for r in given.to_pylist()}
    least = {c: unpack(r["least"], np.int64) for c, r in by.items()}
    if bucket < buckets:
        rows = [x for x in Board(sent, hot).by_chunk() if x[0] in by]
    else:  # single windows: each is a run of its own
        at = np.cumsum([0] + [len(x) for x in least.values()])
        rows = [(c, np.full(len(x), ASKED, np.uint8), np.arange(i, i + len(x))) for (c, x), i in zip(least.items(), at, strict=False)]
    n = 1 + max(int(run.max()) for _, _, run in rows)
    m, lo, hi = np.zeros(n, np.int64), np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    content: list[tuple[int, bytes]] = []
    for c, state, run in rows:
        live = run[(state == SHARED) | (state == ASKED)]
        np.minimum.at(lo, live, least[c])
        np.maximum.at(hi, live, least[c] + unpack(by[c]["more"], np.int64))
        m[run[state == ASKED]] = unpack(by[c]["sizes"], np.uint8)
        content.append((run[state == ASKED], unpack_bytes(by[c]["content"])))
    # content in the order in which it came: runs are numbered anew
    came = np.concatenate([x for x, _ in content])
    number = np.zeros(n, np.int64)
    number[came] = np.arange(len(came))
    m, lo, hi = m[came], lo[came], hi[came]
    first, last = resolver(m, lo, hi, b"".join(x for _, x in content), size) if len(came) else (m, m)
    begin = np.cumsum(m) - m
    out = []
    for c, state, run in rows:
        mine = number[run[(state == SHARED) | (state == ASKED)]]
        at, doc = vec.ranges(begin[mine], m[mine]), np.repeat(least[c], m[mine])
        out.append((c, bucket, pack(state) if bucket < buckets else b"", pack(np.packbits(first[at] < doc)), pack(np.packbits((first[at] < doc) | (last[at] > doc)))))
    return _table(out, FOUND)


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of n units lie in a window that starts at one of the positions."""
    hit = np.zeros(n, bool)
    hit[at] = True
    return vec.cover(hit, size, n)


def _marks(t: pa.Table, found: pa.Table, kind: str, size: int, k: int, buckets: int) -> tuple[Units, np.ndarray, np.ndarray]:
    """The chunk's units: which lie in a window that an earlier document has, and which in one that another has."""
    u = Units(t, kind, size, k)
    none = np.zeros(u.count, bool)
    if not found.num_rows:
        return u, none, none.copy()
    runs = u.runs(buckets)
    state = _state(runs, found)
    bits = {r["bucket"]: (unpack(r["earlier"], np.uint8), unpack(r["other"], np.uint8)) for r in found.select(["bucket", "earlier", "other"]).to_pylist()}
    earlier, other = [], []

    def mark(keys: Keys, live: np.ndarray, start: np.ndarray, m: np.ndarray, doc: np.ndarray) -> None:
        """start, m, doc: of the items that have keys; live: of the keys that were resolved."""
        width = np.where(live, m[keys.rep], 0)
        begin = np.concatenate(([0], np.cumsum(width)))
        flags = [np.zeros(begin[-1], bool) for _ in range(2)]
        for b, i, j in keys.buckets():
            if b in bits and begin[j] > begin[i]:
                for f, x in zip(flags, bits[b], strict=True):
                    f[begin[i] : begin[j]] = np.unpackbits(x, count=int(begin[j] - begin[i]))
        keep = live[keys.of]
        item, of = keys.order[keep], keys.of[keep]
        where, from_ = vec.ranges(start[item], m[item]), vec.ranges(begin[of], m[item])
        later = np.repeat(doc[item] > keys.least[of], m[item])
        apart = np.repeat((doc[item] > keys.least[of]) | (doc[item] < keys.most[of]), m[item])
        earlier.append(where[later | flags[0][from_]])
        other.append(where[apart | flags[1][from_]])

    mark(runs, (state == SHARED) | (state == ASKED), u.start, u.windows, u.doc)
    hot = np.sort(runs.order[state[runs.of] == HOT])
    if len(hot):
        one, at = u.singles(hot, buckets)
        mark(one, np.ones(len(one.rep), bool), at, np.ones(len(at), np.int64), np.repeat(u.doc[hot], u.windows[hot]))
    return u, covered(u.count, np.concatenate(earlier), size), covered(u.count, np.concatenate(other), size)


def stretches(mark: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, pointers by text) of the maximal marked stretches within texts."""
    edge = np.zeros(len(mark) + 1, bool)
    edge[first] = True
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    s = np.flatnonzero(mark & (np.concatenate(([True], ~mark[:-1])) | edge[:-1]))
    e = np.flatnonzero(mark & (np.concatenate((~mark[1:], [True])) | edge[1:])) + 1
    return s, e, np.searchsorted(s, first)


def longest(mark: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The longest marked stretch of each text."""
    s, e, at = stretches(mark, first)
    out = np.zeros(len(first) - 1, np.int64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.maximum.reduceat(e - s, at[some])
    return out


def find(docs: DataFrame, kind: str, size: int, k: int, resolver: Callable, finish: Callable, schema: str, chunk_bytes: int, rest: bool = False, chunks: int | None = None, hot: int = HOT_NAMES) -> DataFrame:
    """finish(table of a chunk's rows, its units, units in windows of earlier documents, of other documents) for all chunks. With rest, rows have all other columns in a struct `rest`.

    resolver(windows of each run, its least and largest doc_id, content, size) gives the least and the largest doc_id of each window.
    """
    common.batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest")] if rest else []))
    n = chunks or common.chunk_count(base, chunk_bytes)
    buckets = max(4, n)
    dealt = common.chunked(base, n, "text", *(["rest"] if rest else []))
    sent = dealt.groupBy("chunk").applyInArrow(lambda key, t: _send(key, t, kind, size, k, buckets), SENT)
    asks = sent.groupBy("bucket").applyInArrow(lambda key, t: _ask(key, t, hot), ASKS)
    given = dealt.groupBy("chunk").cogroup(asks.groupBy("chunk")).applyInArrow(lambda key, t, a: _give(key, t, a, kind, size, k, buckets), GIVEN)
    found = sent.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(lambda key, s, g: _resolve(key, s, g, size, buckets, hot, resolver), FOUND)

    def end(key: tuple, t: pa.Table, rows: pa.Table) -> pa.Table:
        return finish(t, *_marks(t, rows, kind, size, k, buckets))

    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(end, schema)
