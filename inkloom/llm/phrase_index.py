"""Benchmark decontamination by a document-partitioned positional inverted index.

build() stores the postings of all tokens of the documents in a table: a row is
a segment, a slice of documents of about 4 MB, with its terms, ascending, and
for each term the ascending list of word positions where the segment has it.
search_index() looks test phrases up in each segment: from the rarest terms of
a phrase in the segment, the positions less the term's offset in the phrase are
the candidate starts, with which the lists of the other terms, adjusted by their
offsets, are intersected in order of rarity. Matches by proximity, which may
lack `misses` terms, start from the misses + 1 rarest, each shifted by up to
`slop` words either way: of any misses + 1 terms one is in its place, so the
choice doesn't show in the result. Documents aren't shuffled. The test set is
sent to the tasks in blocks of at most BLOCK_BYTES of text, whose size is
checked; with more than one block, each reads the stored index, and their
results meet by segment.

Defined results: null and empty texts have no words and no hits; a null
item_id marks hits but is not listed; repeated rows give a row each, whatever
the number of blocks; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

#: Text of the test set that one pass sends to the tasks.
BLOCK_BYTES = 8 << 20
INDEX = "segment long, doc_ids array<long>, firsts array<long>, terms binary, counts binary, positions binary"
PARTIAL = "segment long, doc_ids array<long>, firsts array<long>, hit binary, found binary, near binary"
SCHEMA = "doc_id long, n_words long, n_hit long, hit_starts array<int>, hit_ends array<int>, items array<long>, near_items array<long>"


class Phrases:
    """Distinct windows of `width` words of the items, as ids of a sorted vocabulary of term hashes."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        raw, off = vec.buffers(pa.array([t for _, t in items], pa.string()))
        raw = vec.lower(raw)
        starts, ends, first = vec.words(raw, off, vec.ALNUM)
        self.vocab, terms = np.unique(vec.span_hashes(raw, starts, ends), return_inverse=True)
        terms = terms.astype(np.int64)
        seen: dict[bytes, int] = {}
        pairs: set[tuple[int, int]] = set()
        for (item, _), lo, hi in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            for at in range(lo, max(lo + 1, hi - width + 1) if hi > lo else lo):
                w = seen.setdefault(terms[at : min(at + width, hi)].tobytes(), len(seen))
                if item is not None:
                    pairs.add((w, item))
        rows = [np.frombuffer(x, np.int64) for x in seen]
        self.size = np.array([len(r) for r in rows], np.int64)
        self.terms = np.full((len(rows), width), -1, np.int64)
        for i, r in enumerate(rows):
            self.terms[i, : len(r)] = r
        own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.items, self.ptr = own[:, 1].copy(), np.searchsorted(own[:, 0], np.arange(len(rows) + 1))


class Segment:
    """Postings of the texts of a slice: positions of term t, ascending, are positions[pointers[t]:pointers[t + 1]]."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.first, self.terms, self.positions = first, terms, positions
        self.pointers = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

    @classmethod
    def of(cls, texts: pa.Array) -> Segment:
        raw, off = vec.buffers(texts)
        raw = vec.lower(raw)
        starts, ends, first = vec.words(raw, off, vec.ALNUM)
        h = vec.span_hashes(raw, starts, ends)
        order = np.argsort(h, kind="stable")
        terms, counts = np.unique(h[order], return_counts=True)
        return cls(first, terms, counts, order)

    def row(self, segment: int, doc_ids: pa.Array) -> pa.RecordBatch:
        steps = np.diff(self.positions, prepend=0).astype("<i4")
        some = lambda x: pa.array([x.tolist() if isinstance(x, np.ndarray) else x.to_pylist()], pa.list_(pa.int64()))
        cols = [pa.array([segment], pa.int64()), some(doc_ids), some(self.first), *(pa.array([x], pa.binary()) for x in (self.terms.astype("<u8").tobytes(), np.diff(self.pointers).astype("<u4").tobytes(), steps.tobytes()))]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in INDEX.split(", ")])

    @classmethod
    def read(cls, row: dict) -> Segment:
        steps = np.frombuffer(row["positions"], "<i4")
        return cls(np.array(row["firsts"], np.int64), np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["counts"], "<u4"), np.cumsum(steps, dtype=np.int64))

    def lists(self, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pointers) of the lists of some terms."""
        if not len(self.terms) or not len(vocab):
            return np.zeros(0, np.int64), np.zeros(len(vocab) + 1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, vocab), len(self.terms) - 1)
        n = np.where(self.terms[at] == vocab, self.pointers[at + 1] - self.pointers[at], 0)
        return self.positions[vec.ranges(self.pointers[at], n)], np.concatenate(([0], np.cumsum(n)))


def search(p: Phrases, seg: Segment, slop: int, misses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact matches, then of proximity matches: all but `misses` terms within `slop` words of their place."""
    none = np.zeros(0, np.int64)
    where, ptr = seg.lists(p.vocab)
    if not len(p.size) or not len(where):
        return none, none, none, none
    own = vec.owner(seg.first)
    count = np.diff(ptr)
    ids = np.full(len(own), -1, np.int64)  # the test term at each position
    ids[where] = np.repeat(np.arange(len(count)), count)
    width = p.terms.shape[1]
    df = np.where(p.terms >= 0, count[p.terms], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    # at most `misses` terms are out of place, so of any misses + 1 one is within slop of its place: each start comes from one of the rarest
    seeds = []
    for j in range(min(misses + 1, width)):
        col = order[:, j]
        term = p.terms[np.arange(len(df)), col]
        n = np.where((term >= 0) & ((df == 0).sum(axis=1) <= misses), count[term], 0)
        win = np.repeat(np.arange(len(df)), n)
        at = where[vec.ranges(ptr[term], n)] - col[win]
        seeds += [(win, at - s) for s in range(-slop, slop + 1)]
    win, start = (np.concatenate(x) for x in zip(*seeds, strict=True))
    ok = (start >= 0) & (start + p.size[win] <= len(ids))
    win, start = win[ok], start[ok]
    if len(seeds) > 1:
        win, start = np.divmod(np.unique(win * len(ids) + start), len(ids))
    ok = own[start] == own[start + p.size[win] - 1]
    win, start = win[ok], start[ok]
    bad = np.zeros(len(win), np.int64)  # terms not within slop
    off = np.zeros(len(win), np.int64)  # terms not at their place
    for j in range(width):
        col = order[win, j]
        term = p.terms[win, col]
        live = term >= 0
        at = start + col
        exact = ~live | (ids[np.minimum(at, len(ids) - 1)] == term)
        near = exact.copy()
        for s in range(1, slop + 1):
            for x in (at - s, at + s):
                x = np.clip(x, 0, len(ids) - 1)
                near |= (ids[x] == term) & (own[x] == own[start])
        off += ~exact
        bad += ~near
        ok = (bad <= misses) & (p.size[win] - bad > 0)
        win, start, bad, off = win[ok], start[ok], bad[ok], off[ok]
    exact = off == 0
    return win[exact], start[exact], win, start


def _lists(owner: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """List columns of n rows from values sorted by owner."""
    off = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(off, pa.array(v)) for v in values]


def _items(p: Phrases, win: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, item) of the windows, sorted."""
    n = p.ptr[win + 1] - p.ptr[win]
    pair = np.unique(np.stack([np.repeat(doc, n), p.items[vec.ranges(p.ptr[win], n)]], axis=1), axis=0) if n.sum() else np.zeros((0, 2), np.int64)
    return pair[:, 0], pair[:, 1].copy()


def _partial(segment: int, doc_ids: list, p: Phrases, seg: Segment, slop: int, misses: int) -> dict:
    own = vec.owner(seg.first)
    win, at, near, near_at = search(p, seg, slop, misses)
    d = np.zeros(len(own) + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + p.size[win], -1)
    pairs = lambda w, x: np.stack(_items(p, w, own[x]), axis=1).astype("<i8").tobytes()
    return {"segment": segment, "doc_ids": doc_ids, "firsts": seg.first.tolist(), "hit": np.packbits(np.cumsum(d)[:-1] > 0).tobytes(), "found": pairs(win, at), "near": pairs(near, near_at)}


def _finish(parts: list[dict]) -> pa.RecordBatch:
    """The rows of a segment from what the blocks have found in it."""
    first, docs = np.array(parts[0]["firsts"], np.int64), len(parts[0]["doc_ids"])
    own = vec.owner(first)
    hit = np.zeros(len(own), bool)
    for x in parts:
        hit |= np.unpackbits(np.frombuffer(x["hit"], np.uint8), count=len(own)).astype(bool)
    edge = np.zeros(len(hit) + 1, bool)
    edge[first[:-1]] = True
    prev, nxt = np.concatenate(([False], hit[:-1])), np.concatenate((hit[1:], [False]))
    s = np.flatnonzero(hit & (~prev | edge[:-1]))
    e = np.flatnonzero(hit & (~nxt | edge[1:])) + 1
    spans = _lists(own[s], docs, (s - first[own[s]]).astype(np.int32), (e - first[own[s]]).astype(np.int32))
    lists = []
    for column in ("found", "near"):
        pair = np.unique(np.concatenate([np.frombuffer(x[column], "<i8").reshape(-1, 2) for x in parts]), axis=0)
        lists += _lists(pair[:, 0], docs, pair[:, 1].copy())
    total = np.concatenate(([0], np.cumsum(hit)))
    return pa.RecordBatch.from_arrays(
        [pa.array(parts[0]["doc_ids"], pa.int64()), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), *spans, *lists],
        names=["doc_id", "n_words", "n_hit", "hit_starts", "hit_ends", "items", "near_items"],
    )


def build(docs: DataFrame) -> DataFrame:
    """The stored index of docs(doc_id, text): a table in the shared folder, which common.remove() deletes."""
    common.batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for batch in it:
            for part in vec.slices(batch):
                yield Segment.of(part.column(1)).row(k, part.column(0))
                k += 1

    return common.cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The test set in blocks of about block_bytes of text, by a hash of the row."""
    bench = benchmark.select(F.col("item_id").cast("long"), "text")
    n = -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    for b in range(n):
        yield [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def search_index(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 1, misses: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the index: its words, those inside occurrences of test phrases (ranges of word numbers), the items found, and those found by proximity."""
    names = [x.split()[0] for x in PARTIAL.split(", ")]

    def look(p: Phrases):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield pa.RecordBatch.from_pylist([_partial(row["segment"], row["doc_ids"], p, Segment.read(row), slop, misses)], schema=partial)

        return run

    kinds = {"segment": pa.int64(), "doc_ids": pa.list_(pa.int64()), "firsts": pa.list_(pa.int64())}
    partial = pa.schema([(n, kinds.get(n, pa.binary())) for n in names])
    parts = [index.mapInArrow(look(Phrases(items, width)), PARTIAL) for items in _blocks(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0].mapInArrow(lambda it: (_finish([row]) for batch in it for row in batch.to_pylist()), SCHEMA)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionAll(x)
    return every.groupBy("segment").applyInArrow(lambda t: pa.Table.from_batches([_finish(t.to_pylist())]), SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """search_index() of an index that is stored first."""
    return search_index(build(docs), benchmark, **options)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a test phrase; all columns stay. Rows go through here with all their columns, so a segment's postings are used at once instead of being stored."""
    common.batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(p: Phrases):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for part in vec.slices(batch, column=at):
                    seg, bad = Segment.of(part.column(at)), np.zeros(part.num_rows, bool)
                    bad[vec.owner(seg.first)[search(p, seg, 0, 0)[1]]] = True
                    yield part.filter(pa.array(~bad))

        return run

    for items in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(keep(Phrases(items, width)), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
