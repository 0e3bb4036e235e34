"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

The texts, cut into runs of word windows, are dealt out to blocks by content
(windows.py), so that a block has every run which could match one of its own,
and parsing against one block is parsing against all. A block's index names
each distinct sequence of 1, 2, 3, ... windows and knows the earliest document
and the place (run, window) where it stands. A run is factored greedily from
left to right: the factor at a window is the longest sequence of windows from
there that an earlier document has, as (run, window, length) of the reference;
the window after a factor's end is looked up like any other, so that a passage
which straddles the end of a factor isn't lost. A factor of m windows is a
passage of m + size - 1 words, and is a duplicate span.

`longest_repeat` is the longest stretch of words in windows that another
document has, be it earlier or later: unlike n_removed it also tells the
document whose copy stays.

Defined results: null and empty texts, and texts with fewer words than a
window, lose nothing; rows of one doc_id don't remove each other's words;
repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vec, windows

#: Windows of 13 words; grams of 6 words sample them.
SIZE, GRAM = 13, 6
FIELDS = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("longest_repeat", T.LongType()), ("starts", T.ArrayType(T.IntegerType())), ("ends", T.ArrayType(T.IntegerType())), ("kept", T.StringType())]


class Block:
    """The index of a reference block: at each window, the longest sequence of windows that an earlier document has, and where."""

    def __init__(self, prints: np.ndarray, run: np.ndarray, doc: np.ndarray):
        n = len(prints)
        self.length, self.ref = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        one = np.unique(prints, return_inverse=True)[1].astype(np.int64)
        at, name, m = np.arange(n), one, 1
        while len(at):
            order = np.lexsort((at, doc[at], name))
            head = np.flatnonzero(windows._heads(name[order]))
            size = np.diff(np.append(head, len(order)))
            first = np.empty(len(at), np.int64)  # where the earliest document has the sequence
            first[order] = np.repeat(at[order[head]], size)
            earlier = doc[first] < doc[at]
            self.length[at[earlier]], self.ref[at[earlier]] = m, first[earlier]
            # sequences that stand alone can't be found again when they are longer
            several = np.empty(len(at), bool)
            several[order] = np.repeat(size > 1, size)
            keep = several & (at + m < n)
            keep[keep] = run[at[keep] + m] == run[at[keep]]
            at, name = at[keep], name[keep]
            name = np.unique(name * n + one[at + m], return_inverse=True)[1].astype(np.int64) if len(at) else name
            m += 1


def factors(prints: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, first window of the reference) of the factors of all runs; run i has count[i] windows of document doc[i]."""
    run = np.repeat(np.arange(len(count)), count)
    block = Block(prints, run, np.repeat(doc, count))
    at, end = np.cumsum(count) - count, np.cumsum(count)
    out = []
    while len(at):  # all runs go on by a factor, or by a window that has none
        hit = block.length[at] > 0
        out.append(at[hit])
        at = at + np.maximum(block.length[at], 1)
        more = at < end
        at, end = at[more], end[more]
    start = np.sort(np.concatenate([np.zeros(0, np.int64), *out]))
    return start, block.length[start], block.ref[start]


def resolve(count: np.ndarray, lo: np.ndarray, hi: np.ndarray, content: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The earliest document of each window, by the factors; and the last one."""
    prints = np.frombuffer(content, np.uint64)
    first, last = np.repeat(lo, count), np.repeat(hi, count)
    start, length, ref = factors(prints, count, lo)
    # outside of factors, no document is earlier than the first of the run's own
    first[vec.ranges(start, length)] = first[vec.ranges(ref, length)]
    order = np.argsort(prints, kind="stable")
    head = np.flatnonzero(windows._heads(prints[order]))
    if len(head):
        last[order] = np.repeat(np.maximum.reduceat(last[order], head), np.diff(np.append(head, len(order))))
    return first, last


def kept_text(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The words that are kept, joined by one space, for each text."""
    s, e = starts[keep], ends[keep]
    n = e - s + 1
    flat = np.append(raw, np.uint8(32))[vec.ranges(s, n)]
    stop = np.cumsum(n)
    flat[stop - 1] = 32
    per = np.concatenate(([0], np.cumsum(keep)))[first]
    bound = np.concatenate(([0], stop))[per]
    last = bound[1:] > bound[:-1]
    drop = np.ones(len(flat), bool)
    drop[bound[1:][last] - 1] = False
    off = np.concatenate(([0], np.cumsum(np.diff(bound) - last)))
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(flat[drop].tobytes())])


def finish(t: pa.Table, u: windows.Units, gone: np.ndarray, other: np.ndarray) -> pa.Table:
    s, e, at = windows.stretches(gone, u.first)
    base = np.repeat(u.first[:-1], np.diff(at))
    at = pa.array(at, pa.int32())
    total = np.concatenate(([0], np.cumsum(gone)))[u.first]
    out = {
        "doc_id": t.column("doc_id"), "n_words": pa.array(np.diff(u.first)), "n_removed": pa.array(np.diff(total)), "longest_repeat": pa.array(windows.longest(other, u.first)),
        "starts": pa.ListArray.from_arrays(at, pa.array((s - base).astype(np.int32))), "ends": pa.ListArray.from_arrays(at, pa.array((e - base).astype(np.int32))),
        "kept": kept_text(u.raw, u.starts, u.ends, u.first, ~gone),
    }
    return pa.table(out | ({"rest": t.column("rest")} if "rest" in t.column_names else {}))


def dedup(docs: DataFrame, size: int = SIZE, rest: bool = False, chunk_bytes: int = common.CHUNK_BYTES, **options) -> DataFrame:
    """Per document: words, words removed, the longest repeat, removed ranges of word numbers, and the kept words; with rest, also its row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(*f) for f in FIELDS), *([T.StructField("rest", docs.schema)] if rest else [])])
    return windows.find(docs, "words", size, max(1, min(GRAM, size // 2)), resolve, finish, schema, chunk_bytes, rest, **options)


def apply(docs: DataFrame, **options) -> DataFrame:
    """The documents without their duplicate spans; where nothing is removed, the text stays as it is."""
    got = dedup(docs, rest=True, **options)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    return got.select(*(text.alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    got = dedup(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "longest_repeat")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) AS i FROM d WHERE len(w) >= {SIZE})),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least, max(doc_id) OVER (PARTITION BY g) AS most FROM g),
h AS (SELECT doc_id, i FROM r WHERE least < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS p FROM h),
o AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS p FROM r WHERE least < most),
l AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o) GROUP BY doc_id, k) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u ANTI JOIN p ON u.doc_id = p.doc_id AND u.p = p.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       CAST(coalesce(l.n, 0) AS BIGINT) AS longest_repeat
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
