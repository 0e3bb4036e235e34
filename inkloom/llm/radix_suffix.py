"""Repeated byte strings by a suffix array of limited depth.

Suffixes are ordered only through their first `size` bytes, by passes from the
most significant digit on (a digit is eight bytes, big-endian): each pass sorts
the suffixes within the groups that the passes before have left equal, and
suffixes alone in their group drop out. What is equal after the last pass are
exactly the repeated windows, and bytes of those that also start in a document
with a smaller doc_id are removed. windows.py deals out the suffixes that can
repeat at all, and this sort decides on every one of them by its bytes.

`longest_repeat` is the longest stretch of bytes in windows that another
document has, be it earlier or later.

Defined results: null and empty texts, and texts shorter than a window, lose
nothing; rows of one doc_id don't remove each other's bytes; repeated rows give
a row each; extra columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec, windows

#: Windows of 50 bytes; grams of 24 bytes sample them.
SIZE, GRAM = 50, 24
SCHEMA = "doc_id long, n_bytes long, n_removed long, longest_repeat long, starts array<int>, ends array<int>, kept binary"


def groups(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, group of each) of the suffixes at `at` that are equal through `size` bytes to another, group by group. Each must have `size` bytes."""
    word = vec.eights(raw).view(">u8") if len(raw) else np.zeros(1, ">u8")  # the eight bytes from each position, most significant first
    group = np.zeros(len(at), np.uint64)
    depth = 0
    while depth < size and len(at):
        # the bits that the groups' numbers leave free hold the next bytes, so that one sort of 64-bit keys is a pass
        n = min(8 - (int(group[-1]).bit_length() + 7) // 8, size - depth)
        key = word[at + depth].astype(np.uint64) >> np.uint64(8 * (8 - n))
        if depth:
            key |= group << np.uint64(8 * n)
        order = np.argsort(key)
        at, key = at[order], key[order]
        group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))).astype(np.uint64)
        several = (np.bincount(group.astype(np.int64)) > 1)[group.astype(np.int64)]
        at, group = at[several], group[several]
        depth += n
    return at, group


def resolve(count: np.ndarray, lo: np.ndarray, hi: np.ndarray, content: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The earliest and the last document of each window: of those in its group of equal suffixes."""
    raw = np.frombuffer(content, np.uint8)
    at = vec.ranges(np.cumsum(count + size - 1) - (count + size - 1), count)
    first, last = np.repeat(lo, count), np.repeat(hi, count)
    number = np.zeros(len(raw) + 1, np.int64)
    number[at] = np.arange(len(at))
    at, group = groups(raw, at, size)
    if len(at):
        w = number[at]
        head = np.flatnonzero(windows._heads(group))
        n = np.diff(np.append(head, len(w)))
        first[w], last[w] = np.repeat(np.minimum.reduceat(first[w], head), n), np.repeat(np.maximum.reduceat(last[w], head), n)
    return first, last


def finish(t: pa.Table, u: windows.Units, gone: np.ndarray, other: np.ndarray) -> pa.Table:
    kept = np.concatenate(([0], np.cumsum(~gone)))[u.off]
    s, e, at = windows.stretches(gone, u.off)
    base = np.repeat(u.off[:-1], np.diff(at))
    at = pa.array(at, pa.int32())
    n = np.diff(u.off)
    return pa.table({
        "doc_id": t.column("doc_id"), "n_bytes": pa.array(n), "n_removed": pa.array(n - np.diff(kept)), "longest_repeat": pa.array(windows.longest(other, u.off)),
        "starts": pa.ListArray.from_arrays(at, pa.array((s - base).astype(np.int32))), "ends": pa.ListArray.from_arrays(at, pa.array((e - base).astype(np.int32))),
        "kept": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(kept.astype(np.int32).tobytes()), pa.py_buffer(u.raw[~gone].tobytes())]),
    })


def dedup(docs: DataFrame, size: int = SIZE, chunk_bytes: int = common.CHUNK_BYTES, **options) -> DataFrame:
    """Per document: bytes, bytes removed, the longest repeat, the maximal removed runs, and what is kept."""
    return windows.find(docs, "bytes", size, min(GRAM, max(1, size // 2)), resolve, finish, SCHEMA, chunk_bytes, **options)


def query(spark, sf_dir: str) -> DataFrame:
    got = dedup(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_repeat")


#: Bytes as two hexadecimal digits each.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * SIZE}) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {SIZE - 1})) AS i FROM d WHERE len(x) >= {2 * SIZE})),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least, max(doc_id) OVER (PARTITION BY g) AS most FROM g),
a AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE least < doc_id),
s AS (SELECT doc_id, min(i) AS s, max(i) + {SIZE} AS e FROM (SELECT doc_id, i, sum(CASE WHEN i <= before + {SIZE} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM a) GROUP BY doc_id, k),
k AS (SELECT doc_id, sum(e - s) AS n, count(*) AS spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM s GROUP BY doc_id),
b AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE least < most),
l AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, max(i) + {SIZE} - min(i) AS n FROM (SELECT doc_id, i, sum(CASE WHEN i <= before + {SIZE} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE
         array_to_string(list_transform(list_zip(list_prepend(0, es), list_append(ss, len(x) // 2)), lambda z: substr(x, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') END)) AS kept_sha256,
       CAST(coalesce(l.n, 0) AS BIGINT) AS longest_repeat
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
