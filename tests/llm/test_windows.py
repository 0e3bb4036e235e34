import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from inkloom.llm import radix_suffix, rlz_dedup, vec, windows


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "é日", "cat", "x", "longerword"])
    passage = " ".join(f"p{i}é" for i in range(40))
    rows = [(i, r.choice([" ", "\n", "\t "]).join(word() for _ in range(r.randint(0, 50)))) for i in range(60)]
    rows += [(100 + i, f"a{i} b{i} {passage} c{i}") for i in range(70)]  # one passage in many documents
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(7, rows[7][1]), (300, None), (301, ""), (302, passage + " " + passage), (303, "z" * 300), (304, "z" * 300)]
    rows += [(305, "w " * 3000), (None, passage), (None, passage)]
    r.shuffle(rows)
    return rows


def cover(items, ids, size, other=False):
    """Brute force: which items of each row are removed; with other, which are in a window that another document has."""
    holders = {}
    big = 1 << 62
    ids = [big if i is None else i for i in ids]
    for d, x in zip(ids, items, strict=True):
        for i in range(len(x) - size + 1):
            holders.setdefault(tuple(x[i : i + size]), set()).add(d)
    out = []
    for d, x in zip(ids, items, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            have = holders[tuple(x[i : i + size])]
            if len(have) > 1 if other else min(have) < d:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def longest(mark):
    return max((len(list(g)) for k, g in itertools.groupby(mark) if k), default=0)


def runs(gone):
    return sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))


@pytest.mark.parametrize(("chunks", "hot"), [(1, 4096), (7, 4096), (64, 4096), (7, 2), (64, 2)])
def test_words(spark, chunks, hot):
    rows = corpus(chunks)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS kept").repartition(3)
    words = [(t or "").encode().split() for _, t in rows]
    ids = [d for d, _ in rows]
    gone, other = (cover(words, ids, rlz_dedup.SIZE, x) for x in (False, True))
    want = [(d, len(w), sum(g), longest(o), b" ".join(x for x, y in zip(w, g, strict=True) if not y).decode()) for (d, _), w, g, o in zip(rows, words, gone, other, strict=True)]
    got = rlz_dedup.dedup(df, chunks=chunks, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.longest_repeat, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert all(sum(r.ends) - sum(r.starts) == r.n_removed for r in got)
    new = rlz_dedup.apply(df, chunks=chunks, hot=hot)
    assert new.columns == df.columns
    text = [(d, t if not any(g) else k) for (d, t), g, (*_, k) in zip(rows, gone, want, strict=True)]
    assert sorted(((r.doc_id, r.text) for r in new.collect()), key=str) == sorted(text, key=str)


@pytest.mark.parametrize(("chunks", "hot"), [(1, 4096), (7, 4096), (64, 2)])
def test_bytes(spark, chunks, hot):
    rows = corpus(chunks)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk").repartition(3)
    raw = [(t or "").encode() for _, t in rows]
    ids = [d for d, _ in rows]
    gone, other = (cover(raw, ids, radix_suffix.SIZE, x) for x in (False, True))
    want = [(d, len(x), sum(g), runs(g), longest(o), hashlib.sha256(bytes(b for b, y in zip(x, g, strict=True) if not y)).hexdigest()) for (d, _), x, g, o in zip(rows, raw, gone, other, strict=True)]
    got = radix_suffix.dedup(df, chunks=chunks, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), r.longest_repeat, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == sorted(want, key=str)


def test_groups_are_the_repeated_windows():
    r = random.Random(2)
    raw = np.frombuffer(bytes(r.choice(b"ab") for _ in range(4000)), np.uint8)
    for size in (1, 7, 8, 9, 20):
        at = np.arange(len(raw) - size + 1)
        found, group = radix_suffix.groups(raw, at, size)
        by = {}
        for i in at.tolist():
            by.setdefault(raw[i : i + size].tobytes(), []).append(i)
        want = sorted(v for v in by.values() if len(v) > 1)
        have = {}
        for i, g in zip(found.tolist(), group.tolist(), strict=True):
            have.setdefault(g, []).append(i)
        assert sorted(sorted(v) for v in have.values()) == want


def test_factors_are_longest_matches():
    r = random.Random(4)
    prints = np.array([r.randrange(3) for _ in range(400)], np.uint64)
    count = np.array([r.randint(1, 12) for _ in range(200)])
    count = count[np.cumsum(count) <= len(prints)]
    prints = prints[: count.sum()]
    doc = np.array([r.randrange(12) for _ in count])
    begin = np.cumsum(count) - count
    seqs = [prints[b : b + c].tolist() for b, c in zip(begin, count, strict=True)]
    where = {int(b) + j: (i, j) for i, (b, c) in enumerate(zip(begin, count, strict=True)) for j in range(c)}
    want = []
    for i, s in enumerate(seqs):
        at = 0
        while at < len(s):
            have = [m for m in range(1, len(s) - at + 1) if any(doc[k] < doc[i] and s[at : at + m] == x[j : j + m] for k, x in enumerate(seqs) for j in range(len(x) - m + 1))]
            if have:
                want.append((int(begin[i]) + at, max(have)))
            at += max(have, default=1)
    start, length, ref = rlz_dedup.factors(prints, count, doc)
    assert list(zip(start.tolist(), length.tolist(), strict=True)) == want
    for s, m, f in zip(start.tolist(), length.tolist(), ref.tolist(), strict=True):
        (i, _), (k, j) = where[s], where[f]
        assert doc[k] < doc[i] and j + m <= count[k] and prints[s : s + m].tolist() == prints[f : f + m].tolist()


@pytest.mark.parametrize("op", [rlz_dedup, radix_suffix])
def test_every_removed_window_comes_from_the_resolver(spark, op):
    """Also in one chunk."""
    rows = [(1, " ".join(f"a{i}" for i in range(40)) + " left"), (2, "other " + " ".join(f"a{i}" for i in range(5, 40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(r.n_removed for r in op.dedup(df, chunks=1).collect()) > 0
    seen = []
    t = pa.table({"doc_id": [1, 2], "text": [x for _, x in rows]})
    kind, k = ("words", op.GRAM) if op is rlz_dedup else ("bytes", op.GRAM)

    def spy(*a):
        seen.append(int(a[0].sum()))
        return op.resolve(*a)

    key = lambda i: (pa.scalar(i),)
    sent = windows._send(key(0), t, kind, op.SIZE, k, 1)
    given = windows._give(key(0), t, windows._ask(key(0), sent, 4096), kind, op.SIZE, k, 1)
    u, gone, other = windows._marks(t, windows._resolve(key(0), sent, given, op.SIZE, 1, 4096, spy), kind, op.SIZE, k, 1)
    assert seen and seen[0] >= gone.sum() / op.SIZE and gone.any() and other.sum() > gone.sum()


@pytest.mark.parametrize(("op", "hot"), [(rlz_dedup, 4096), (rlz_dedup, 2), (radix_suffix, 4096), (radix_suffix, 2)])
def test_each_reading_of_a_chunk_may_have_another_order(op, hot):
    """Executors fetch the blocks of a shuffle in any order, and a chunk is read three times."""
    kind, size, k, buckets = "words" if op is rlz_dedup else "bytes", op.SIZE, op.GRAM, 3
    rows, r = corpus(11), random.Random(12)
    chunks = [rows[i::4] for i in range(4)]

    def table(c):
        some = r.sample(chunks[c], len(chunks[c]))
        return pa.table({"doc_id": pa.array([d for d, _ in some], pa.int64()), "text": pa.array([t for _, t in some], pa.string())})

    key = lambda i: (pa.scalar(i),)
    pick = lambda t, c, v: (lambda x: x.take(pa.array(r.sample(range(len(x)), len(x)), pa.int64())))(t.filter(pc.equal(t.column(c), v)))
    sent = pa.concat_tables([windows._send(key(c), table(c), kind, size, k, buckets) for c in range(4)])
    asks = pa.concat_tables([windows._ask(key(b), pick(sent, "bucket", b), hot) for b in range(buckets)])
    given = pa.concat_tables([windows._give(key(c), table(c), pick(asks, "chunk", c), kind, size, k, buckets) for c in range(4)])
    found = pa.concat_tables([windows._resolve(key(b), pick(sent, "bucket", b), pick(given, "bucket", b), size, buckets, hot, op.resolve) for b in range(2 * buckets)])
    got = []
    for c in range(4):
        t = table(c)
        u, gone, _ = windows._marks(t, pick(found, "chunk", c), kind, size, k, buckets)
        got += [(d, x, int(n)) for d, x, n in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), np.diff(np.concatenate(([0], np.cumsum(gone)))[u.first]), strict=True)]
    units = [(x or "").encode().split() if kind == "words" else (x or "").encode() for _, x in rows]
    want = [(d, x, sum(g)) for (d, x), g in zip(rows, cover(units, [d for d, _ in rows], size), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_structured_words_have_different_hashes():
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    raw, off = vec.buffers(pa.array([a, a.translate(str.maketrans("ab", "ba"))]))
    assert len(a) == 1024 and len(set(vec.span_hashes(raw, off[:-1], off[1:]).tolist())) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rlz_dedup.dedup(df).count() == radix_suffix.dedup(df).count() == 0
