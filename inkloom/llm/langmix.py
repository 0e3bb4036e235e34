"""Language identification by multilingual mixture inference.

Each language is a distribution over byte trigrams (hashed to BINS bins, add-half
smoothing), counted over all labelled training rows: tasks add up counts, which
are summed by slices, so what reaches the driver and the tasks is one table of
languages x BINS whatever the number of rows. A document is a mixture: expectation
maximisation estimates the proportions of all languages from its trigrams, and
an upper bound of any mixture's likelihood. Then sets of 1, 2, ... languages are
fitted: the best set so far with each other language that could win by its
gradient, and the foremost languages. The set with the highest likelihood less
PENALTY / 2 * ln(n) for each language beyond the first is selected. The foremost
language of the set is predicted.

Defined results: a null text, or one without a letter, or an empty training set
gives `und` with score 0; null labels are not learned from; a null doc_id counts
as training; repeated rows count and return as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

BITS = 16
BINS = 1 << BITS
SLICE = 1 << 12
#: Rounds between two looks at the bound, and of a document that doesn't converge; its bound holds all the same.
ROUNDS, MOST_ROUNDS = 10, 1000
#: Fits end so near (nats) to the highest likelihood.
TOLERANCE = 0.05
#: Likelihoods (languages x entries) of one block of set fits.
FIT_ENTRIES = 1 << 22
#: Weight of the penalty; above 1, as neighbouring trigrams aren't independent.
PENALTY = 6.0
#: Languages x bins x 8 bytes must fit in a worker.
MOST_LANGUAGES = 400
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>"

_CODE = np.arange(256, dtype=np.uint32)
for _b in range(128):
    _CODE[_b] = _b | 32 if chr(_b).isalpha() else 32
_ALPHA = np.zeros(256, bool)
_ALPHA[[b for b in range(128) if chr(b).isalpha()]] = True


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, bin, count) of the distinct trigrams of each text, sorted; texts are padded with a space on either side."""
    raw, off = vec.buffers(col)
    n, docs = len(raw), len(off) - 1
    x = np.full(n + docs + 2, 32, np.uint32)
    own = np.repeat(np.arange(docs), np.diff(off))
    at = np.arange(n) + own
    x[at + 1] = _CODE[raw]
    a, b, c = x[at], x[at + 1], x[at + 2]
    some = (a != 32) | (b != 32) | (c != 32)
    h = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) ^ c * np.uint32(0xC2B2AE35)).astype(np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    key = (own << BITS) | (h >> np.uint32(32 - BITS)).astype(np.int64)
    key, count = np.unique(key[some], return_counts=True)
    return key >> BITS, key & (BINS - 1), count


def lettered(col: pa.Array) -> np.ndarray:
    """Which texts have a letter."""
    raw, off = vec.buffers(col)
    c = np.concatenate(([0], np.cumsum(_ALPHA[raw])))
    out = c[off[1:]] > c[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(ch.isalpha() for ch in col[int(i)].as_py() or "")
    return out


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Log probabilities of the bins for each label."""
    common.batches(rows.sparkSession)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            for part in vec.slices(batch):
                own, bins, n = features(part.column(0))
                names, codes = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    mine = codes[own] == i
                    sums.setdefault(name, np.zeros(BINS, np.int64))
                    sums[name] += np.bincount(bins[mine], weights=n[mine], minlength=BINS).astype(np.int64)
        for name, x in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * (BINS // SLICE), "part": pa.array(range(BINS // SLICE), pa.int32()), "n": [x[i : i + SLICE].tobytes() for i in range(0, BINS, SLICE)]})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in t.column("n"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"lang": t.column("lang")[:1], "part": t.column("part")[:1], "n": [total.tobytes()]})

    schema = "lang string, part int, n binary"
    counted = rows.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).mapInArrow(count, schema)
    model: dict[str, np.ndarray] = {}
    for r in counted.groupBy("lang", "part").applyInArrow(add, schema).toLocalIterator():
        model.setdefault(r.lang, np.zeros(BINS))[r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(r.n, np.int64)
        if len(model) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} labels")
    return {k: np.log((model[k] + 0.5) / (model[k].sum() + 0.5 * BINS)) for k in sorted(model)}


def fit(p: np.ndarray, count: np.ndarray, size: np.ndarray, pi: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation for many documents: (proportions, log likelihood relative to p's scale, upper bound of it for any proportions).

    p: likelihoods by language and entry; document i has the next size[i] entries. A document is done when its bound is
    within TOLERANCE of its likelihood, or not above its floor. The bound: by Jensen's inequality no proportions gain
    more than n ln(max g / n), where g is the gradient, and n the number of trigrams.
    """
    pi = pi.astype(np.float64)
    like, upper = np.zeros(len(size)), np.zeros(len(size))
    live, now = np.arange(len(size)), pi
    for r in range(MOST_ROUNDS + 1):
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        own = np.repeat(np.arange(len(size)), size)
        s = np.maximum((p * now.astype(np.float32)[:, own]).sum(axis=0), 1e-30)
        g = np.add.reduceat(p * (count / s), first, axis=1, dtype=np.float64)
        if r % ROUNDS == 0:
            n = np.add.reduceat(count, first, dtype=np.float64)
            got = np.add.reduceat(count * np.log(s), first, dtype=np.float64)
            most = got + n * np.log(np.maximum(g.max(axis=0) / n, 1))
            pi[:, live], like[live], upper[live] = now, got, most
            on = most - got > TOLERANCE
            if floor is not None:
                on &= most > floor[live]
            if not on.any():
                break
            if not on.all():
                entry = np.repeat(on, size)
                p, count = p[:, entry], count[entry]
                live, size, now, g, n = live[on], size[on], now[:, on], g[:, on], n[on]
        now = now * g / n
        now /= now.sum(axis=0)
    return pi, like, upper


def fit_sets(p: np.ndarray, count: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (document, set of k languages): (proportions, log likelihood, gradient for all languages). Fitted in blocks of FIT_ENTRIES."""
    pi, like, grad = np.zeros(sets.shape), np.zeros(len(doc)), np.zeros((len(doc), len(p)))
    block = np.cumsum(size[doc]) // max(1, FIT_ENTRIES // len(p))
    for mine in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(block)) + 1):
        n = size[doc[mine]]
        at, own = vec.ranges(first[doc[mine]], n), np.repeat(np.arange(len(mine)), n)
        q = p[sets[mine].T[:, own], at]
        got, like[mine], _ = fit(q, count[at], n, np.full((sets.shape[1], len(mine)), 1 / sets.shape[1]))
        pi[mine] = got.T
        s = np.maximum((q * got.astype(np.float32)[:, own]).sum(axis=0), 1e-30)
        grad[mine] = np.add.reduceat(p[:, at] * (count[at] / s), np.concatenate(([0], np.cumsum(n)[:-1])), axis=1, dtype=np.float64).T
    return pi, like, grad


def infer(col: pa.Array, table: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by language and text, which texts have trigrams): the selected languages' shares, 0 for the others."""
    langs, docs = len(table), len(col)
    own, bins, n = features(col)
    shares = np.zeros((langs, docs))
    here, own = np.unique(own, return_inverse=True)
    known = np.zeros(docs, bool)
    known[here] = True
    if not len(here):
        return shares, known
    first = np.searchsorted(own, np.arange(len(here)))
    size = np.diff(np.append(first, len(own)))
    lp = table[:, bins]
    top = lp.max(axis=0)
    p = np.exp(lp - top).astype(np.float32)
    count = n.astype(np.float32)
    single = np.add.reduceat(np.log(np.maximum(p, 1e-30)) * count, first, axis=1, dtype=np.float64)
    words = np.add.reduceat(count, first, dtype=np.float64)
    fine = penalty / 2 * np.log(words + 1)
    best, best_like = single.argmax(axis=0), single.max(axis=0)
    out = np.zeros(single.shape)
    out[best, np.arange(len(here))] = 1
    pi, _, upper = fit(p, count, size, np.full((langs, len(here)), 1 / langs), best_like + fine)
    order = np.argsort(-pi, axis=0, kind="stable")
    # the set that grows, its likelihood and gradient
    chain, chain_like = best[:, None], best_like.copy()
    live = np.flatnonzero(upper - fine > best_like)  # elsewhere no set can do better: upper is above the likelihood of any
    grad = np.zeros((len(here), langs))
    if len(live):
        grad[live] = fit_sets(p, count, first, size, live, chain[live])[2]
    for k in range(2, langs + 1):
        if not len(live):
            break
        g = grad[live]
        bound = words[live, None] * np.log(np.maximum(np.maximum(g, g[np.arange(len(live))[:, None], chain[live]].max(axis=1)[:, None]) / words[live, None], 1))
        free = np.ones(g.shape, bool)
        free[np.arange(len(live))[:, None], chain[live]] = False
        tried = free & (chain_like[live, None] + bound - (k - 1) * fine[live, None] > best_like[live, None])
        tried[np.arange(len(live)), np.where(free, g, -1).argmax(axis=1)] = True
        i, j = np.nonzero(tried)
        doc = np.concatenate([live[i], live])
        sets = np.concatenate([np.column_stack([chain[live[i]], j]), order[:k, live].T])
        by = np.argsort(doc, kind="stable")
        doc, sets = doc[by], sets[by]
        got, l, slope = fit_sets(p, count, first, size, doc, sets)
        by = np.lexsort((-l, doc))
        by = by[np.searchsorted(doc[by], live)]  # the most likely set of each document
        grown = np.zeros((len(here), k), np.int64)
        grown[live], chain_like[live], grad[live] = sets[by], l[by], slope[by]
        chain = grown
        score = l[by] - (k - 1) * fine[live]
        up = score > best_like[live]
        won = live[up]
        out[:, won] = 0
        out[chain[won], won[:, None]] = got[by][up]
        best_like[won] = score[up]
        live = live[upper[live] - k * fine[live] > best_like[live]]
    shares[:, here] = out
    return shares, known


def predict(docs: DataFrame, model: dict[str, np.ndarray], penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out (passed on), lang_pred, score (its share), and the selected languages with their shares."""
    common.batches(docs.sparkSession)
    names, table = list(model), np.array(list(model.values()))
    limit = common.CHUNK_BYTES * 4 // max(4, len(names)) // 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in vec.slices(batch, limit):
                col, n = part.column(2), part.num_rows
                shares, known = infer(col, table, penalty) if names else (np.zeros((0, n)), np.zeros(n, bool))
                known &= lettered(col)
                order = np.argsort(-shares, axis=0, kind="stable")
                top = order[0] if names else np.zeros(n, int)
                some = [[int(j) for j in order[:, i] if shares[j, i] > 0] if known[i] else [] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([names[j] if k else "und" for j, k in zip(top, known, strict=True)]),
                     pa.array([min(1.0, float(shares[j, i])) if known[i] else 0.0 for i, j in enumerate(top)]),
                     pa.array([[names[j] for j in x] for x in some], pa.list_(pa.string())), pa.array([[float(shares[j, i]) for j in x] for i, x in enumerate(some)], pa.list_(pa.float64()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "langs", "shares"],
                )

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(docs, train(docs.where(~F.col("held_out"))))
