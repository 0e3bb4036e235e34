"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of any number of words, the root being the empty one. A
context is a candidate if its words are frequent (at least MIN_COUNT tokens,
whatever the size of the corpus) and it repeats (an inner node: REPEATED
training tokens follow it), and is retained if its next-symbol distribution
diverges from that of its longest suffix that is retained: the training log
likelihood gained must exceed GAIN nats and one more for each follower seen.
Distributions are smoothed by absolute discounting: the root gives the
discounted mass to one unknown symbol; a context first splits its mass between
frequent and rare followers, gives what is discounted from frequent ones back
in proportion to the suffix, and shares rare ones out like the suffix. A token
is scored in the longest suffix of its history that is retained.

Texts are dealt out once to chunks, whose tokens then lie in a file of each chunk's own
in the shared folder, by numbers. Chunks send their distinct words with
counts to buckets, which answer with the corpus counts and parts of the corpus
statistics; then they send counts of contexts and followers to buckets by the
context, which test it and answer with counts, from which the chunk computes
probabilities: first contexts of one word, then those of two that repeat. What
is open after that, contexts that longer ones could tell apart (`judge`), goes
to buckets with the words before it, twice as many each round, and a bucket
walks down them; rounds end when nothing is open. Between rounds each chunk's
row is in a file of its own in the shared folder. Only buckets that a chunk has
words for get a row of it. The buckets' statistics are summed and one row goes
to each chunk. No model is gathered in one place.

Defined results: null and empty texts have the end token only; an empty
training set gives every token probability 1 in `score`; a null doc_id counts
as training; repeated rows count and return as often as they are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_tokens, common, vec

MIN_COUNT, REPEATED, GAIN = 8, 2, 10.0
P_PAIR = 0.0  #: No share of the tokens is asked of a context's words.
END = np.uint64(0x5EED0FE4D)
CHUNK = 3 << 20
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_context long"
DOCS = [x.split()[0] for x in SCHEMA.split(", ")]
AT = ["end", "reach", "doc", "n", "used", "p", "part"]
_LISTS = [f"{n} array<{t}>" for n, t in (x.split() for x in SCHEMA.split(", "))]
ONE = ", ".join(["chunk int", "d double", "often double", *_LISTS, "tok binary", "pairs binary", "words binary"])
STATE = ", ".join(["chunk int", "open long", "d double", *_LISTS, *(f"{c} binary" for c in [*AT, "tok"])])
KEPT = "chunk int, doc_id array<bigint>, held array<boolean>, first binary, id binary, words binary"
ROWS = "chunk int, bucket int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, stat array<bigint>"
DONE = "chunk int, open long"
_COLS = [x.split()[0] for x in ROWS.split(", ")]
_K = np.uint64(0x9E3779B97F4A7C15)


def _table(rows: list[tuple]) -> pa.Table:
    rows = [r if len(r) == len(_COLS) else (*r, None) for r in rows]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_COLS)
    kinds = [*[pa.int32()] * 3, *[pa.binary()] * 6, pa.list_(pa.int64())]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(_COLS, cols, kinds, strict=True)})


def _pack(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, as many as the largest needs, compressed; their number and that of the planes come first."""
    x = np.ascontiguousarray(x, np.int64).ravel()
    if not x.size:
        return np.zeros(2, np.int64).tobytes()
    k = (max(1, int(x.max()).bit_length()) + 7) // 8 if x.min() >= 0 else 8
    by, planes = x.view(np.uint8).reshape(-1, 8), np.empty((k, x.size), np.uint8)
    for i in range(k):
        planes[i] = by[:, i]
    return np.array([x.size, k], np.int64).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(t: pa.Table, column: str, rows: int = 1) -> list[np.ndarray]:
    out = []
    for x in t.column(column):
        raw = x.as_py()
        size, k = np.frombuffer(raw, np.int64, 2).tolist()
        x = np.zeros(size, np.int64)
        if size:
            by = x.view(np.uint8).reshape(-1, 8)
            for i, plane in enumerate(np.frombuffer(pa.decompress(memoryview(raw)[16:], size * k, codec="zstd"), np.uint8).reshape(k, -1)):
                by[:, i] = plane
        out.append(x.reshape(rows, -1))
    return out


def _keys(t: pa.Table, column: str) -> list[np.ndarray]:
    """Keys from their packed differences."""
    return [x[0].cumsum().view(np.uint64) for x in _unpack(t, column)]


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and each one's place in them; by a hash table, for many equal values."""
    e = pa.array(x).dictionary_encode()
    values = e.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[e.indices.to_numpy()]


def _first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _ranked, with the place where each value comes first in the middle."""
    values, place = _ranked(x)
    first = np.empty(len(values), np.int64)
    first[place[::-1]] = np.arange(len(x))[::-1]
    return values, first, place


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, row) of numbers from 0 on: where each value comes first, and each value's place among the distinct ones, ascending."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = len(x).bit_length()
    if int(x.max()).bit_length() + bits > 63:
        _, first, row = np.unique(x, return_index=True, return_inverse=True)
        return first, row
    both = np.sort(x.astype(np.int64) << bits | np.arange(len(x)))  # much faster than sorting indices
    at, x = both & ((1 << bits) - 1), both >> bits
    new = np.concatenate(([True], x[1:] != x[:-1]))
    row = np.empty(len(x), np.int64)
    row[at] = new.cumsum() - 1
    return at[new], row


def _edge(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of (context, follower)."""
    return vec.mix(vec.mix(ctx ^ _K) + vec.mix(word))


class Tokens:
    """A chunk's tokens: hashes with the end of each text, and whether they are for training; of texts, or of a row that row() made."""

    def __init__(self, t: pa.Table):
        if "text" in t.column_names:
            self.doc_id, self.held = t.column("doc_id").to_pylist(), t.column("held").to_pylist()
            raw, off = vec.buffers(t.column("text"))
            starts, ends, first = vec.words(raw, off, vec.NON_SPACE)
            h = vec.span_hashes(vec.lower(raw), starts, ends)
            docs = len(off) - 1
            self.first = first + np.arange(docs + 1)
            self.h = np.full(len(h) + docs, END, np.uint64)
            self.h[np.arange(len(h)) + vec.owner(first)] = h
            self.words, self.id = _ranked(self.h)
        else:
            self.doc_id, self.held = (t.column(c)[0].as_py() for c in ("doc_id", "held"))
            self.first, self.id, self.words = (_unpack(t, c)[0][0] for c in ("first", "id", "words"))
            self.first, self.words = self.first.cumsum(), self.words.cumsum().view(np.uint64)
        self.own = vec.owner(self.first)
        self.train = ~np.array(self.held, bool)[self.own]

    def row(self, chunk: int) -> pa.Table:
        return _row(KEPT, [chunk, self.doc_id, self.held, _pack(np.diff(self.first, prepend=0)), _pack(self.id), _pack(np.diff(self.words.view(np.int64), prepend=0))])


def _deal(key: np.ndarray, buckets: int, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds) of all buckets, empty ones too; within a bucket by the keys of `by`, the last one first."""
    b = (vec.mix(key ^ _K) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((*by, b)) if by else np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def ask_words(chunk: int, t: pa.Table | Tokens, buckets: int) -> pa.Table:
    k = t if isinstance(t, Tokens) else Tokens(t)
    n = np.bincount(k.id[k.train], minlength=len(k.words)).astype(np.int64)
    order, at = _deal(k.words, buckets)
    w, n = k.words[order], n[order]
    return _table([(chunk, b, 0, _pack(np.diff(w[lo:hi].view(np.int64), prepend=0)), _pack(n[lo:hi]), b"", b"", b"", b"") for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo])


def answer_words(t: pa.Table) -> pa.Table:
    """To each chunk: the counts of its words and the frequent ones' numbers in the bucket; and to no chunk, statistics of the bucket: tokens and types, those of frequent words, types seen once and twice."""
    keys, counts = _keys(t, "a"), [x[0] for x in _unpack(t, "b")]
    values, inv = _ranked(np.concatenate(keys))
    total = np.bincount(inv, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64)
    often = total >= MIN_COUNT
    top = total[often]
    facts = np.stack([total, np.where(often, np.cumsum(often), 0)])
    stats = np.array([total.sum(), (total > 0).sum(), top.sum(), len(top), (total == 1).sum(), (total == 2).sum()], np.int64)
    at = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
    answers = [(c.as_py(), b.as_py(), 1, b"", _pack(facts[:, inv[lo:hi]]), b"", b"", b"", b"") for c, b, lo, hi in zip(t.column("chunk"), t.column("bucket"), at[:-1], at[1:], strict=True)]
    return _table([*answers, (-1, -1, 4, b"", b"", b"", b"", b"", b"", stats.tolist())])


class Root:
    """Corpus statistics and the root's distribution."""

    def __init__(self, t: pa.Table):
        self.n, self.v, top_n, top_v, once, twice = t.filter(pa.array(np.asarray(t.column("kind")) == 4)).column("stat")[0].as_py()
        self.d = float(once / (once + 2 * twice)) if once and twice else 0.5  # between 0 and 1, so that unknown symbols and words seen once have a share
        self.unknown = self.d * self.v / self.n if self.n else 1.0
        self.often = float((top_n - self.d * top_v) / self.n) if self.n else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.d) / max(self.n, 1), self.unknown)


def known(k: Tokens, t: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The corpus count of each of the chunk's words, and its name: a number that frequent words have in all chunks, shorter than their hash."""
    t = t.filter(pa.array(np.asarray(t.column("kind")) == 1))
    t = t.take(np.argsort(np.asarray(t.column("bucket"))))
    order, _ = _deal(k.words, buckets)
    facts = _unpack(t, "b", 2)
    bucket = np.repeat(np.asarray(t.column("bucket")), [x.shape[1] for x in facts])
    both = np.empty((2, len(order)), np.int64)
    both[:, order] = np.concatenate(facts, axis=1)
    both[1, order] = both[1, order] * buckets + bucket
    return both[0], both[1].view(np.uint64)


def _pair(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of pairs of names."""
    return vec.mix(before * _K ^ last)


class Paths:
    """Contexts of one word at a chunk's tokens `at`: each one's row, and that of its (context, follower) pair."""

    def __init__(self, k: Tokens, count: np.ndarray, name: np.ndarray, root: Root):
        often = (count >= MIN_COUNT)[k.id]
        at = np.flatnonzero(k.own[1:] == k.own[:-1]) + 1
        at = at[often[at - 1]]
        self.at = at
        words = np.flatnonzero(count >= MIN_COUNT)
        words = words[np.argsort(name[words])]
        self.words, self.names, self.count = words, name[words], count[words]
        number = np.zeros(len(count), np.int64)
        number[words] = np.arange(len(words))
        tok = number[k.id]
        self.ctx_num = np.flatnonzero(np.bincount(tok[at - 1], minlength=len(words)))
        number[self.ctx_num] = np.arange(len(self.ctx_num))  # from here on of contexts
        self.row = number[tok[at - 1]]
        self.ctx = self.names[self.ctx_num]
        self.before_num, self.ctx_before, self.ctx_last = np.zeros(len(self.ctx), np.int64), np.zeros(len(self.ctx), np.uint64), self.ctx
        train = k.train[at]
        self.ctx_n = np.bincount(self.row[train], minlength=len(self.ctx)).astype(np.int64)
        f = self.edge_at = np.flatnonzero(often[at])
        edge = self.row[f] * len(words) + tok[at[f]]
        first, self.edge_row = _distinct(edge)
        self.edge = edge[first]
        self.edge_ctx, self.edge_num = np.divmod(self.edge, max(1, len(words)))
        self.edge_n = np.bincount(self.edge_row[train[f]], minlength=len(first)).astype(np.int64)

    def dealt(self, buckets: int) -> tuple[np.ndarray, ...]:
        """Contexts by bucket, the bounds, the followers' order and each one's context in it."""
        most = len(self.names)
        b = (vec.mix(self.ctx ^ _K) % np.uint64(buckets)).astype(np.int64)
        if buckets * most**2 < 1 << 62:
            order = np.argsort((b * most + self.ctx_num) * most + self.before_num)
        else:
            order = np.lexsort((self.before_num, self.ctx_num, b))
        size = np.bincount(self.edge_ctx, minlength=len(order))  # followers are sorted by context
        e_order = vec.ranges((np.cumsum(size) - size)[order], size[order])
        return order, np.searchsorted(b[order], np.arange(buckets + 1)), e_order, np.repeat(np.arange(len(order)), size[order])

    def read(self, found: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The answers: for each context whether it is retained, its tokens, those with a frequent follower, frequent followers, open; for each follower its tokens."""
        found = found.take(np.argsort(np.asarray(found.column("bucket"))))
        order, _, e_order, _ = self.dealt(buckets)
        facts, n = np.zeros((5, len(order)), np.int64), np.zeros(len(e_order), np.int64)
        if found.num_rows:
            facts[:, order] = np.concatenate(_unpack(found, "b", 5), axis=1)
            n[e_order] = np.concatenate(_unpack(found, "d"), axis=1)[0]
        return facts, n


def _numbers(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As _ranked, of numbers below `most`."""
    if len(x) < most >> 3:  # of a bucket of many
        return np.unique(x, return_inverse=True)
    there = np.bincount(x, minlength=most) > 0
    return np.flatnonzero(there), (there.cumsum() - 1)[x]


def _send(chunk: int, p: Paths | Pairs, head: list[float], buckets: int) -> pa.Table:
    """Counts of contexts and followers; of pairs, with those of their suffixes."""
    order, at, e_order, e_ctx = p.dealt(buckets)
    e_at = np.searchsorted(e_ctx, at)
    head = np.array(head).tobytes()
    rows = []
    for b in range(buckets):
        lo, hi, i, j = at[b], at[b + 1], e_at[b], e_at[b + 1]
        if hi > lo:
            o, e = order[lo:hi], e_order[i:j]
            info = [np.diff(p.ctx_last[o].view(np.int64), prepend=0), np.diff(p.ctx_before[o].view(np.int64), prepend=0), p.ctx_n[o]]
            words, at_word = _numbers(p.edge_num[e], len(p.names))
            table = np.stack([np.diff(p.names[words].view(np.int64), prepend=0), p.count[words]])
            tail, more = [p.edge_n[e]], b""
            if isinstance(p, Pairs):
                last, inv = _numbers(p.ctx_num[o], len(p.names))
                info[0] = np.diff(inv, prepend=0)
                more = _pack(np.stack([np.diff(p.names[last].view(np.int64), prepend=0), *p.suffix[:, last]]))
                tail.append(p.suffix_n[e])
            steps = np.diff((e_ctx[i:j] - lo) * len(words) + at_word, prepend=0)  # followers ascend in each context
            rows.append((chunk, b, 2, more, _pack(np.stack(info)), _pack(steps), _pack(table), head, _pack(np.stack(tail))))
    return _table(rows)


def ask_paths(chunk: int, t: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not t.num_rows:
        return _table([])
    k, root = Tokens(t), Root(answers)
    return _send(chunk, Paths(k, *known(k, answers, buckets), root), [root.often, root.d, root.n], buckets)


def _usual(n, d, kinds, q, part, c):
    """A frequent follower's probability, q being the suffix's."""
    return (np.maximum(n - d, 0) + (min(d, 1) * kinds + 0.5) * q / part) / (c + 1)


def judge(d: float, e_ctx: np.ndarray, n: np.ndarray, q: np.ndarray, c: np.ndarray, part: np.ndarray):
    """For contexts with c tokens and n of each frequent follower: retained, tokens with a frequent follower, frequent followers, whether a longer context can be retained, and the followers' probabilities and their sum in the longest state by now. q and part are the suffix's.

    Not open, which loses no state: what repeats no more but as a whole (a longer context with the same tokens gains
    less than its price), one follower (as its share grows with its tokens), and contexts of which no selection of
    tokens could gain enough (`most`).
    """
    seen = np.bincount(e_ctx, weights=n, minlength=len(c)).astype(np.float64)
    kinds = np.bincount(e_ctx, weights=n > 0, minlength=len(c)).astype(np.float64)
    rest = c - seen
    with np.errstate(divide="ignore", invalid="ignore"):
        p = _usual(n, d, kinds[e_ctx], q, part[e_ctx], c[e_ctx])
        gain = np.bincount(e_ctx, weights=n * np.log(p / q), minlength=len(c)).astype(np.float64)
        gain += np.where(rest > 0, rest * np.log((rest + 0.5) / (c + 1) / (1 - part)), 0)
        sane = (part > 0) & (part < 1)
        keep = sane & (c >= REPEATED) & (gain > GAIN + kinds)
        q, part = np.where(keep[e_ctx], p, q), np.where(keep, (seen + 0.5) / (c + 1), part)
        open_ = sane & (c > REPEATED) & (kinds + (rest > 0) > 1)
    at = np.flatnonzero(open_)
    place = np.zeros(len(c), np.int64)
    place[at] = np.arange(len(at))
    e = np.flatnonzero(open_[e_ctx] & (n > 0))
    open_[at] = most(place[e_ctx[e]], n[e], q[e], c[at], rest[at], part[at]) > GAIN - 1e-6
    return keep, seen, kinds, open_, q, part


def most(e_ctx: np.ndarray, n: np.ndarray, q: np.ndarray, c: np.ndarray, rest: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A bound of what any selection of the contexts' tokens gains, less 1 for each frequent follower in it.

    By Gibbs' inequality no distribution gains more than the shares themselves, sum n log(n / q) - N log N. This is convex
    in the counts, so the best selection takes followers as a whole. The one with most tokens is tried in and out; for
    the others -N log N is replaced by tangents, which lie above it, at a few places M.
    """
    top = np.zeros(len(c))
    np.maximum.at(top, e_ctx, n)
    lead = np.full(len(c), -1)
    first = np.flatnonzero(n == top[e_ctx])
    lead[e_ctx[first]] = first
    with np.errstate(divide="ignore", invalid="ignore"):
        own = n * np.log(n / q)
        rest_own = np.where(rest > 0, rest * np.log(rest / (1 - part)), 0)
        other = lead[e_ctx] != np.arange(len(n))
        x, n_x, own_x = e_ctx[other], n[other], own[other] - 1
        has = lead >= 0
        led = np.where(has, own[lead] - 1, 0) if len(n) else np.zeros(len(c))

        def tangent(m: np.ndarray) -> np.ndarray:
            slope = np.log(m) + 1
            return m + np.bincount(x, weights=np.maximum(own_x - n_x * slope[x], 0), minlength=len(c)) + np.maximum(rest_own - rest * slope, 0)

        without = np.min([tangent(np.maximum(c - top, 0.5) * f) for f in (1, 0.6, 0.37, 0.15, 0.05)], axis=0)
        having = np.min([tangent(m) + led - top * (np.log(m) + 1) for m in (np.maximum(top + (c - top) * f, 0.5) for f in (0, 0.2, 0.5, 1))], axis=0)
    return np.maximum(without, np.where(has, having, without))


def answer_paths(t: pa.Table) -> pa.Table:
    """To each chunk, for its contexts: retained, tokens, those with a frequent follower, frequent followers (zeros where it isn't retained), and open; for its followers: tokens, zero where that is neither of a retained context nor repeats."""
    info = _unpack(t, "b", 3)
    for x in info:
        np.cumsum(x[:2], axis=1, out=x[:2])
    often, d, total = np.frombuffer(t.column("e")[0].as_py(), np.float64).tolist()
    pairs = len(t.column("a")[0].as_py()) > 0
    if pairs:
        lasts = _unpack(t, "a", 5)
        below = np.concatenate([x[1:, i[0]] for x, i in zip(lasts, info, strict=True)], axis=1)
        for x, i in zip(lasts, info, strict=True):
            i[0] = x[0].cumsum()[i[0]]
    keys = [_pair(x[1].view(np.uint64), x[0].view(np.uint64)) if pairs else x[0].view(np.uint64) for x in info]
    lists, tails, words = [x[0].cumsum() for x in _unpack(t, "c")], _unpack(t, "f", 2 if pairs else 1), _unpack(t, "d", 2)
    ctx, first, inv = _first(np.concatenate(keys))
    c = np.bincount(inv, weights=np.concatenate([x[2] for x in info]), minlength=len(ctx)).astype(np.float64)
    base = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
    _, w_first, word = _first(np.concatenate([w[0].cumsum() for w in words]))
    w_base = np.cumsum([w.shape[1] for w in words]) - [w.shape[1] for w in words]
    edge = np.empty(sum(map(len, lists)), np.int64)
    at = 0
    for x, w, b, wb in zip(lists, words, base[:-1], w_base, strict=True):
        of, follower = np.divmod(x, max(1, w.shape[1]))
        edge[at : at + len(x)] = inv[b + of] * len(w_first) + word[wb + follower]
        at += len(x)
    e_first, e_inv = _distinct(edge)
    e_ctx, word = np.divmod(edge[e_first], max(1, len(w_first)))
    q = (np.concatenate([w[1] for w in words])[w_first][word] - d) / max(total, 1)
    n = np.bincount(e_inv, weights=np.concatenate([x[0] for x in tails]), minlength=len(e_first)).astype(np.float64)
    part = np.full(len(ctx), often)
    if pairs:
        had, of, seen, kinds = below[:, first]
        n1 = np.concatenate([x[1] for x in tails])[e_first]
        q = np.where(had[e_ctx] > 0, _usual(n1, d, kinds[e_ctx], q, often, of[e_ctx]), q)
        part = np.where(had > 0, (seen + 0.5) / (of + 1), often)
    keep, seen, kinds, open_, _, _ = judge(d, e_ctx, n, q, c, part)
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    facts, n = np.stack([keep, c * keep, seen * keep, kinds * keep, open_]), n * (keep[e_ctx] | (n >= REPEATED))
    return _table([
        (ch.as_py(), b.as_py(), 5 if pairs else 3, b"", _pack(facts[:, inv[lo:hi]]), b"", _pack(n[e_inv[i:j]]), b"", b"")
        for ch, b, lo, hi, i, j in zip(t.column("chunk"), t.column("bucket"), base[:-1], base[1:], sizes[:-1], sizes[1:], strict=True)
    ])


def _of(answers: pa.Table, kind: int) -> pa.Table:
    return answers.filter(pa.array(np.asarray(answers.column("kind")) == kind))


def _keep(folder: str, t: pa.Table, open_: int) -> pa.Table:
    """Writes a chunk's row to a file of its own, so that it isn't shuffled; the table has its number, and how much is open in it."""
    from pyspark import TaskContext

    if t.num_rows:
        fs, path = arrow_tokens.filesystem(f"{folder}/{t.column('chunk')[0].as_py():06d}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own) as f, pa.ipc.new_file(f, t.schema) as out:
            out.write_table(t)
        fs.move(own, path)
    return pa.table({"chunk": t.column("chunk"), "open": pa.array([open_] * t.num_rows, pa.int64())})


def _kept(folder: str, chunk: int, columns: list[str] | None = None) -> pa.Table:
    fs, path = arrow_tokens.filesystem(f"{folder}/{chunk:06d}")
    with fs.open_input_file(path) as f:
        t = pa.ipc.open_file(f).read_all()
    return t.select(columns) if columns else t


def _row(schema: str, values: list) -> pa.Table:
    """A table of one row, or of none."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    cols = [x.split() for x in schema.split(", ")]
    types = [pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t] for _, t in cols]
    return pa.table({n: pa.array([v] if values else [], t) for (n, _), v, t in zip(cols, values or [None] * len(cols), types, strict=True)})


def begin(chunk: int, t: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The chunk's scores with contexts of up to one word, but of frequent tokens that two could change; its tokens by numbers, 0 being a rare word, and what is known of its frequent words and of pairs."""
    if not t.num_rows:
        return _row(ONE, [])
    k, root = Tokens(t), Root(answers)
    count, name = known(k, answers, buckets)
    q = Paths(k, count, name, root)
    facts, n_edge = q.read(_of(answers, 3), buckets)
    keep, of, seen, kinds, open_ = facts
    number, chance = np.zeros(len(count), np.int64), root.p(count)
    number[q.words] = np.arange(1, len(q.words) + 1)
    tok, p, n = number[k.id], chance[k.id], np.zeros(len(k.id), np.int64)
    used = np.zeros(len(tok), bool)
    used[q.at] = keep[q.row] > 0
    x, before = q.edge_ctx, chance[q.words][q.edge_num]
    usual = np.where(keep[x] > 0, _usual(n_edge, root.d, kinds[x], before, root.often, of[x]), before)
    edges = q.at[q.edge_at]
    p[edges], n[edges] = usual[q.edge_row], n_edge[q.edge_row]
    rare = np.ones(len(q.at), bool)
    rare[q.edge_at] = False
    rare &= used[q.at]
    x, rare = q.row[rare], q.at[rare]
    p[rare] = p[rare] * (of[x] - seen[x] + 0.5) / (of[x] + 1) / (1 - root.often)
    facts = np.zeros((4, len(q.words) + 1), np.int64)  # what follows a word, if it isn't always the end of the text
    facts[:, q.ctx_num + 1] = [keep, seen, kinds, open_]
    later = np.zeros(len(tok), bool)
    later[two(tok, n, facts[3], k.first[:-1][k.own])] = True
    per = lambda x: np.add.reduceat(x, k.first[:-1])
    base = np.log10((count + 1) / (root.n + 1.0 * (root.v + 1)))[k.id]
    docs = [k.doc_id, k.held, np.diff(k.first), per((count > 0).astype(np.int64)[k.id]), np.full(len(k.doc_id), root.n, np.int64), per(base), per(np.where(later & (tok > 0), 0, np.log10(p))), per((~later & used).astype(np.int64))]
    table = np.stack([np.diff(q.names.view(np.int64), prepend=0), q.count, *facts[:, 1:]])
    return _row(ONE, [chunk, root.d, root.often, *docs, _pack(tok), _pack(n), _pack(table)])


def two(tok: np.ndarray, n: np.ndarray, open_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens whose context of two words repeats and can be a state; n has the tokens of each word after the one before it."""
    usual = tok > 0
    ok = np.zeros(len(tok), bool)
    ok[2:] = (usual & (open_ > 0)[tok] & (n >= REPEATED))[1:-1] & usual[:-2]
    return np.flatnonzero(ok & (np.arange(len(tok)) - first >= 2))


class Pairs:
    """Contexts of two words of a chunk's row, as Paths has those of one."""

    def __init__(self, row: dict):
        self.n_tokens = np.array(row["n_tokens"], np.int64)
        self.tok, self.n = _loads(row["tok"]), _loads(row["pairs"])
        self.own = np.repeat(np.arange(len(self.n_tokens)), self.n_tokens)
        self.first = (np.cumsum(self.n_tokens) - self.n_tokens)[self.own]
        table = _loads(row["words"]).reshape(6, -1)
        names, count, *facts = np.concatenate([np.zeros((6, 1), np.int64), table], axis=1)
        names = names.cumsum().view(np.uint64)
        self.names, self.count, (keep, seen, kinds, self.open) = names, count, facts
        at = self.at = two(self.tok, self.n, self.open, self.first)
        last, word = self.tok[at - 1], self.tok[at]
        first, self.row = _distinct(self.tok[at - 2] * len(names) + last)
        self.before_num = self.tok[at - 2][first]
        self.ctx_before, self.ctx_last = names[self.before_num], names[last[first]]
        self.ctx = _pair(self.ctx_before, self.ctx_last)
        self.train = ~np.array(row["held_out"], bool)[self.own[at]]
        self.ctx_n = np.bincount(self.row[self.train], minlength=len(self.ctx)).astype(np.int64)
        self.ctx_num = last[first]
        self.suffix = np.stack([keep, count * keep, seen, kinds])
        f = self.edge_at = np.flatnonzero(word > 0)
        edge = self.row[f] * len(names) + word[f]
        first, self.edge_row = _distinct(edge)
        self.edge_ctx, self.edge_num = np.divmod(edge[first], len(names))
        self.edge_n = np.bincount(self.edge_row[self.train[f]], minlength=len(first)).astype(np.int64)
        self.suffix_n = self.n[at[f[first]]]

    dealt, read = Paths.dealt, Paths.read


def ask_pairs(row: dict, total: int, buckets: int) -> pa.Table:
    return _send(row["chunk"], Pairs(row), [row["often"], row["d"], total], buckets)


def _state(chunk: int, docs: list, at: dict[str, np.ndarray], tok: np.ndarray, d: float) -> pa.Table:
    """A row of a chunk: its documents' columns, and the tokens whose longest state isn't known yet with the words before them."""
    need = np.bincount(at["end"] - at["reach"], minlength=len(tok) + 1) - np.bincount(at["end"] + 1, minlength=len(tok) + 1)
    need = need.cumsum()[:-1] > 0
    place = np.concatenate(([0], need.cumsum()))
    at = at | {"end": place[at["end"]], "reach": place[at["end"]] - at["reach"]}  # where it begins
    at |= {c: np.diff(at[c], prepend=0) for c in ("end", "reach", "doc")}
    return _row(STATE, [chunk, len(at["end"]), d, *docs, *(_pack(at[c]) for c in AT[:-2]), *(_pack_equal(at[c]) for c in AT[-2:]), _pack(tok[need].view(np.int64))])


def _settled(docs: list, a: dict, end: np.ndarray) -> list:
    """The documents' columns with the tokens `end` in them."""
    size = len(docs[0])
    score = np.array(docs[-2]) + np.bincount(a["doc"][end], weights=np.log10(a["p"][end]), minlength=size)
    return [*docs[:-2], score, np.array(docs[-1]) + np.bincount(a["doc"][end], weights=a["used"][end] > 0, minlength=size).astype(np.int64)]


def start(row: dict, answers: pa.Table, total: int, buckets: int) -> pa.Table:
    """The chunk's scores with contexts of up to two words, and what longer ones can change."""
    q, d, often = Pairs(row), row["d"], row["often"]
    (keep2, of2, seen2, kinds2, open2), n2 = q.read(answers, buckets)
    at, tok, keep2 = q.at, q.tok, keep2 > 0
    keep, of, seen, kinds = q.suffix[:, q.ctx_num]
    part = np.where(keep > 0, (seen + 0.5) / (of + 1), often)
    x = q.edge_ctx
    p = (q.count[q.edge_num] - d) / max(total, 1)
    p = np.where(keep[x] > 0, _usual(q.suffix_n, d, kinds[x], p, often, of[x]), p)
    p = np.where(keep2[x], _usual(n2, d, kinds2[x], p, part[x], of2[x]), p)
    own = np.where(keep2, (of2 - seen2 + 0.5) / (of2 + 1) / (1 - part), 1.0)  # of a rare word a factor
    chance = own[q.row]
    chance[q.edge_at] = p[q.edge_row]
    part = np.where(keep2, (seen2 + 0.5) / (of2 + 1), part)
    used = np.where(keep2, 2, np.where(keep > 0, 1, 0))
    place = np.arange(len(tok))
    repeats = (q.n >= REPEATED) & np.concatenate(([False], q.n[:-1] >= REPEATED))  # the three words that end here
    repeats[at] = False
    repeats[at[q.edge_at]] = (n2 >= REPEATED)[q.edge_row]
    repeats &= place - q.first >= 2
    bad = np.maximum.accumulate(np.where(repeats, -1, place))
    alive = (open2 > 0)[q.row] & repeats[at - 1]
    h = q.names[tok]
    values = {"doc": q.own[at], "used": used[q.row], "p": chance}
    docs = _settled([row[c] for c in DOCS], values, ~alive)
    at, i = at[alive], q.row[alive]
    values = {c: v[alive] for c, v in values.items()} | {"end": at, "reach": at - bad[at - 1] + 1, "n": q.train[alive].astype(np.int64), "part": part[i]}
    return _state(row["chunk"], docs, values, h, d)


class Open:
    """The open tokens of a chunk's row, and the `width` words before their contexts of `length` words. Those with the same context, follower and words are one."""

    def __init__(self, row: dict, length: int, width: int):
        a = self.at = {c: _loads(row[c]) for c in AT[:-2]} | {c: _loads_equal(row[c]) for c in AT[-2:]}
        a |= {c: a[c].cumsum() for c in ("end", "reach", "doc")}
        a["reach"] = a["end"] - a["reach"]
        self.tok = _loads(row["tok"])
        a["word"] = self.tok[a["end"]]
        levels = self.levels(max(length, width))
        a["key"] = self.runs(levels, a["end"] - 1, np.full(len(a["end"]), length))
        wide = np.minimum(a["reach"] - length, width)
        key = _edge(a["key"], a["word"].view(np.uint64))
        key = vec.mix(key * _K ^ self.runs(levels, a["end"] - 1 - length, wide))
        self.length, self.width = length, width
        self.first, self.row = _same(key)

    def levels(self, most: int) -> list[np.ndarray]:
        """Hashes of the 1, 2, 4, ... words, up to `most`, that end at each place."""
        out, k = [vec.mix(self.tok.view(np.uint64))], 1
        while 2 * k <= most:
            x = out[-1]
            out.append(vec.mix(x * _K ^ np.concatenate((x[:k], x[:-k]))))
            k *= 2
        return out

    @staticmethod
    def runs(levels: list[np.ndarray], end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of the `size` words that end at each of the places, from the hashes of powers of two."""
        out, end = size.astype(np.uint64), end.copy()
        for k in range(len(levels) - 1, -1, -1):
            i = np.flatnonzero(size >> k & 1)
            if len(i):
                out[i] = vec.mix(out[i] * _K ^ levels[k][end[i]])
                end[i] -= 1 << k
        return out

    def words(self, i: np.ndarray) -> np.ndarray:
        """The words before the contexts of the open tokens `i`, nearest first, in `width` rows; 0 is none."""
        end, reach = self.at["end"][i], self.at["reach"][i]
        back = np.arange(self.length, self.length + self.width)[:, None]
        return np.where(reach > back, self.tok[np.maximum(end - 1 - back, 0)], 0)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        key = self.at["key"][self.first]
        return _deal(key, buckets, self.at["word"][self.first], key)


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, row): where each value comes first, in that order, and each value's place among these."""
    row = pa.array(x).dictionary_encode().indices.to_numpy().astype(np.int64)
    most = np.maximum.accumulate(row) if len(row) else row
    return np.flatnonzero(np.diff(most, prepend=-1)), row


def _loads(raw: bytes) -> np.ndarray:
    return _unpack(pa.table({"x": pa.array([raw], pa.binary())}), "x")[0][0]


def _pack_equal(x: np.ndarray) -> bytes:
    """Floats of which many are equal: the distinct ones, and places in them."""
    e = pa.array(x.view(np.int64)).dictionary_encode()
    values = _pack(e.dictionary.to_numpy(zero_copy_only=False))
    return np.int64(len(values)).tobytes() + values + _pack(e.indices.to_numpy())


def _loads_equal(raw: bytes) -> np.ndarray:
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    return _loads(raw[8 : 8 + size])[_loads(raw[8 + size :])].view(np.float64)


def ask_open(row: dict, length: int, width: int, buckets: int) -> pa.Table:
    o = Open(row, length, width)
    order, at = o.dealt(buckets)
    n = np.bincount(o.row, weights=o.at["n"], minlength=len(o.first)).astype(np.int64)
    rows = []
    for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if hi > lo:
            i = o.first[order[lo:hi]]
            a = {c: x[i] for c, x in o.at.items()}
            key, first, node = np.unique(a["key"], return_index=True, return_inverse=True)
            info = np.stack([np.diff(key.view(np.int64), prepend=0), a["part"][first].view(np.int64)])
            words = o.words(i)
            usual = a["word"] > 0
            p = a["p"][usual]  # one for each (context, follower)
            new = np.concatenate(([True], (node[usual][1:] != node[usual][:-1]) | (a["word"][usual][1:] != a["word"][usual][:-1])))[: len(p)]
            rows.append((row["chunk"], b, 6, _pack(info), _pack(np.stack([np.diff(node, prepend=0), a["word"], n[order[lo:hi]]])), _pack(p[new].view(np.int64)), _pack(words), np.float64(row["d"]).tobytes(), b""))
    return _table(rows)


def _parted(word: np.ndarray, node: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose nodes all have one word before them, and the others.

    What `judge` says of a node with the same tokens doesn't change: where it wasn't retained, nothing it is judged by
    does, and where it was, a longer one gains min(d, 1) * kinds + 0.5 at most, less than its price.
    """
    parted = np.zeros(len(node), bool)
    w = word[here]
    parted[node[here[(w != word[node[here]]) | (w == 0)]]] = True
    parted = parted[node[here]]
    return here[~parted], here[parted]


def answer_open(t: pa.Table, length: int, width: int) -> pa.Table:
    """All states among the contexts that are up to `width` words longer. To each chunk, for its rows: the length of the longest state, whether it is open, and where there is a state the follower's probability (of a rare one, its factor), and the frequent ones' sum where it is open, too."""
    d = float(np.frombuffer(t.column("e")[0].as_py(), np.float64)[0])
    infos, rows, ps = _unpack(t, "a", 2), _unpack(t, "b", 3), _unpack(t, "c")
    sizes = np.array([x.shape[1] for x in rows])
    words = np.concatenate(_unpack(t, "d", width), axis=1)
    keys, parts, p = [], [], []
    for info, x, raw in zip(infos, rows, ps, strict=True):
        node = x[0].cumsum()
        keys.append(info[0].cumsum()[node])
        parts.append(info[1][node].view(np.float64))
        usual = x[1] > 0
        new = np.concatenate(([True], (np.diff(node[usual]) != 0) | (np.diff(x[1][usual]) != 0)))[: usual.sum()]
        mine = np.ones(len(node))
        mine[usual] = raw[0].view(np.float64)[np.cumsum(new) - 1]
        p.append(mine)
    _, node = np.unique(np.concatenate(keys), return_inverse=True)
    part, p = np.concatenate(parts), np.concatenate(p)
    _, follower = np.unique(np.concatenate([x[1] for x in rows]), return_inverse=True)
    usual = np.concatenate([x[1] for x in rows]) > 0
    n = np.concatenate([x[2] for x in rows]).astype(np.float64)
    used = np.zeros(len(n), np.int64)
    most = int(follower.max()) + 1
    same, here = np.zeros(0, np.int64), np.arange(len(n))
    for i in range(width):
        if i:  # nodes that go on with all of their tokens stay as they were judged; a node is known by one of its rows
            same, here = _parted(words[i], node, np.concatenate((same, here)))
        here = here[words[i, here] > 0]
        if not len(here):
            if not len(same):
                break
            continue
        _, w = np.unique(words[i, here], return_inverse=True)
        _, first, ctx = np.unique(node[here] * (int(w.max()) + 1) + w, return_index=True, return_inverse=True)
        node[here] = here[first][ctx]
        c = np.bincount(ctx, weights=n[here])
        f = np.flatnonzero(usual[here])
        edge, e_first, e_inv = np.unique(ctx[f] * most + follower[here[f]], return_index=True, return_inverse=True)
        e_n = np.bincount(e_inv, weights=n[here[f]], minlength=len(edge))
        e_ctx, before = ctx[f[e_first]], part[here[first]]
        keep, seen, _, open_, q, after = judge(d, e_ctx, e_n, p[here[f[e_first]]], c, before)
        p[here[f]] = q[e_inv]
        r = np.flatnonzero(~usual[here] & keep[ctx])
        x = ctx[r]
        p[here[r]] *= (c[x] - seen[x] + 0.5) / (c[x] + 1) / (1 - before[x])
        part[here] = after[ctx]
        used[here[keep[ctx]]] = length + i + 1
        here = here[open_[ctx]]
    here = np.concatenate((same, here))
    alive = np.zeros(len(n), np.int64)
    alive[here] = 1
    at = np.concatenate(([0], sizes.cumsum()))
    out = []
    for ch, b, lo, hi in zip(t.column("chunk"), t.column("bucket"), at[:-1], at[1:], strict=True):
        s = used[lo:hi] > 0
        out.append((ch.as_py(), b.as_py(), 7, b"", _pack(np.stack([used[lo:hi], alive[lo:hi]])), _pack(p[lo:hi][s].view(np.int64)), _pack(part[lo:hi][s & (alive[lo:hi] > 0)].view(np.int64)), b"", b""))
    return _table(out)


def take(row: dict, answers: pa.Table, length: int, width: int, buckets: int) -> pa.Table:
    """The chunk's row after the answers."""
    o = Open(row, length, width)
    docs, a = [row[c] for c in DOCS], dict(o.at)
    if answers.num_rows:
        answers = answers.take(np.argsort(np.asarray(answers.column("bucket"))))
        order, _ = o.dealt(buckets)
        used, alive = np.concatenate(_unpack(answers, "b", 2), axis=1)
        s = used > 0
        p, part = np.ones(len(order)), np.zeros(len(order))
        p[s] = np.concatenate([x[0] for x in _unpack(answers, "c")]).view(np.float64)
        part[s & (alive > 0)] = np.concatenate([x[0] for x in _unpack(answers, "d")]).view(np.float64)
        back = lambda x: (lambda y: (y.__setitem__(order, x), y)[1])(np.empty(len(order), x.dtype))[o.row]
        used, alive, p, part = back(used), back(alive), back(p), back(part)
        s = used > 0
        a["p"] = np.where(s, np.where(a["word"] > 0, p, a["p"] * p), a["p"])
        a["part"] = np.where(s, part, a["part"])
        a["used"] = np.where(s, used, a["used"])
        alive = (alive > 0) & (a["reach"] > length + width)
        docs = _settled(docs, a, ~alive)
        a = {c: x[alive] for c, x in a.items()}
    return _state(row["chunk"], docs, a, o.tok, row["d"])


def scores(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Scores of all rows of docs(doc_id, text, held), learning from those with held false."""
    spark = docs.sparkSession
    common.batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held", F.lit(False)).alias("held"))
    n = chunks or common.chunk_count(base, CHUNK)
    buckets = max(2, n // 3)
    dealt = common.chunked(base, n, "text", "held")
    kept, folder, parts = common.shared_dir(spark), common.shared_dir(spark), max(1, min(n, max(12, n // 3)))

    def ask(key, t):
        chunk, k = key[0].as_py(), Tokens(t)
        _keep(kept, k.row(chunk), 1)
        return ask_words(chunk, k, buckets)

    told = common.cut(dealt.groupBy("chunk").applyInArrow(ask, ROWS).groupBy("bucket").applyInArrow(lambda t: answer_words(t), ROWS))
    total = told.where("kind = 4").agg(F.array(*(F.coalesce(F.sum(F.col("stat")[i]), F.lit(0)) for i in range(6))).alias("stat"))
    blank = [F.lit(None).cast("binary").alias(c) for c in "abcdef"]
    stats = total.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"), F.lit(-1).alias("bucket"), F.lit(4).alias("kind"), *blank, "stat")
    vocab = told.where("kind = 1").unionAll(stats)

    def second(key, a):
        there = _of(a, 1).num_rows  # a chunk has a text at least, and that an end
        return ask_paths(key[0].as_py(), _kept(kept, key[0].as_py()), a, buckets) if there else _table([])

    def first(key, a):
        return _keep(folder, begin(key[0].as_py(), _kept(kept, key[0].as_py()), a, buckets), 1) if _of(a, 1).num_rows else pa.table({"chunk": pa.array([], pa.int32()), "open": pa.array([], pa.int64())})

    found = vocab.repartition(parts, "chunk").groupBy("chunk").applyInArrow(second, ROWS).groupBy("bucket").applyInArrow(lambda t: answer_paths(t), ROWS)
    done = common.cut(vocab.unionAll(found).repartition(parts, "chunk").groupBy("chunk").applyInArrow(first, DONE))
    common.remove(spark, told)
    common.remove_folder(spark, kept)
    length, width = 1, 1
    while done.agg(F.sum("open")).first()[0]:
        done, folder = longer(done, folder, parts, buckets, length, width)
        length += width
        width = max(2, length)

    def rows(batches):
        for x in batches:
            for chunk in x.column(0).to_pylist():
                yield from pa.table(dict(zip(DOCS, (c.combine_chunks().flatten() for c in _kept(last, chunk, DOCS).columns), strict=True))).to_batches()

    last = folder
    return done.repartition(parts, "chunk").mapInArrow(rows, SCHEMA)


def longer(done: DataFrame, folder: str, parts: int, buckets: int, length: int, width: int) -> tuple[DataFrame, str]:
    """The chunks after contexts of up to `length` + `width` words, and the new folder of their rows. Each step's shuffle files go at its end."""
    spark = done.sparkSession
    new = common.shared_dir(spark)

    def ask(batches):
        for x in batches:
            for chunk in x.column(0).to_pylist():
                row = _kept(folder, chunk).to_pylist()[0]
                yield from (ask_open(row, length, width, buckets) if length > 1 else ask_pairs(row, row["train_tokens"][0], buckets)).to_batches()

    def answer(t):
        return answer_open(t, length, width) if length > 1 else answer_paths(t)

    def answered(key, t, a):
        row = _kept(folder, key[0].as_py())
        if length > 1 and not row.column("open")[0].as_py():
            return _keep(new, row, 0)
        row = row.to_pylist()[0]
        after = take(row, a, length, width, buckets) if length > 1 else start(row, a, row["train_tokens"][0], buckets)
        return _keep(new, after, after.column("open")[0].as_py())

    found = common.cut(done.where("open > 0").repartition(parts, "chunk").mapInArrow(ask, ROWS).groupBy("bucket").applyInArrow(answer, ROWS))
    after = common.cut(done.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(answered, DONE))
    for x in (done, found):
        common.remove(spark, x)
    common.remove_folder(spark, folder)
    return after, new


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held")))
