import collections
import itertools
import math
import random

import numpy as np
import pytest

from inkloom.llm import suffix_tree_lm
from tests.llm.test_models import Tree, held, tokens


class Whole(Tree):
    """Brute force: contexts of any length that repeat, tested from short to long."""

    def __init__(self, texts):
        self._count(texts)
        follow, self.states, length = collections.defaultdict(collections.Counter), {}, 1
        words = [tokens(t) for t in texts]
        while length == 1 or follow:
            follow.clear()
            for w in words:
                for i in range(length, len(w)):
                    if all(x in self.usual for x in w[i - length : i]):
                        follow[tuple(w[i - length : i])][w[i]] += 1
            for ctx in [c for c, after in follow.items() if sum(after.values()) < 2]:
                del follow[ctx]
            more = {ctx: after for ctx, after in follow.items() if self.gain(ctx, after) > suffix_tree_lm.GAIN + sum(f in self.usual for f in after)}
            self.states |= {ctx: collections.Counter(after) for ctx, after in more.items()}
            length += 1

    def _count(self, texts):
        self.count = collections.Counter(w for t in texts for w in tokens(t))
        self.n, once, twice = sum(self.count.values()), *(sum(c == k for c in self.count.values()) for k in (1, 2))
        self.d = once / (once + 2 * twice) if once and twice else 0.5
        self.usual = {w for w, c in self.count.items() if c >= suffix_tree_lm.MIN_COUNT}

    def contexts(self, w, i):
        return [tuple(w[j:i]) for j in range(i - 1, -1, -1)]


def texts(kind):
    r = random.Random(kind)
    if kind == "order":  # a word follows from the five before it, mostly
        for i in range(250):
            w = [r.randrange(3) for _ in range(5)]
            while len(w) < 90:
                w.append((w[-1] + 2 * w[-2] + w[-5]) % 3 if r.random() < 0.9 else r.randrange(25))
            yield i, " ".join(f"v{x}" for x in w)
    else:  # copies with changes, passages whose end is told by a word far before it, words seen once
        long = [[f"{k}c{x}" for x in range(60)] for k in range(3)]
        for i in range(240):
            w = list(long[i % 3])
            for _ in range(r.randrange(4)):
                w[r.randrange(60)] = r.choice(["x", "y", f"once{r.randrange(9999)}"])
            side = i // 3 % 2
            w += ["left", "right"][side : side + 1] + [f"s{x}" for x in range(40)] + ["ends", f"{'ab'[side]}"] + [f"rare{i}"] * (i % 5 == 0)
            yield i, " ".join(w)
        yield from ((500 + j, t) for j, t in enumerate([None, "", "left", "s1 " * 70, " ".join(f"s{x}" for x in range(40)) + " ends unseen"]))


@pytest.mark.parametrize("kind", ["order", "copies"])
def test_contexts_of_any_length(spark, kind):
    rows = list(texts(kind))
    tree = Whole([t for i, t in rows if not held(i)])
    assert max(len(c) for c in tree.states) >= (4 if kind == "order" else 42)
    df = spark.createDataFrame([(i, t, held(i)) for i, t in rows], "doc_id long, text string, held boolean").repartition(3)
    for chunks in (1, 5):
        got = {r.doc_id: r.score for r in suffix_tree_lm.scores(df, chunks=chunks).collect()}
        assert got.keys() == {i for i, _ in rows}
        for i, t in rows:
            assert math.isclose(got[i], tree.score(t), rel_tol=1e-9), (chunks, i)


def test_the_bound_is_above_each_selection():
    r = np.random.default_rng(1)
    for _ in range(500):
        k = r.integers(1, 7)
        n, rest = r.integers(1, r.choice([3, 10, 60]), k).astype(float), float(r.integers(0, 5))
        q = r.dirichlet(np.full(k + 2, 0.5))[:k] + 1e-7
        q /= max(1, q.sum() * 1.01)
        part = min(q.sum(), 0.999999)
        bound = suffix_tree_lm.most(np.zeros(k, int), n, q, np.array([n.sum() + rest]), np.array([rest]), np.array([part]))[0]
        for *some, all_rest in itertools.product([False, True], repeat=k + 1):
            a, rare = np.array(some), rest * all_rest
            if total := n[a].sum() + rare:
                gain = (n[a] * np.log(n[a] / q[a])).sum() - total * np.log(total) + (rare * np.log(rare / (1 - part)) if rare else 0)
                assert gain - a.sum() <= bound + 1e-9
