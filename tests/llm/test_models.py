import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkloom.llm import langmix, suffix_tree_lm


def tokens(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [None]


@pytest.fixture(scope="module")
def prose():
    r = random.Random(7)
    after = {w: r.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(400):
        w, out = r.randrange(40), []
        for _ in range(r.randint(0, 120)):
            out.append(f"W{w}" if r.random() < 0.1 else f"w{w}")
            w = r.choice(after[w]) if r.random() < 0.8 else r.randrange(40)
        rows.append((i, " ".join(out)))
    return rows + [(400, None), (401, ""), (402, "never seen words here")]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_scores(spark, prose):
    df = spark.createDataFrame([(i, t, held(i)) for i, t in prose], "doc_id long, text string, held boolean").selectExpr("*", "1 AS chunk", "2 AS a").repartition(3)
    count = collections.Counter(w for i, t in prose if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    runs = {k: {r.doc_id: r for r in suffix_tree_lm.scores(df, chunks=k).collect()} for k in (1, 5)}
    for i, t in prose:
        a, b = runs[1][i], runs[5][i]
        w = tokens(t)
        assert (a.held_out, a.n_tokens, a.n_known, a.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(a.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(a.score, b.score, rel_tol=1e-9) and a.n_context == b.n_context
    out = [r for r in runs[1].values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)
    assert sum(r.n_context for r in out) > 0.5 * sum(r.n_tokens for r in out)


class Tree:
    """Brute force: the model by dictionaries."""

    def __init__(self, texts):
        self.count = collections.Counter(w for t in texts for w in tokens(t))
        self.n, once, twice = sum(self.count.values()), *(sum(c == k for c in self.count.values()) for k in (1, 2))
        self.d = once / (once + 2 * twice) if once and twice else 0.5
        self.usual = {w for w, c in self.count.items() if c >= suffix_tree_lm.MIN_COUNT}
        least = max(suffix_tree_lm.P_PAIR * self.n, suffix_tree_lm.MIN_COUNT)
        self.deep = {w for w, c in self.count.items() if c >= least}
        follow = collections.defaultdict(collections.Counter)
        for t in texts:
            w = tokens(t)
            for i in range(1, len(w)):
                for ctx in self.contexts(w, i):
                    follow[ctx][w[i]] += 1
        self.states = {}
        for level in (1, 2):
            for ctx, after in follow.items():
                if len(ctx) == level and self.gain(ctx, after) > suffix_tree_lm.GAIN + len([f for f in after if f in self.usual]):
                    self.states[ctx] = after

    def contexts(self, w, i):
        out = []
        if i >= 1 and w[i - 1] in self.usual:
            out.append((w[i - 1],))
            if i >= 2 and w[i - 2] in self.deep and w[i - 1] in self.deep:
                out.append((w[i - 2], w[i - 1]))
        return out

    def gain(self, ctx, after):
        own = dict(self.states)
        total, seen = sum(after.values()), sum(c for f, c in after.items() if f in self.usual)
        up, part = ctx[1:], self.part(ctx[1:])
        if not 0 < part < 1:
            return -math.inf
        out = 0.0
        for f, c in after.items():
            if f in self.usual:
                below = self.p(f, up)
                self.states[ctx] = after
                out += c * math.log(self.p(f, ctx) / below)
                self.states = dict(own)
        rest = total - seen
        return out + (rest * math.log((rest + 0.5) / (total + 1) / (1 - part)) if rest else 0)

    def part(self, ctx):
        while ctx and ctx not in self.states:
            ctx = ctx[1:]
        if not ctx:
            return sum(self.count[w] - self.d for w in self.usual) / self.n
        after = self.states[ctx]
        return (sum(c for f, c in after.items() if f in self.usual) + 0.5) / (sum(after.values()) + 1)

    def p(self, f, ctx):
        while ctx and ctx not in self.states:
            ctx = ctx[1:]
        if not ctx:
            return (self.count[f] - self.d) / self.n if self.count[f] else self.d * len(self.count) / self.n
        after, up = self.states[ctx], ctx[1:]
        total, seen = sum(after.values()), sum(c for x, c in after.items() if x in self.usual)
        kinds = sum(x in self.usual for x in after)
        if f in self.usual:
            return (max(after[f] - self.d, 0) + (min(self.d, 1) * kinds + 0.5) * self.p(f, up) / self.part(up)) / (total + 1)
        return self.p(f, up) * (total - seen + 0.5) / (total + 1) / (1 - self.part(up))

    def score(self, t):
        w = tokens(t)
        return sum(math.log10(self.p(w[i], (self.contexts(w, i) or [()])[-1])) for i in range(len(w)))


def test_scores_are_those_of_a_model_by_dictionaries(spark):
    r = random.Random(17)
    prose = [(400, None), (401, ""), (402, "never seen")]
    for i in range(300):  # a word follows from the two before it, mostly
        w = [r.randrange(12), r.randrange(12)]
        while len(w) < r.randint(3, 150):
            w.append((w[-1] * 5 + w[-2] * 3 + 1) % 12 if r.random() < 0.7 else r.randrange(60))
        prose.append((i, " ".join(f"W{x}" if r.random() < 0.1 else f"w{x}" for x in w)))
    tree = Tree([t for i, t in prose if not held(i)])
    assert {len(c) for c in tree.states} == {1, 2}
    for ctx in [(), *list(tree.states)[:40]]:  # each state's distribution has a sum of 1, the unknown symbol being one
        assert math.isclose(sum(tree.p(w, ctx) for w in [*tree.count, "unknown"]), 1, rel_tol=1e-9)
    df = spark.createDataFrame([(i, t, held(i)) for i, t in prose], "doc_id long, text string, held boolean").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree_lm.scores(df, chunks=3).collect()}
    for i, t in prose:
        assert math.isclose(got[i], tree.score(t), rel_tol=1e-9), i


def test_contexts_do_not_depend_on_the_size_of_the_corpus(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"f{r.randrange(1000)}" for _ in range(1000)) + " alpha beta" * (i < 40), False) for i in range(600)]
    df = spark.createDataFrame([*rows, (1000, "alpha beta", True)], "doc_id long, text string, held boolean").repartition(4)
    got = suffix_tree_lm.scores(df, chunks=3).where("doc_id = 1000").first()
    assert got.n_context > 0 and got.score > got.base_score + 3


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in suffix_tree_lm.scores(df).collect()}
    assert got[1].score == 0.0 and got[1].n_tokens == 3 and got[1].train_tokens == 0
    assert suffix_tree_lm.scores(df.limit(0)).count() == 0


def test_languages(spark):
    r = random.Random(5)
    parts = {"en": ["the", "ing", "tion", "ed"], "fr": ["le", "eau", "ou", "é"], "de": ["sch", "ung", "ein", "ü"]}
    make = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(make(k, 60), k) for k in parts for _ in range(30)] + [(None, "en"), ("zzz", None)]
    model = langmix.train(spark.createDataFrame(train, "text string, lang string").repartition(3))
    assert list(model) == sorted(parts)
    rows = [(i, False, make(k, 50)) for i, k in enumerate(["en", "fr", "de"] * 5)]
    rows += [(100, True, None), (101, True, ""), (102, False, "12 3 !"), (103, False, make("en", 200) + " " + make("fr", 200)), (104, False, "a"), (104, False, "a")]
    got = langmix.predict(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").selectExpr("*", "'x' AS lang_pred"), model).collect()
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in range(15)] == ["en", "fr", "de"] * 5
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert sorted(by[103].langs) == ["en", "fr"] and all(0.3 < s < 0.7 for s in by[103].shares)
    assert by[104].lang_pred in parts and len(got) == len(rows)
    none = langmix.train(spark.createDataFrame([], "text string, lang string"))
    assert langmix.predict(spark.createDataFrame(rows[:1], "doc_id long, held_out boolean, text string"), none).first().lang_pred == "und"


@pytest.mark.parametrize("langs", [4, 20])
def test_best_pairs_of_languages_are_found(langs):
    """Against a fit of each pair to its maximum, on texts with a small second language."""
    r = np.random.default_rng(3)
    words = np.array(["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)])
    common = r.dirichlet(np.full(300, 0.3))
    use = np.array([0.5 * common + 0.5 * r.dirichlet(np.full(300, 0.3)) for _ in range(langs)])
    make = lambda k, n: " ".join(r.choice(words, n, p=use[k]))
    table = np.zeros((langs, langmix.BINS))
    for k in range(langs):
        _, bins, n = langmix.features(pa.array([make(k, 20_000)]))
        table[k, bins] = n
    table = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * langmix.BINS))
    texts = []
    for share in np.linspace(0.03, 0.2, 30):
        a, b = r.choice(langs, 2, replace=False)
        texts.append(make(a, int(800 * (1 - share))) + " " + make(b, int(800 * share)))
    shares, _ = langmix.infer(pa.array(texts), table)
    pairs = 0
    for i, t in enumerate(texts):
        _, bins, n = langmix.features(pa.array([t]))
        lp = table[:, bins]
        fine = langmix.PENALTY / 2 * np.log(n.sum() + 1)
        value = lambda w: (n * np.log(w @ np.exp(lp - lp.max(axis=0)))).sum() - (np.count_nonzero(w) - 1) * fine  # noqa: E731, B023
        single = max(value(np.eye(langs)[k]) for k in range(langs))
        best = max(value((1 - x) * np.eye(langs)[k] + x * np.eye(langs)[j]) for k in range(langs) for j in range(langs) if j != k for x in (0.03, 0.06, 0.1, 0.15, 0.2))
        pairs += best > single
        assert value(shares[:, i] / shares[:, i].sum()) >= max(single, best) - 0.1, i
    assert pairs >= 10


def test_contexts_are_sent_in_few_bytes():
    r = random.Random(3)
    texts = [" ".join(f"word{int(r.paretovariate(0.7)) % 5000}" for _ in range(400)) for _ in range(100)]
    t = pa.table({"doc_id": list(range(100)), "text": texts, "held": [False] * 100})
    answers = suffix_tree_lm.answer_words(suffix_tree_lm.ask_words(0, t, 1))
    sent = suffix_tree_lm.ask_paths(0, t, answers, 1)
    k = suffix_tree_lm.Tokens(t)
    p = suffix_tree_lm.Paths(k, *suffix_tree_lm.known(k, answers, 1), suffix_tree_lm.Root(answers))
    size = sum(len(x.as_py()) for c in "abcdef" for x in sent.column(c))
    assert size < 5 * (len(p.edge) + len(p.ctx))  # hashes and a count for each took 75,875 bytes under LZ4, 328,216 without
