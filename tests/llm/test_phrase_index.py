import random
import re

from inkloom.llm import phrase_index as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, width):
    windows = {}
    for item, t in bench:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, items = WORD.findall(lower(t)), set(), set()
        for g, its in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items |= its - {None}
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def frames(spark, docs, bench):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS n_hit"), spark.createDataFrame(bench, "item_id long, text string")


def test_brute_force_one_block_and_many(spark):
    r = random.Random(1)
    make = lambda n: "".join(r.choice("abC") + r.choice([" ", " ", "-", ". ", "\n"]) for _ in range(n))
    docs = [(i, make(r.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, "a " * 500), (83, "É a b")]
    bench = [(i, make(r.randint(0, 9))) for i in range(12)] + [(3, "a b c a"), (None, "b b b b"), (99, None), (98, "é A")]
    d, b = frames(spark, docs, bench)
    want = brute(docs, bench, 5)
    for block in (1 << 20, 20):
        got = m.find(d, b, width=5, block_bytes=block).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, sorted(x["items"])) for x in got), key=str) == want
        assert all(sum(x.hit_ends) - sum(x.hit_starts) == x.n_hit for x in got)


def test_proximity(spark):
    d, b = frames(spark, [(1, "q a b c d e f g x"), (2, "a b zz c d e f g"), (3, "a b c d e f z"), (4, "a b c")], [(7, "a b c d e f g")])
    got = {x.doc_id: (x["items"], x.near_items) for x in m.find(d, b, width=7).collect()}
    assert got == {1: ([7], [7]), 2: ([], [7]), 3: ([], [7]), 4: ([], [])}
    assert not any(x.near_items for x in m.find(d.where("doc_id > 1"), b, width=7, slop=0, misses=0).collect())


def near(docs, bench, width, slop, misses):
    out = []
    for d, t in docs:
        w, items = WORD.findall(lower(t)), set()
        for item, b in bench:
            p = WORD.findall(lower(b))
            for g in (p[k : k + width] for k in range(max(1, len(p) - width + 1) if p else 0)):
                for i in range(len(w) - len(g) + 1):
                    bad = sum(x not in w[max(0, i + j - slop) : i + j + slop + 1] for j, x in enumerate(g))
                    if bad <= misses and bad < len(g):
                        items.add(item)
        out.append((d, sorted(items)))
    return sorted(out)


def test_proximity_where_the_replaced_word_occurs_elsewhere(spark):
    d, b = frames(spark, [(1, "a b c zz e f g"), (2, "x d x"), (3, "a a a b b b c c e e f f g g x x")], [(7, "a b c d e f g")])
    got = {x.doc_id: x.near_items for x in m.find(d.coalesce(1), b, width=7).collect()}
    assert got == {1: [7], 2: [], 3: []}


def test_proximity_brute_force(spark):
    r = random.Random(4)
    make = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs, bench = [(i, make(r.randint(0, 30))) for i in range(60)], [(i, make(r.randint(1, 7))) for i in range(12)]
    d, b = frames(spark, docs, bench)
    for slop, misses in ((0, 1), (1, 0), (1, 1), (2, 2)):
        got = sorted((x.doc_id, sorted(x.near_items)) for x in m.find(d.coalesce(2), b, width=5, slop=slop, misses=misses).collect())
        assert got == near(docs, bench, 5, slop, misses), (slop, misses)


def test_rows_partitions_and_blocks_do_not_show(spark):
    r = random.Random(6)
    make = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    docs = [(r.choice([1, 2, None, 3]), make(r.randint(0, 25))) for _ in range(40)] + [(1, "a b c d e f"), (1, "a b c d e f"), (1, None)]
    bench = [(i, make(r.randint(3, 8))) for i in range(15)]
    d, b = frames(spark, docs, bench)
    row = lambda x: str((x.doc_id, x.n_words, x.n_hit, x.hit_starts, x.hit_ends, x["items"], x.near_items))
    got = [sorted(map(row, m.find(d.repartition(n), b, width=5, block_bytes=block).collect())) for n in (1, 7) for block in (1 << 20, 30)]
    assert len(got[0]) == len(docs) and all(x == got[0] for x in got)
    assert [x[:3] for x in sorted(map(tuple, m.clean(d, b, width=5, block_bytes=30).collect()), key=str)] == [x[:3] for x in sorted(map(tuple, m.clean(d, b, width=5).collect()), key=str)]


def test_the_index_has_all_postings(spark):
    docs = [(i, f"A b-{i} b\nÉ") for i in range(9)] + [(9, None)]
    rows = m.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    words = sum(len(WORD.findall(lower(t))) for _, t in docs)
    segs = [m.Segment.read(x.asDict()) for x in rows]
    assert sum(len(x.positions) for x in segs) == words and sorted(d for x in rows for d in x.doc_ids) == list(range(10))
    assert all(sorted(x.positions.tolist()) == list(range(len(x.positions))) for x in segs)


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b")], [(7, "a b")])
    assert [tuple(x)[1:3] for x in m.find(d, b.limit(0)).collect()] == [(2, 0)]
    assert m.find(d.limit(0), b).count() == 0
