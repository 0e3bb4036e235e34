import random
import time

import numpy as np
from pyspark.sql import functions as F

from inkloom.llm import common
from inkloom.llm import count_rtree as m


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()


def brute(rows, size=4, num=85, den=100):
    sets = []
    for _, t in rows:
        w = lower(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    boss = list(range(len(rows)))

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                boss[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return sorted((d, len(s), min(least[top(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    rows = []
    for base in range(12):
        text = [word() for _ in range(r.choice([8, 30, 120, 300]))]
        for _ in range(8):  # a chain of changes: similar to neighbours, not to all
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[r.randrange(len(text))] = word()
            rows.append(" ".join(text))
    shared = " ".join(word() for _ in range(20))
    rows += [shared + " " + " ".join(word() for _ in range(40)) for _ in range(30)]
    rows += ["A b C", "a B c", "a b", "x", "X", "", None, rows[0].upper(), rows[5] + " tail"]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sig", "2 AS n", "'q' AS block").repartition(3)
    got = m.join(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    kept = m.apply(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_rows_of_one_id_nulls_and_empty_table(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "other text is here now"), (None, "a b c d e"), (None, "q w e r t"), (2, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in m.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None), (2, 0, 2)], key=str)
    assert m.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_null_ids(spark):
    r = random.Random(9)
    text = [f"w{r.randint(0, 9999)}" for _ in range(60)]
    near, far = " ".join(["x", *text[1:]]), " ".join(f"v{i}" for i in range(30))
    rows = [(5, " ".join(text)), (None, near), (None, near), (None, far), (None, "y " + far), (6, far[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'r' AS `__row`", "1 AS key", "2 AS id").repartition(3)
    got = sorted(((x.doc_id, x.component_id) for x in m.join(df).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (None, 5), (None, None), (None, None), (6, 6)], key=str)
    kept = m.apply(df)
    assert kept.columns == df.columns and kept.where("`__row` = 'r'").count() == 3
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 5, 6]


def test_blocks_give_all_connections():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[r.choice(200, 12, replace=False)] = r.integers(0, 1 << 60, 12, dtype=np.uint64)
        sets.append(np.unique(s))
    sets += [np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64)) for n in (3, 40, 200, 200, 900)]
    links = m.link_block(sets, 80, 100)
    label = list(range(len(sets)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        assert m.similar(sets[a], sets[b], 80, 100) and top(a) != top(b)
        label[top(a)] = top(b)
    for a in range(len(sets)):
        for b in range(a):
            assert not m.similar(sets[a], sets[b], 80, 100) or top(a) == top(b)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    boss = {v: v for e in edges for v in e}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        boss[y] = x
    got = {x.id: x.component for x in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for v in boss if top(v) != v}


def test_a_cut_leaves_no_shuffle_files(spark):
    key = common.CLEANUP

    def written():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_")}

    before, had = written(), spark.conf.get(key, None)
    got = common.cut(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while written() - before and time.time() < end:
        time.sleep(0.2)
    assert not written() - before
    assert got.count() == 7 and spark.conf.get(key, None) == had


def test_a_semi_join_and_its_grouping_share_one_exchange_of_the_rows(spark):
    docs = spark.createDataFrame([(0, "a b c d e f"), (None, "a b c d e f"), (None, "u v w x y z"), (0, "k l m n o p"), (0, "k l m n o p")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = m.apply(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = plan[: plan.index("LeftSemi")]
    assert "Exchange" not in top
    assert rows == [(0, "a b c d e f"), (0, "k l m n o p"), (None, "u v w x y z")]
