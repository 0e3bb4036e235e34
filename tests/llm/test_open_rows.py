import random

import numpy as np
import pyarrow as pa

from inkloom.llm import suffix_tree_lm as m


def test_open_tokens_are_kept_in_few_bytes():
    r = random.Random(5)
    texts = []
    for _ in range(150):  # passages that repeat, in changing order
        parts = [" ".join(f"v{(k * k * 7 + j * j * 3 + j * k) % 97}" for j in range(25)) for k in range(12)]
        texts.append(" ".join(r.choices(parts, k=12)))
    t = pa.table({"doc_id": list(range(150)), "text": texts, "held": [i % 7 == 2 for i in range(150)]})
    words = m.answer_words(m.ask_words(0, t, 1))
    one = m.begin(0, t, pa.concat_tables([words, m.answer_paths(m.ask_paths(0, t, words, 1))]), 1).to_pylist()[0]
    total = one["train_tokens"][0]
    row = m.start(one, m.answer_paths(m.ask_pairs(one, total, 1)), total, 1).to_pylist()[0]
    assert row["open"] > 1000
    size = sum(len(x) for c, x in row.items() if isinstance(x, bytes) and c != "tok")
    assert size < 8 * row["open"]  # with a key, a name and two floats for each, 19 bytes


def test_distinct_numbers_like_numpy():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.zeros(5, np.int64), r.integers(0, 50, 999), r.integers(0, 1 << 62, 300).repeat(3)):
        _, first, row = np.unique(x, return_index=True, return_inverse=True)
        got = m._distinct(x)
        assert got[0].tolist() == first.tolist() and got[1].tolist() == row.tolist()
        for y in (x, x << 1, -x):
            assert m._unpack(pa.table({"x": [m._pack(y)]}), "x")[0][0].tolist() == y.tolist()


def test_passages_that_do_not_part_are_judged_once(monkeypatch):
    shared, judged = " ".join(f"v{(k * k + 3 * k) % 41}" for k in range(300)), []
    texts = [f"{'a b'[i % 3 :: 2]} {shared} {'x y'[i % 2 :: 2]}" for i in range(60)]
    t = pa.table({"doc_id": list(range(60)), "text": texts, "held": [i % 7 == 2 for i in range(60)]})
    words = m.answer_words(m.ask_words(0, t, 1))
    kept = m.Tokens(t).row(0)  # from here on without texts
    one = m.begin(0, kept, pa.concat_tables([words, m.answer_paths(m.ask_paths(0, kept, words, 1))]), 1).to_pylist()[0]
    assert one == m.begin(0, t, pa.concat_tables([words, m.answer_paths(m.ask_paths(0, t, words, 1))]), 1).to_pylist()[0]
    total = one["train_tokens"][0]
    row = m.start(one, m.answer_paths(m.ask_pairs(one, total, 1)), total, 1).to_pylist()[0]
    assert row["open"] > 50
    judge = m.judge
    monkeypatch.setattr(m, "judge", lambda *a: (judged.append(1), judge(*a))[1])
    m.answer_open(m.ask_open(row, 2, 256, 1), 2, 256)
    assert 1 <= len(judged) < 20  # one for each of 256 words before
