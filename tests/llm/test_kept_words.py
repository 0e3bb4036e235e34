import random

import numpy as np
import pyarrow as pa

from inkloom.llm import arrow_tokens as m
from inkloom.llm import common
from tests.llm.test_arrow_tokens import PATH, library


def test_plain_words_are_looked_up_without_an_object_for_each(monkeypatch):
    r = random.Random(2)
    seen, values = [], common.Memo.values
    monkeypatch.setattr(common.Memo, "values", lambda self, keys, *x: seen.extend(keys) or values(self, keys, *x))
    words = ["".join(r.choices("abcdefstCDE", k=r.randint(1, 70))) + r.choice(["", ",", "..", "?!"]) for _ in range(5000)] + ["it's", "é,", "a,b", "12.", "..."]
    texts = [" ".join(r.choices(words, k=50)) for _ in range(400)]
    enc = m.WordEncoder(PATH)
    for part in (texts, texts[:200], [t.upper() for t in texts]):
        ids, off = enc.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == library(part)
    assert len(seen) < 100


def test_kept_arrays_are_bounded_and_right_whatever_leaves_them():
    made = []

    def make(keys):
        made.extend(keys.to_pylist())
        return np.frombuffer("".join(keys.to_pylist()).encode(), np.uint8).astype("<u2"), np.array([len(k) for k in keys.to_pylist()], np.int64)

    kept = m.Kept(4, np.dtype("<u2"))
    long = "x" * (m.LONG + 1)
    for keys in (["b", "aa"], ["aa", "c", long, "b"], [long, "d", "c"], ["e", "aa", ""], [], ["", "b", "d"], list("fghijk"), ["f"]):
        flat, begin, size = kept.get(pa.array(keys, pa.large_string()), make)
        assert [bytes(flat[b : b + n].astype(np.uint8)).decode() for b, n in zip(begin, size, strict=True)] == keys
        assert len(kept.values) <= 4
    assert made[:5] == ["b", "aa", "c", long, long]
