import hashlib
import random

import numpy as np
import pytest
import tiktoken

from inkloom.llm import bpe_monoid as m


@pytest.fixture(scope="module")
def codec():
    return m.codec(*m.vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=m.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


def ids(codec, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)]


def test_same_as_library(codec, library):
    r = random.Random(3)
    kinds = ["ab", "aaaa ", " \n\t", "thetion", "éèñ日", "0123 ", "’'s  "]
    texts = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randint(0, 90))) for _ in range(4000)]
    texts += [x * 3000 for x in ("a", " ", "é", "=", "\n", "ab", "the", " x ")] + ["", " ", "a ", " a", "a  b", "it's we'll 12"]
    assert ids(codec, texts) == [library.encode_ordinary(t) for t in texts]
    assert all(codec.decode(np.array(i, np.int64)).tobytes().decode() == t for i, t in zip(ids(codec, texts), texts, strict=True))


def test_tree_joins_like_plain_merging(codec):
    r = random.Random(4)
    for leaf in (1, 2, 5):
        tree = m.Monoid(codec.ranks, leaf)
        for _ in range(800):
            s = "".join(r.choice("aabtheion ") for _ in range(r.randint(1, 60))).encode()
            assert tree.encode(s) == ([s] if s in codec.ranks else m._merge(codec.ranks, s))


def test_frame(spark, library):
    rows = [(1, "The of and"), (1, "The of and"), (2, None), (3, ""), (4, "x" * 50_000), (None, "é ñ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, m.digest(df).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i := library.encode_ordinary(t or "")), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in rows]
    assert got == sorted(want, key=str)
    assert m.digest(df.limit(0)).count() == 0
    extra = m.encode(df.selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded"), *m.vocabulary())
    assert extra.columns == ["doc_id", "text", "decoded", "ids"]
