import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from inkloom.llm import arrow_tokens as m
from inkloom.llm import common

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_give_the_librarys_ids():
    r = random.Random(5)
    kinds = ["Abc", " ", "\n", "éÉéΣσ日", "12'sS", "  \t\r\x1c", ".,<|>", "́"]
    texts = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    letters = [chr(c) for c in range(0x41, 0x2FF) if chr(c).isalpha()] + list("\u0130\u212aſßΣςﬁǅ한글각ㅏहिन्दी")
    texts += [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(40)) for _ in range(300)]
    texts += ["a<|endoftext|> b <|startoftext|>", "x" * 5000, "a  b", " ́a", "", None]
    enc = m.WordEncoder(PATH)
    for part in (texts[:10], texts, texts[::-1]):
        ids, off = enc.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == library(part)


def test_files(spark, tmp_path):
    rows = [(i * 7 % 50, f"the cat {i} " * (i % 5)) for i in range(50)] + [(51, None), (52, ""), (7, "twice"), (7, "twice"), (None, "first"), (99, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS start").repartition(3)
    files = m.write(df, PATH, 1, f"file://{tmp_path}/a", length=16, batch=4)
    got = m.read(spark, files).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ids = [x + [1] for x in library([t for _, t in order])]
    assert sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(
        (sum(map(len, ids[:i])), order[i][0], x) for i, x in enumerate(ids)
    )
    flat = [x for f in files for x in flatten(m.TokenFile(f[1] + ".arrow"))]
    assert flat == [x for i in ids for x in i]


def test_query_against_the_library(spark, tmp_path):
    rows = [(i * 7 % 50, f"The cat {i}, of " * (i % 5)) for i in range(50)] + [(51, None), (52, ""), (99, "long " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for doc, ids in zip(sorted(d for d, _ in rows), library([t for _, t in sorted(rows)]), strict=True):
        want.append((doc, start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, m.query(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def flatten(f):
    for k in range(len(f)):
        assert len(f.sequence(k)) == len(f.mask(k)) == f.length
        assert f.mask(k).null_count == 0
        yield from f.sequence(k)[np.array(f.mask(k))].tolist()


def test_views_share_memory(tmp_path):
    w = m.Writer(pa.OSFile(str(tmp_path / "x"), "wb"), np.dtype("<u2"), 8, 2)
    w.add(np.arange(50, dtype="<u2"))
    w.close()
    f = m.TokenFile(f"file://{tmp_path}/x")
    assert len(f) == 7 and f.tokens(5, 40).tolist() == list(range(5, 45))
    a, b = f.sequence(1), f.tokens(8, 8)
    assert a.tolist() == list(range(8, 16)) and np.shares_memory(a, b) and not a.flags.owndata


def test_empty(spark, tmp_path):
    assert m.write(spark.createDataFrame([], "doc_id long, text string"), PATH, 1, f"file://{tmp_path}/e") == []
    assert m.read(spark, []).count() == 0


def test_kept_values_come_in_the_order_of_the_keys_and_are_made_once():
    made = []
    memo = common.Memo(4)
    make = lambda keys: made.extend(keys) or [k.encode() for k in keys]
    for keys in (["b", "a"], ["a", "c", "longer", "b"], ["longer", "d", "c"], ["e", "a", ""], ["", "b", "d"]):
        assert memo.values(keys, make, 3) == [k.encode() for k in keys]
    assert made == ["b", "a", "c", "longer", "longer", "d", "e", ""]
