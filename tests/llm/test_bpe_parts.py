import random

import numpy as np
import pyarrow as pa
import tiktoken

from inkloom.llm import bpe_monoid as m

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0    ​    　"


def test_known_parts_need_no_object_for_each(monkeypatch):
    seen, lack = [], m.Memo.lack
    monkeypatch.setattr(m.Memo, "lack", lambda self, keys: seen.extend(keys) or lack(self, keys))
    r = random.Random(1)
    words = ["".join(r.choices("abcdeé1,.", k=r.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(100)]
    codec = m.Codec(*m.vocabulary())
    first = codec.encode(texts)
    seen.clear()
    assert codec.encode(texts) == first and not seen


def test_all_white_space_is_cut_as_by_the_library():
    codec = m.Codec(*m.vocabulary())
    library = tiktoken.Encoding("own", pat_str=m.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(6)
    texts = ["".join(r.choice([r.choice(SPACES), " ", " ", r.choice("aé日1'.̀亀亟"), "'s", "ab"]) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    for part in (texts, [None, "", None], [], ["", " ", None, "a " + "b" * 200, "x"]):
        got = m.encode_texts(pa.array(part, pa.string()), codec).to_pylist()
        assert got == [library.encode_ordinary(t or "") for t in part]
        assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode(part)] == got
