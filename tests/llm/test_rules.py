import random
import pyarrow as pa
import collections
import re

from inkloom.llm import html_layout, quality_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts_and_frequent_lines(spark):
    body = lambda i: " ".join(f"word{i}_{j}" for j in range(14))
    rows = [(i, f"{body(i)}\n  Subscribe   NOW to our letter\n{body(i + 500)}", "a") for i in range(30)]
    rows += [(100 + i, f"subscribe now to our letter\n{body(1000 + i)}", "b") for i in range(3)]  # not frequent in its host
    rows += [(200, "subscribe now to our letter\n" * 9 + body(7), "a"), (201, None, "a"), (202, "", None), (203, "é #a\n\n#a é\né #a\n \n" * 9, None), (204, "x y\t" * 4000, "b"), (None, body(5), "a"), (7, body(9), "a"), (7, body(9), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "2 AS line", "3 AS host").repartition(3)
    got = quality_lines.judge(quality_lines.prepare(df)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        if d != 7:
            r = by[d]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(t), (d, t)
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert all(by[i].n_removed_words == 5 and by[i].kept for i in range(30) if i != 7)
    assert all(by[100 + i].n_removed_words == 0 and by[100 + i].kept for i in range(3))
    assert not by[200].kept and not by[201].kept
    new = quality_lines.apply(df)
    assert new.columns == df.columns
    texts = {r.doc_id: r.text for r in new.collect()}
    assert 200 not in texts and texts[3] == f"{body(3)}\n{body(503)}" and texts[101] == rows[31][1]
    assert quality_lines.apply(df.limit(0)).count() == 0


def test_depleted(spark):
    line = "this line stands in every document of its host"
    rows = [(i, f"{line}\n" + " ".join(f"a{i}_{j}" for j in range(20 if i else 8)), "h") for i in range(10)]
    got = {r.doc_id: r.kept for r in quality_lines.judge(quality_lines.prepare(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got == {i: i > 0 for i in range(10)}


def test_joined_like_broadcast(spark, monkeypatch):
    rows = [(i, "\n".join(f"shared line number {j} of a host" for j in range(i % 7)) + "\n" + " ".join(f"c{i}_{j}" for j in range(30)), "ab"[i % 2]) for i in range(60)]
    df = quality_lines.prepare(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    take = lambda: sorted((r.doc_id, r.n_removed_words, sorted(r.gone_lines), r.kept) for r in quality_lines.judge(df).collect())
    want = take()
    monkeypatch.setattr(quality_lines, "BROADCAST_ROWS", 0)
    assert take() == want and max(x[1] for x in want) > 0


def test_layout():
    x = html_layout.extract_text
    assert x("<title>no</title>a<p>one<p>two &amp; <b>b</b>old") == "a\n\none\n\ntwo & bold"
    assert x("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>") == "* x\n* y\n  3. 1\n  4. 2"
    assert x("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>") == "a     bbb\ncccc  d"
    assert x("<table><tr><th colspan=2>head<th>x<tr><td>1<td>2<td>3</table>") == "head  x\n1  2  3"
    assert x("a<div hidden>h</div><p style='display: none'>i</p><script>if(a<b)'</p>'</script><!-- c -->b") == "ab"
    assert x("<pre>  k\n   l</pre>t<br>u") == "k\n   l\n\nt\nu" or x("<pre>  k\n   l</pre>t<br>u") == "  k\n   l\n\nt\nu"
    assert x("<select><option>o1<option selected>o2</select>") == "o2"
    assert x("<dl><dt>T<dd>D</dl>") == "T\n    D"
    assert x(None) == x("") == "" and x("<p") == "<p" and x("a</p>b") == "a\n\nb"
    assert x("<div>" * 50_000 + "z") == "z"


def test_layout_frame(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "x" * 100_000)], "page_id long, html string").selectExpr("*", "1 AS text")
    assert sorted((r.page_id or 0, len(r.text)) for r in html_layout.extract(df).collect()) == [(0, 100_000), (1, 1), (1, 1), (2, 0)]
    assert html_layout.extract(df.limit(0)).count() == 0


def test_lines_are_alike_if_their_words_are():
    r = random.Random(3)
    kinds = ["a", "A", "b", "É", "é", "word", " ", "  ", "\t", "\r", "\n", "\n"]
    texts = ["".join(r.choice(kinds) for _ in range(r.randint(0, 40))) for _ in range(500)] + ["", None, "\n\na\n", "a", "A \n a", "w" * 500 + " x", "\n"]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [(i, k, tuple(w)) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if (w := re.findall("[^\x20\x09-\x0D]+", x.translate(low)))]
    own, number, line, words = (x.tolist() for x in quality_lines.split_lines(pa.array(texts)))
    assert list(zip(own, number, words, strict=True)) == [(i, k, len(w)) for i, k, w in want]
    assert len(set(line)) == len({w for _, _, w in want}) == len(set(zip(line, (w for _, _, w in want), strict=True)))


def test_lines_are_not_split_by_the_jvm(spark):
    df = spark.createDataFrame([(1, "a\nb", "h")], "doc_id long, text string, source string")
    lines, _ = quality_lines.frequent_lines(quality_lines.prepare(df), 5, 0.1)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
