import random

import corpus_pipeline as c


def test_stages(spark, tmp_path):
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    passage, leak = text(60), text(15)
    rows = [(i, text(150), "en", f"s{i % 3}", 0) for i in range(20)]
    rows += [(20, rows[0][1], "en", "s0", 0), (21, rows[1][1] + " x", "en", "s1", 0), (22, "too short", "en", "s1", 0), (23, None, None, None, None)]
    rows += [(30 + i, text(90) + " " + passage, "fr", "s2", 0) for i in range(3)] + [(40, text(80) + " " + leak, "fr", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, f) in enumerate(c.STAGES):
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {x.doc_id: x for x in docs.collect()}
        assert name == "tokens" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = set(range(22)) | {30, 31, 32, 40}
    assert set(seen["quality"]) == first
    assert set(seen["near_duplicates"]) == set(seen["passages"]) == first - {20, 21}
    assert passage in seen["passages"][30].text and passage not in seen["passages"][31].text
    assert set(seen["leaks"]) == set(seen["tokens"]) == first - {20, 21, 40}
    assert all(x.round_trip and x.n_tokens == len(x.ids) for x in seen["tokens"].values())
    assert {x.doc_id: x.ids for x in c.run(spark, str(tmp_path)).collect()} == {k: v.ids for k, v in seen["tokens"].items()}


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, very long and empty texts, rows of one id, and columns with the names that operators use."""
    r = random.Random(5)
    text = lambda n: " ".join(f"v{r.randint(0, 9000)}" for _ in range(n))
    long, a, b = text(60_000), text(120), text(130)
    names = ["key", "row", "chunk", "bucket", "sig", "rest", "kept", "first", "ids", "block", "host", "d", "line"]
    rows = [(1, a, "s"), (1, a, "s"), (1, b, None), (None, text(100), "s"), (None, None, None), (5, long, "s"), (6, long + " end", "s"), (7, "", "s"), (8, " \n\t ", "s"), (9, "x" * 100_000, "s"), (10, text(40) + "\n\n" + text(40), "s")]
    df = spark.createDataFrame([(*x, *range(len(names))) for x in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(20)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, f) in enumerate(c.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/o{k}")
        docs = spark.read.parquet(f"{tmp_path}/o{k}")
        assert name == "tokens" or docs.columns == df.columns and docs.where("d = 11 AND `line` = 12 AND key = 0").count() == docs.count()
        seen.append(sorted(((x.doc_id or 0, len(x.text.split())) for x in docs.collect()), key=str) if name != "tokens" else None)
    assert seen[0] == sorted([(1, 120), (1, 120), (1, 130), (0, 100), (5, 60_000), (6, 60_001), (10, 80)], key=str)
    assert seen[1] == seen[2] == seen[3] == sorted([(1, 120), (1, 130), (0, 100), (5, 60_000), (10, 80)], key=str)
    assert docs.count() == 5 and docs.where("NOT round_trip").count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
