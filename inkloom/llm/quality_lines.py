"""Quality rules: counts of each document, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed, in
Arrow functions by slices; for each host and hash the distinct documents are counted, and lines in more than
max(min_docs, share * documents of the host) of them are removed. A document
is rejected when its counts fail, or when it is depleted: fewer than min_words
words, or less than half of them, are left.

Lines are counted in two steps, by document first, so a line that a third of
all rows share doesn't meet in one task. The table of frequent lines is sent to
the tasks only if it has at most BROADCAST_ROWS rows; else it is joined, each
of its rows SALTS times, so that a line of many documents meets in many tasks.
Defined results: null and empty texts have no words and fail; a null host is a
host of its own; a null doc_id is a document of its own; repeated rows count
as one document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

#: A line is frequent in more documents of its host than both of these say.
MIN_DOCS, SHARE = 5, 0.1
MIN_WORDS, MIN_LEFT = 10, 0.5
#: Rows of 8 to about 50 bytes: a few MB.
BROADCAST_ROWS = 100_000
SALTS = 32
#: Text that is measured at once, besides a longer one.
SLICE_BYTES = 1 << 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = vec.table(b"#*$%&|<>")


def measure(col: pa.Array) -> list[np.ndarray]:
    """STATS of each text."""
    raw, off = vec.buffers(col)
    starts, ends, first = vec.words(raw, off)
    own, docs = vec.owner(first), len(off) - 1
    per = lambda flags, at: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate(([0], np.cumsum(flags))))
    chars = vec.NON_SPACE[raw] & ((raw & 0xC0) != 0x80)
    # lines with a word: from each text's start or line end to the next
    breaks = np.unique(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1]))
    breaks = breaks[breaks < len(raw)]
    stop = np.append(breaks[1:], len(raw))
    stop = stop - ((stop > breaks) & (raw[stop - 1] == 10))
    inside = np.searchsorted(starts, stop) - np.searchsorted(starts, breaks) > 0
    breaks, stop = breaks[inside], stop[inside]
    line_doc = np.searchsorted(off, breaks, side="right") - 1
    key = vec.mix(vec.span_hashes(raw, breaks, stop) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    firsts = np.zeros(len(key), bool)
    firsts[np.unique(key, return_index=True)[1]] = True
    dup = np.bincount(line_doc[~firsts], minlength=docs)
    whole = vec.whole(own, 5)
    g = vec.grams(vec.span_hashes(raw, starts, ends), 5)
    g = vec.mix(g ^ (own[: len(g)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = np.flatnonzero(whole)
    _, inv, n = np.unique(g[at], return_inverse=True, return_counts=True)
    hit = np.zeros(len(g), bool)
    hit[at[n[inv] > 1]] = True
    return [np.diff(first), per(chars, off), per(SYMBOLS[raw], off), dup, per(vec.cover(hit, 5, len(starts)), first)]


def counts(docs: DataFrame) -> DataFrame:
    """STATS per row, besides doc_id and key."""
    common.batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in vec.slices(batch, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x.astype(np.int64)) for x in measure(part.column(2)))], names=["doc_id", "key", *STATS])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{x} long" for x in STATS))


def split_lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in it, hash, words) of each line with a word: alike if words are, A-Z as a-z, whatever white space parts them."""
    raw, off = vec.buffers(col)
    starts, ends, first = vec.words(raw, off)
    own = vec.owner(first)
    breaks = np.flatnonzero(raw == 10)
    before = np.searchsorted(breaks, off[:-1])
    number = np.searchsorted(breaks, starts) - before[own]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(starts)))
    if not len(at):
        return own, number, np.zeros(0, np.int64), size
    place = (np.arange(len(starts)) - np.repeat(at, size) + 1).astype(np.uint64)
    parts = vec.mix(vec.span_hashes(vec.lower(raw), starts, ends) ^ vec.mix(place * np.uint64(0x9E3779B97F4A7C15)))
    line = vec.mix(np.add.reduceat(parts, at) + size.astype(np.uint64))
    return own[at], number[at], line.view(np.int64), size


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, host, line, words, number of each line with a word."""
    common.batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in vec.slices(batch, SLICE_BYTES):
                own, number, line, size = split_lines(part.column(3))
                who = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(who) for i in range(3)), pa.array(line), pa.array(size.astype(np.int32)), pa.array(number.astype(np.int32))], names=["doc_id", "key", "host", "line", "words", "number"])

    return docs.select("doc_id", "key", "host", "text").mapInArrow(run, f"doc_id long, key long, host {docs.schema['host'].dataType.simpleString()}, line long, words int, number int")


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id, host, text, and key: a hash of the text, which tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.xxhash64("text").alias("key"), "text")


def frequent_lines(docs: DataFrame, min_docs: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(lines of each document, as lines_of() has them; the frequent ones: host, line)."""
    lines = lines_of(docs)
    ident = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("key")))
    hosts = docs.groupBy("host").agg(F.countDistinct(ident).alias("docs"))
    seen = lines.groupBy("host", "line").agg(F.countDistinct(ident).alias("n")).where(F.col("n") > min_docs).alias("s")
    often = seen.join(hosts.alias("h"), F.expr("s.host <=> h.host")).where(F.expr(f"n > floor({share}D * docs)"))
    return lines, often.select("s.host", "s.line")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row of prepare(): its counts, base_failed, the words and lines that are removed, and kept."""
    lines, often = frequent_lines(docs, min_docs, share)
    often = common.cut(often)
    same = "l.line = f.line AND l.host <=> f.host"
    if often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = lines.alias("l").join(F.broadcast(often).alias("f"), F.expr(same), "left_semi")
    else:
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")).alias("l").join(salted.alias("f"), F.expr(f"{same} AND l.salt = f.salt"), "left_semi")
    gone = hit.groupBy("doc_id", "key").agg(F.sum("words").alias("gone_words"), F.collect_set("number").alias("gone_lines")).alias("g")
    out = counts(docs).alias("c").join(gone, F.expr("c.doc_id <=> g.doc_id AND c.key = g.key"), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    removed = F.coalesce("gone_words", F.lit(0)).cast("long")
    left = F.col("n_words") - removed
    enough = (left >= min_words) & (left >= min_left * F.col("n_words"))
    return out.select("c.doc_id", "c.key", *STATS, failed.alias("base_failed"), removed.alias("n_removed_words"), F.coalesce("gone_lines", F.array().cast("array<int>")).alias("gone_lines"), (~failed & enough).alias("kept"))


def apply(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their frequent lines; all columns stay."""
    rows = prepare(docs)
    verdict = judge(rows, **limits).where("kept").groupBy("doc_id", "key").agg(F.first("gone_lines").alias("gone_lines")).alias("v")
    left = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("v.gone_lines", i))
    text = F.when(F.size("v.gone_lines") > 0, F.array_join(left, "\n")).otherwise(F.col("d.text"))
    both = docs.alias("d").join(verdict, F.expr("d.doc_id <=> v.doc_id AND xxhash64(d.text) = v.key"))
    return both.select(*(text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    got = judge(prepare(common.table(spark, sf_dir, "documents")))
    return got.select("doc_id", *STATS, "base_failed", "kept", "n_removed_words")


_W = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce({_W.format("text")}, []) AS w FROM documents),
l AS (SELECT doc_id, source, line, {_W.format("line")} AS lw FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT doc_id, source, line, {_LOW.format("array_to_string(lw, ' ')")} AS norm, len(lw) AS nw FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
often AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines GROUP BY source, norm) JOIN hosts USING (source)
          WHERE n > {MIN_DOCS} AND n > floor({SHARE}::DOUBLE * docs)),
gone AS (SELECT doc_id, sum(nw) AS n FROM lines JOIN often USING (source, norm) GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {MIN_WORDS} AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept FROM f
"""
