"""Jaccard join of shingle sets with R-trees of count vectors.

Texts with the same set are one class, known by a 64-bit hash of the set; the
join is between classes.

Blocks. A set's shingles have ROUTES least hashes, under as many hash functions;
classes that share one meet in a block. A block's shingles are hashed into
groups, and the counts per group make each set a point of an R-tree, whose
nodes keep the maxima of each coordinate and the least size. The sum of the
coordinate minima of two points bounds the overlap of the sets, and that of a
point and a node bounds it for all points below; what the bound leaves is
verified on the sets. Pairs that are already connected aren't compared, and a
block gives only links of a spanning forest.

The rest. Similar sets (J >= t) lack a common least hash of the first ROUTES
functions with probability (1 - t) ** ROUTES. MORE further functions give
blocks in which only points are sent, and only of classes that aren't connected
yet; pairs that their bounds leave are verified on the sets. What then remains
unseen is a pair without a common least hash of all ROUTES + MORE functions: at
most (1 - t) ** 10, 6e-9 at the threshold of 0.85 and less above it.

Links are between classes, by the hash of the set, and are joined to components
by rounds of large and small stars; a component's id is the least doc_id of its
classes.

Defined results: null texts and texts without words have no set and link with
nothing; a text of fewer than `size` words is one shingle; repeated rows are in
one class; a null doc_id takes part, but is never a component's id unless all
of a class are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

SIZE, NUM, DEN = 4, 85, 100
ROUTES, MORE, GROUPS = 3, 7, 128
LEAF = 16
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(1, ROUTES + MORE + 2)]


def shingles(raw: np.ndarray, off: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingle hashes of each text, ascending; those of text i are first[i] to first[i + 1]."""
    starts, ends, first = vec.words(raw, off)
    h = vec.span_hashes(vec.lower(raw) if lower else raw, starts, ends)
    own = vec.owner(first)
    g = vec.grams(h, size)
    at = np.flatnonzero(vec.whole(own, size))
    value, who = g[at], own[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = []
        for i in short.tolist():
            x = np.zeros(1, np.uint64)
            for w in h[first[i] : first[i + 1]]:
                x = vec.mix(x * np.uint64(31) + w)
            extra.append(x[0])
        value, who = np.concatenate([value, np.array(extra, np.uint64)]), np.concatenate([who, short])
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    value, who = value[new], who[new]
    return value, np.searchsorted(who, np.arange(len(off)))


def describe(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, hash of the set, least hashes) of each set."""
    n = np.diff(first)
    sig = np.zeros(len(n), np.uint64)
    low = np.zeros((len(n), ROUTES + MORE), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = first[:-1][some]
        sig[some] = vec.mix(np.add.reduceat(vec.mix(value ^ _SALT[-1]), at) + n[some].astype(np.uint64))
        for r in range(ROUTES + MORE):
            low[some, r] = np.minimum.reduceat(vec.mix(value ^ _SALT[r]), at)
    return n, sig.view(np.int64), low.view(np.int64)


def need(n, m, num: int, den: int):
    """The least overlap of similar sets of sizes n and m: ceil(t / (1 + t) * (n + m))."""
    return -(-(num * (n + m)) // (num + den))


class RTree:
    """Points packed by size into leaves of LEAF; inner nodes keep the maxima of their points and the least size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.v, self.n = vectors, sizes
        self.levels = []
        v, n = vectors, sizes
        while len(v) > LEAF:
            cut = np.arange(0, len(v), LEAF)
            v, n = np.maximum.reduceat(v, cut, axis=0), np.minimum.reduceat(n, cut)
            self.levels.append((v, n))

    def search(self, q: int, live: np.ndarray, num: int, den: int) -> np.ndarray:
        """Live points whose bound allows them to be similar to point q."""
        vec_q, n_q = self.v[q], self.n[q]
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.v))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, n = self.levels[depth]
            at = at[np.minimum(v[at], vec_q).sum(axis=1) >= need(n_q, n[at], num, den)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.v)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        at = at[live[at]]
        return at[np.minimum(self.v[at], vec_q).sum(axis=1) >= need(n_q, self.n[at], num, den)]


def vectors(sets: list[np.ndarray]) -> np.ndarray:
    """Counts per group; so many groups that a typical set has about two shingles in each."""
    typical = float(np.median([len(s) for s in sets]))
    groups = 1 << int(np.clip(np.ceil(np.log2(max(typical, 1) / 2)), 4, 10))
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    return np.bincount(own * groups + (flat & np.uint64(groups - 1)).astype(np.int64), minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def link_block(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of a block that connect all that are connected."""
    if len(sets) < 2:
        return []
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = RTree(vectors(sets), sizes)
    label = np.arange(len(sets))
    out = []
    for q in range(len(sets) - 1):
        live = label != label[q]
        live[: q + 1] = False
        if not live.any():
            continue
        for x in tree.search(q, live, num, den).tolist():
            if label[x] != label[q] and similar(sets[q], sets[x], num, den):
                label[label == label[x]] = label[q]
                out.append((int(order[q]), int(order[x])))
    return out


def _sets(df: DataFrame, size: int, columns: list[str], out: str, f) -> DataFrame:
    """f(record batch of columns + text, hashes, first) by slices."""
    common.batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in vec.slices(batch):
                yield f(part, *shingles(*vec.buffers(part.column(len(columns))), size))

    return df.select(*columns, "text").mapInArrow(run, out)


def describe_docs(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, a hash of its text, size and hash of its set, its least hashes, and its point: 32-bit counts of GROUPS groups."""

    def f(part, value, first):
        n, sig, low = describe(value, first)
        own = np.repeat(np.arange(part.num_rows), n)
        point = np.bincount(own * GROUPS + (value & np.uint64(GROUPS - 1)).astype(np.int64), minlength=part.num_rows * GROUPS)
        wide = point.astype("<u4").reshape(part.num_rows, GROUPS)
        lows = pa.FixedSizeListArray.from_arrays(pa.array(low.ravel()), ROUTES + MORE).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(sig), lows, pa.array([x.tobytes() for x in wide], pa.binary())], names=["doc_id", "key", "n", "sig", "lows", "point"])

    return _sets(docs, size, ["doc_id", "key"], "doc_id long, key long, n long, sig long, lows array<long>, point binary", f)


def _ident(doc_id: str) -> tuple:
    """A doc_id that may be null as two columns that join by plain equality, so that a join and a grouping by them share one exchange."""
    return F.coalesce(doc_id, F.lit(0)).alias("id"), F.isnull(doc_id).alias("no_id")


def _spread(docs: DataFrame, wanted: DataFrame, size: int, by: str) -> DataFrame:
    """Sets of the wanted classes: rows (block, sig, set) for each element of the array column `by`. Of the rows with a class's doc_id and text one is taken, whether the doc_id is null or not."""

    def f(part, value, first):
        n = np.diff(np.asarray(part.column(1).offsets))
        sets = [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        who = np.repeat(np.arange(part.num_rows), n)
        return pa.RecordBatch.from_arrays([part.column(1).flatten(), part.column(0).take(pa.array(who)), pa.array([sets[i] for i in who], pa.binary())], names=["block", "sig", "shingles"])

    rows = docs.select(*_ident("doc_id"), "key", "text")
    both = rows.join(wanted.select(*_ident("rep"), "key", "sig", by), ["id", "no_id", "key"])
    one = both.groupBy("id", "no_id", "key", "sig").agg(F.first(by).alias(by), F.first("text").alias("text"))
    return _sets(one, size, ["sig", by], "block long, sig long, shingles binary", f)


def block_links(docs: DataFrame, members: DataFrame, size: int, num: int, den: int, buckets: int) -> DataFrame:
    """(a, b): the links between the classes of each block. members: sig, rep, key, block."""
    wanted = members.groupBy("rep", "key", "sig").agg(F.collect_set("block").alias("blocks"))

    def join(t: pa.Table) -> pa.Table:
        block, sig = t.column("block").to_numpy(), t.column("sig").to_numpy()
        order = np.lexsort((sig, block))
        same = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1], [True])))
        raw = t.column("shingles").combine_chunks()
        out = []
        for lo, hi in zip(same[:-1], same[1:], strict=True):
            i = order[lo:hi]
            i = i[np.unique(sig[i], return_index=True)[1]]
            got = link_block([np.frombuffer(raw[int(x)].as_buffer(), np.uint64) for x in i], num, den)
            out += [(sig[i[a]], sig[i[b]]) for a, b in got]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    spread = _spread(docs, wanted, size, "blocks").withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)))
    return spread.groupBy("bucket").applyInArrow(join, "a long, b long")


def near_points(rows: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """(a, b): pairs of unconnected classes of a block whose points allow them to be similar. rows: block, sig, label, n, point."""

    def meet(t: pa.Table) -> pa.Table:
        block, sig, label, n = (t.column(c).to_numpy() for c in ("block", "sig", "label", "n"))
        order = np.lexsort((n, block))
        cut_at = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1], [True])))
        raw = t.column("point").combine_chunks()
        out = np.zeros((0, 2), np.int64)
        for lo, hi in zip(cut_at[:-1], cut_at[1:], strict=True):
            i = order[lo:hi]
            tree = RTree(np.stack([np.frombuffer(raw[int(x)].as_buffer(), "<u4") for x in i]).astype(np.int32), n[i])
            found = []
            for q in range(len(i) - 1):
                live = label[i] != label[i[q]]
                live[: q + 1] = False
                if live.any():
                    x = tree.search(q, live, num, den)
                    found.append(np.stack([np.minimum(sig[i[x]], sig[i[q]]), np.maximum(sig[i[x]], sig[i[q]])], axis=1))
            out = np.unique(np.concatenate([out, *found]), axis=0)
        return pa.table({"a": out[:, 0].copy(), "b": out[:, 1].copy()})

    return rows.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets))).groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches, by rounds of large and small stars over links (a, b) of integers."""
    spark = links.sparkSession
    edges = common.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("lo").alias("b")), F.struct(F.col("b").alias("a"), F.col("lo").alias("b")))).alias("e"))
        new = common.cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = tuple(new.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        common.remove(spark, edges)
        edges = new
        if now == state:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        state = now


def join(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, sig (its class), component_id, key (a hash of its text), and whether it is its component's first document, of which there may be repeated rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    buckets = max(4, common.chunk_count(docs) // 2)
    told = common.cut(describe_docs(docs, size))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = common.cut(told.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min_by("key", F.struct(last, "key")).alias("key"), F.first(F.struct("n", "lows", "point")).alias("x")).select("sig", "rep", "key", "x.*"))
    routes = classes.select("sig", "rep", "key", F.posexplode("lows").alias("r", "low")).select("sig", "rep", "key", "r", F.xxhash64("r", "low").alias("block"))

    def linked(members: DataFrame) -> DataFrame:
        return block_links(docs, members, size, num, den, buckets)

    mine = routes.where(F.col("r") < ROUTES)
    busy = mine.groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block")
    stars = common.cut(components(linked(mine.join(busy, "block"))))
    label = routes.where(F.col("r") >= ROUTES).join(stars.withColumnRenamed("id", "sig"), "sig", "left").select("sig", "block", F.coalesce("component", "sig").alias("label"))
    mixed = label.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("block")
    rows = label.join(mixed, "block").join(classes.select("sig", "n", "point"), "sig")
    pairs = common.cut(near_points(rows, num, den, buckets))
    if not pairs.isEmpty():
        ends = pairs.select(F.xxhash64(F.lit("pair"), "a", "b").alias("block"), F.explode(F.array("a", "b")).alias("sig"))
        more = linked(ends.join(classes.select("sig", "rep", "key"), "sig"))
        stars = components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    # only classes with links meet by component; all others are their own
    members = stars.union(stars.select("component", "component").distinct()).toDF("sig", "component")
    tied = common.cut(classes.select("sig", "rep", "key").join(members, "sig"))
    least = tied.groupBy("component").agg(F.min("rep").alias("least"), F.min_by("key", F.struct(F.coalesce("rep", F.lit((1 << 63) - 1)), "key")).alias("least_key"))
    found = tied.join(least, "component").select("sig", "least", "least_key")
    home = classes.select("sig", "rep", "key").join(found, "sig", "left").select("sig", F.when(F.col("least_key").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component"), F.coalesce("least_key", "key").alias("least_key"))
    own = F.col("n") == 0
    first = own | F.expr("doc_id <=> component AND key = least_key")
    return told.join(home, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), "sig", F.when(own, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "key", first.alias("first"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id (of the least hash of the text where all are null or several have it); documents without words stay; of equal rows one stays."""
    keep = join(docs, **options).where("first").select(*_ident("doc_id"), "key").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(*_ident("doc"), "key", "row")
    by = ["id", "no_id", "key"]
    return rows.join(keep, by, "left_semi").groupBy(*by).agg(F.first("row").alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_SET = "list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(1, len(w) - 3) + 1)])"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest({_SET}) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM r GROUP BY a) ON a = d.doc_id
"""
