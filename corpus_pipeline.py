"""A corpus pipeline: quality rules, near duplicates, repeated passages, test-set leaks, token ids.

Each stage takes what the one before kept, written as Parquet and read again; run() deletes each of its tables but the
last as soon as the next is written.

Defined results: null and empty texts, and those of fewer than ten words, are rejected by the quality rules; so are
depleted documents. Repeated rows are one class of near duplicates, of which one row stays; a null doc_id counts as
larger than all others. Columns besides doc_id and text go through all stages but the last unchanged, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkloom.llm import bpe_monoid, common, count_rtree, phrase_index, quality_lines, rlz_dedup  # noqa: E402
from inkloom.session import shipped  # noqa: E402

#: Near duplicates: five-word shingles, similarity of 80 in 100.
NEAR = {"size": 5, "num": 80, "den": 100}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; frequent lines leave the others."""
    return quality_lines.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays."""
    return count_rtree.apply(docs, **NEAR)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; the first copy stays."""
    return rlz_dedup.apply(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of the benchmark go."""
    return phrase_index.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether they decode to the text."""
    path, pattern = bpe_monoid.vocabulary()
    both = bpe_monoid.decode(bpe_monoid.encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [(f.__name__, shipped(f)) for f in (quality, near_duplicates, passages, leaks, tokens)]
#: Encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), spark)
        if i:
            common.remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
