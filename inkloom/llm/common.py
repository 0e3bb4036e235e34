"""Tables, sizes and shared folders for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text that one Python group or slice holds; bounds a worker's memory.
CHUNK_BYTES = 4 << 20
#: Parquet text takes about this share of the text's own bytes.
PARQUET_SHARE = 0.5
#: Estimates above this are none.
UNKNOWN = 1 << 50
#: With it, a job's shuffle files go at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's bytes; for a scan, the files' size. Starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def chunk_count(df: DataFrame, per: int = CHUNK_BYTES) -> int:
    """So many chunks that each holds about `per` bytes of text; grows with the input. Measures the texts where the optimizer has no estimate (rows from Python, joins)."""
    size = size_bytes(df) / PARQUET_SHARE
    if size > UNKNOWN:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(1, size / per))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; an error on a cluster without that setting."""
    return shared_folder(spark)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Jobs started in it leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The frame written to a table in the shared folder and read back: cuts lineage, survives lost executors, and frees what was shuffled for it."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that cut() wrote."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        remove_folder(spark, f)


def remove_folder(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def batches(spark: SparkSession) -> None:
    """Arrow batches small enough for a worker, whatever the texts' length: bounded in bytes too, unless the session has smaller bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key, None)
        if not (now and now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def chunked(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The columns with a chunk number, dealt out by it; the same frame read twice in a plan is shuffled once (reused exchange)."""
    parts = max(1, min(n, max(12, n // 3)))
    return df.select("doc_id", *cols, F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int").alias("chunk")).repartition(parts, "chunk")


class Memo:
    """A cache of two generations: when the new one is full it becomes the old one, and what is used again moves over."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def lack(self, keys) -> list:
        """Makes room, and returns those of the distinct keys that aren't there."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        out = []
        for k in keys - self.new.keys():
            got = self.old.get(k)
            if got is None:
                out.append(k)
            else:
                self.new[k] = got
        return out

    def values(self, keys: list[str], make: Callable[[list[str]], list], longest: int) -> list:
        """The values of distinct keys; make() gives those that aren't there, of which keys beyond `longest` aren't kept."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        out = list(map(self.new.get, keys))
        lack = [i for i, x in enumerate(out) if x is None]
        if not lack:
            return out
        want = [keys[i] for i in lack]
        got = list(map(self.old.get, want))
        if fresh := [k for k, x in zip(want, got, strict=True) if x is None]:
            made = iter(make(fresh))
            got = [next(made) if x is None else x for x in got]
        for i, k, x in zip(lack, want, got, strict=True):
            out[i] = x
            if len(k) <= longest:
                self.new[k] = x
        return out
