"""Session helpers."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on the executors, wherever they run: sends it once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_inkloom_shipped", False):
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="inkloom-")) / "inkloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"inkloom/{f.relative_to(root)}")
        sc.addPyFile(str(path))
        sc._inkloom_shipped = True
    return spark


def shipped(f):
    """A query that ships the package first."""

    @functools.wraps(f)
    def run(spark, *args):
        return f(ship(spark), *args)

    return run


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a temporary one, if there is one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_inkloom_shared", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext._inkloom_shared = "file://" + tempfile.mkdtemp(prefix="inkloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df):
    """The frame written once to the shared folder and read back, for results that are dear to make and read often."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
