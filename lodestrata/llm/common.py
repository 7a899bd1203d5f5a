"""What several training-data operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File extensions of source code and the language of each.
LANGUAGE_OF = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}

#: Tables are broadcast up to so many rows and bytes, which are measured first; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path component with its dot, '' when there is none."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def is_source(path: Column) -> Column:
    """True for the five source extensions; false, never null, for a null path."""
    return F.coalesce(extension(path).isin(*LANGUAGE_OF), F.lit(False))


def language_of(path: Column) -> Column:
    """'python' or 'typescript' for a source path, else null."""
    ext = extension(path)
    return F.when(ext == ".py", "python").when(ext.isin(".ts", ".tsx", ".js", ".jsx"), "typescript")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Rows dealt evenly over the cores when the scan has fewer partitions than there are cores.

    A table of one small file is one partition, however many cores stand idle.
    A table of many files keeps the partitions of its scan and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < cores else df


def partitions(df: DataFrame) -> int:
    """Partitions for work that is heavy for its bytes: as many as a shuffle has, or one a core if that is more."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder the session names; without one only a local session, as in tests, gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder, without the plan that made them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows and bytes; for results that are cheap to write and measure."""
    df = cut(df)
    width = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.coalesce(F.size(field.name), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
