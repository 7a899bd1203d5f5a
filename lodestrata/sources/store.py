"""The index on disk: tables partitioned by repository and commit, with a manifest written last.

A commit's rows replace those written for it before; other commits stay, so
references to them still resolve. Readers start from the manifest, so a write
that is cut off shows nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("files", "chunks", "symbols")
KEYS = ("repo_id", "sha")


def merge_manifest(old: DataFrame, new: DataFrame, update_latest: bool = True) -> DataFrame:
    """The manifest (id, owner, name, default_branch, stars, last_indexed_sha, status) after an upsert by id.

    Columns that the new row leaves null keep their old value. Without ``update_latest`` the pointer stays as it was, null for a new row.
    """
    columns = [c for c in old.columns if c != "id"]
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    out = []
    for c in columns:
        if c == "last_indexed_sha" and not update_latest:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
    return joined.select(F.coalesce("n.id", "o.id").alias("id"), *out)


def write_index(spark: SparkSession, root: str, tables: dict[str, DataFrame], repos: DataFrame, update_latest: bool = True) -> None:
    """Write files, chunks and symbols of the commits they hold, then the manifest."""
    for name in TABLES:
        if name in tables:
            rows = tables[name].repartition(*KEYS) if name == "symbols" else tables[name]
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{root}/{name}")
    old = read_manifest(spark, root, repos.schema)
    version = max((int(v) for v in _versions(spark, root)), default=0) + 1
    merge_manifest(old, repos, update_latest).coalesce(1).write.parquet(f"{root}/repos/v={version}")


def _versions(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/repos")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return [p.getName().split("=")[1] for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def read_manifest(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The newest manifest that was written to its end; empty before the first."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/repos/v={max(map(int, versions))}")


def read_table(spark: SparkSession, root: str, name: str, latest: bool = True) -> DataFrame:
    """A table of the index; only rows of each repository's last indexed commit unless ``latest`` is off."""
    rows = spark.read.parquet(f"{root}/{name}")
    if not latest:
        return rows
    heads = read_manifest(spark, root).where("last_indexed_sha is not null").select(F.col("id").alias("repo_id"), F.col("last_indexed_sha").alias("sha"))
    return rows.join(heads, list(KEYS), "left_semi")


def backfill(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks (id, embedding, ...) with missing vectors filled from (id, embedding)."""
    fresh = vectors.groupBy("id").agg(F.first("embedding", ignorenulls=True).alias("fresh"))
    return chunks.join(fresh, "id", "left").withColumn("embedding", F.coalesce("embedding", "fresh")).drop("fresh")


def pending(rows: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo_id, id, position): rows (repo_id, id) without a vector, oldest first within each repository, the first ``limit`` of each if there is one."""
    missing = rows.select("repo_id", "id").join(vectors.where("embedding is not null").select("id"), "id", "left_anti")
    out = missing.select("repo_id", "id", F.row_number().over(Window.partitionBy("repo_id").orderBy("id")).alias("position"))
    return out if limit is None else out.where(F.col("position") <= limit)
