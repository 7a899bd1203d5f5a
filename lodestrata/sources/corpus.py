"""Source trees read as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.filters import keep_bytes


def decode(content: Column) -> Column:
    """Bytes as text; a byte that is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of the text files below a directory that are small enough."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = rows.where(keep_bytes(F.col("content")))
    return rows.select(F.substring(place, len(base) + 1, 2**31 - 1).alias("path"), F.col("length").alias("size"), decode(F.col("content")).alias("content"))


def repository(url: Column) -> Column:
    """struct<owner, name> of a repository address https://host/owner/name, with or without .git or a slash at its end; null for others."""
    rx = r"^https?://[\w.-]+/([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
    trimmed = F.trim(url)
    owner, name = F.regexp_extract(trimmed, rx, 1), F.regexp_extract(trimmed, rx, 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), name.alias("name")))
