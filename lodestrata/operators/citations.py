"""References to files and lines inside answers, checked against an indexed tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import citations, lines


def cited(texts: DataFrame) -> DataFrame:
    """(doc_id, repo_id, sha, n, path, first, last, ref): every reference of every text (doc_id, repo_id, sha, text), and how it is written."""
    rows = texts.select("doc_id", "repo_id", "sha", F.posexplode(citations(F.col("text"))).alias("n", "c"))
    return rows.select("doc_id", "repo_id", "sha", "n", "c.path", "c.first", "c.last", "c.ref")


def line_counts(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, sha, path, n_lines): the lines of each wanted file at its commit; of several loads the longest."""
    rows = files.join(wanted.select("repo_id", "sha", "path").distinct(), ["repo_id", "sha", "path"], "left_semi")
    return rows.groupBy("repo_id", "sha", "path").agg(F.max(F.size(lines(F.col("content")))).alias("n_lines"))


def validate(texts: DataFrame, files: DataFrame) -> DataFrame:
    """The references of :func:`cited` with ``valid``: the file is there at that commit and 1 <= first <= last <= its lines."""
    refs = cited(texts)
    checked = refs.join(line_counts(files, refs), ["repo_id", "sha", "path"], "left")
    valid = F.coalesce((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("n_lines")), F.lit(False))
    return checked.select("doc_id", "repo_id", "sha", "n", "path", "first", "last", "ref", valid.alias("valid"))


def summary(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, n_cited, n_valid, invalid): each citing text with its invalid references."""
    bad = F.array_sort(F.collect_set(F.when(~F.col("valid"), F.col("ref"))))
    return validate(texts, files).groupBy("doc_id").agg(F.count("*").alias("n_cited"), F.count_if("valid").alias("n_valid"), F.array_join(bad, " ").alias("invalid"))


def stripped(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, n_valid, n_invalid, answer): each text without its invalid references; a text that cites nothing stays as it is."""
    wrong = F.transform(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("n", "ref")))), lambda s: s["ref"])
    by = validate(texts, files).groupBy("doc_id").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), wrong.alias("wrong"))
    rows = texts.select("doc_id", "text").join(by, "doc_id", "left")
    answer = F.aggregate(F.coalesce("wrong", F.array().cast("array<string>")), F.col("text"), lambda t, ref: F.replace(t, ref, F.lit("")))
    return rows.select("doc_id", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), answer.alias("answer"))


def files_read(refs: DataFrame) -> DataFrame:
    """(doc_id, path, position): the files that the references of :func:`cited` name, each once, in the order in which they first come up."""
    first = refs.groupBy("doc_id", "path").agg(F.min("n").alias("n"))
    return first.select("doc_id", "path", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("position"))
