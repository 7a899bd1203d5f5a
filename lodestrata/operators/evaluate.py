"""Retrieval quality: recall of expected files, by question, repository and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.02


def recall(truth: Column, hits: Column) -> Column:
    """Share of the expected items that were hit; 1 when nothing is expected."""
    expected = F.array_distinct(truth)
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(expected, hits)) / F.nullif(F.size(expected), F.lit(0)))


def searched(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions (question_id, repo_id, truth) with ``hits``, the files of their hits (question_id, path), and ``missing``, those of truth that were not hit."""
    files = hits.groupBy("question_id").agg(F.array_sort(F.collect_set("path")).alias("hits"))  # at most k a question
    rows = questions.select("question_id", "repo_id", "truth").join(files, "question_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    return rows.withColumn("missing", F.array_sort(F.array_except("truth", "hits")))


def report(questions: DataFrame) -> DataFrame:
    """(repo_id, n_questions, recall, files_seen) from rows (repo_id, truth, hits)."""
    rows = questions.select("repo_id", recall(F.col("truth"), F.col("hits")).alias("recall"), F.size(F.array_distinct("hits")).alias("seen"))
    return rows.groupBy("repo_id").agg(F.count("*").alias("n_questions"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("seen"), 9).alias("files_seen"))


def overall(by_repo: DataFrame) -> DataFrame:
    """(recall, n_repos): the mean over repositories, each counted once."""
    return by_repo.agg(F.round(F.avg("recall"), 9).alias("recall"), F.count("*").alias("n_repos"))


def check_regression(now: float, baseline: float, tolerance: float = TOLERANCE) -> None:
    """Raise if recall fell by more than the tolerance."""
    if now < baseline - tolerance:
        raise ValueError(f"recall fell from {baseline:.4f} to {now:.4f}")


def write_results(searched_: DataFrame, path: str) -> None:
    """Write every question with its recall, hits and missing files as JSON lines, a folder a repository."""
    rows = searched_.withColumn("recall", recall(F.col("truth"), F.col("hits")))
    rows.repartition("repo_id").write.mode("overwrite").partitionBy("repo_id").json(path)
