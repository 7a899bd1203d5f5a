"""Which files of a tree are indexed, and in what order they are taken."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import basename, depth, language

MAX_FILE_BYTES = 1_048_576
MAX_FILES = 4000
MAX_BYTES = 40 * 1024 * 1024
# Names that the filters of the index go by.
DROP_DIRS = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".next", ".venv", "out")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "Pipfile.lock", "uv.lock", "Cargo.lock")
DROP_SUFFIXES = (".min.js", ".min.css", ".min.mjs", ".map", ".d.ts")
GENERATED_MARKERS = (".generated.", ".pb.")
DOC_FILENAMES = ("readme.md", "readme.rst", "readme.txt", "pyproject.toml", "package.json", "setup.py", "setup.cfg", "cargo.toml", "go.mod", "dockerfile", "makefile")
LOW_PRIORITY_DIRS = ("test", "tests", "spec", "specs", "example", "examples", "docs", "doc", "benchmark", "benchmarks", "fixtures", "testdata", "third_party")


def keep_path(path: Column) -> Column:
    """Whether a path is source code that the index takes."""
    name = basename(path)
    dropped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DROP_DIRS))) | name.isin(*LOCKFILES)
    for suffix in DROP_SUFFIXES:
        dropped = dropped | name.endswith(suffix)
    for marker in GENERATED_MARKERS:
        dropped = dropped | name.contains(marker)
    return language(path).isNotNull() & ~dropped


def keep_bytes(content: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Whether binary content is small enough and text: no NUL in its first kibibyte."""
    return (F.octet_length(content) <= max_bytes) & ~F.contains(F.substring(content, 1, 1024), F.lit(b"\x00"))


def is_doc(path: Column) -> Column:
    """Manifests and readmes at the root of a tree, kept for orientation."""
    return (F.instr(path, "/") == 0) & F.lower(path).isin(*DOC_FILENAMES)


def source_files(files: DataFrame) -> DataFrame:
    return files.where(keep_path(F.col("path")))


def doc_files(files: DataFrame) -> DataFrame:
    """Documents of the tree that are not source files of it as well; both are told by the path."""
    return files.where(is_doc(F.col("path")) & ~F.coalesce(keep_path(F.col("path")), F.lit(False)))


def not_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files whose (repo_id, path) is not in a list of ignored paths."""
    return files.join(ignored.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


def priority(path: Column) -> tuple[Column, Column, Column, Column]:
    """Sort keys: source before tests and examples, then shallow, then short paths, then by name."""
    low = F.exists(F.split(path, "/"), lambda p: F.lower(p).isin(*LOW_PRIORITY_DIRS))
    return low.cast("int"), depth(path), F.length(path), path


def within_budget(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(repo_id, sha, path, size, kept): files taken in order of priority while they fit.

    A file that does not fit is skipped and uses up nothing, so this is a fold
    over each tree, not a running sum. Paths and sizes, not contents, are dealt
    by tree and sorted; a task streams through its trees with two counters, so
    no tree is held whole.
    """
    low, deep, long, path = priority(F.col("path"))
    rows = files.select("repo_id", "sha", "path", "size", low.alias("low"), deep.alias("deep"), long.alias("long"))
    rows = rows.repartition("repo_id", "sha").sortWithinPartitions("repo_id", "sha", "low", "deep", "long", "path", "size")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, n, total = None, 0, 0
        for batch in batches:
            kept = []
            for repo, sha, size in zip(batch.repo_id, batch.sha, batch["size"], strict=True):
                if (repo, sha) != tree:
                    tree, n, total = (repo, sha), 0, 0
                fits = n < max_files and total + size <= max_bytes
                kept.append(fits)
                if fits:
                    n, total = n + 1, total + size
            yield batch.assign(kept=kept)

    return rows.select("repo_id", "sha", "path", "size").mapInPandas(fold, "repo_id long, sha string, path string, size long, kept boolean")
