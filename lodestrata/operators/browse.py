"""Overviews of repositories: counts, languages, key files, symbols, entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import basename

TOP_FILES = 5
TOP_SYMBOLS = 10
SYMBOL_INDEX = 200
# Names by which a way into a program is known, and places where such a name is a decoy.
ENTRY_POINTS = ("main.py", "__main__.py", "manage.py", "app.py", "cli.py", "index.ts", "index.js", "server.ts", "Dockerfile", "Makefile")
DECOY_DIRS = ("tests", "test", "examples", "docs", "scripts")
SCOPE = ("repo_id", "sha")


def counts(repos: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every repository with the chunks and symbols of its last indexed commit; 0 where there are none."""
    n = lambda rows, name: rows.groupBy(*SCOPE).agg(F.count("*").alias(name))
    heads = repos.select(F.col("id").alias("repo_id"), "owner", "name", "status", F.col("last_indexed_sha").alias("sha"))
    out = heads.join(n(chunks, "n_chunks"), list(SCOPE), "left").join(n(symbols, "n_symbols"), list(SCOPE), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_symbols")})


def language_files(chunks: DataFrame) -> DataFrame:
    """(repo_id, sha, language, n_files): distinct files of each language."""
    return chunks.groupBy(*SCOPE, "language").agg(F.countDistinct("path").alias("n_files"))


def _core_path(path: Column) -> Column:
    return ~path.like("test%") & ~path.like("%/test%") & ~path.like("example%")


def key_files(symbols: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """(repo_id, sha, path, defs, rank): the files of each tree with the most definitions, tests and examples aside."""
    per_file = symbols.where(_core_path(F.col("path"))).groupBy(*SCOPE, "path").agg(F.count("*").alias("defs"))
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("defs"), "path")
    return per_file.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_symbols(symbols: DataFrame, n: int = TOP_SYMBOLS) -> DataFrame:
    """(repo_id, sha, name, kind, path, line, position): public classes of the key files, densest file first."""
    dense = key_files(symbols).select(*SCOPE, "path", "rank")
    public = symbols.where((F.col("kind") == "class") & F.col("parent_symbol").isNull() & (F.left("name", F.lit(1)) != "_"))
    w = Window.partitionBy(*SCOPE).orderBy("rank", "line", "id")
    return public.join(dense, [*SCOPE, "path"]).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(*SCOPE, "name", "kind", "path", "line", "position")


def entry_points(files: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """(repo_id, sha, path, position): likely ways in, decoys last, shallow first."""
    rows = files.where(basename(F.col("path")).isin(*ENTRY_POINTS)).select(*SCOPE, "path").distinct()
    noise = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, DECOY_DIRS))).cast("int")
    w = Window.partitionBy(*SCOPE).orderBy(noise, F.size(F.split("path", "/")), "path")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def readmes(files: DataFrame) -> DataFrame:
    """(repo_id, sha, path, n_chars): the first readme of each tree, by path."""
    rows = files.where(F.lower(basename(F.col("path"))).startswith("readme"))
    first = rows.groupBy(*SCOPE).agg(F.min_by(F.struct("path", "content"), F.struct(F.size(F.split("path", "/")), "path", "id")).alias("r"))
    return first.select(*SCOPE, "r.path", F.length("r.content").alias("n_chars"))


def starter_questions(symbols: DataFrame, n: int = 5) -> DataFrame:
    """(repo_id, sha, question, position): questions to begin with, from the top symbols and key files."""
    about = top_symbols(symbols).select(*SCOPE, F.format_string("What does `%s` in %s do?", "name", "path").alias("question"), F.col("position"))
    files = key_files(symbols).select(*SCOPE, F.format_string("How is %s organised?", "path").alias("question"), (F.col("rank") + TOP_SYMBOLS).alias("position"))
    w = Window.partitionBy(*SCOPE).orderBy("position", "question")
    return about.unionByName(files).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def symbol_index(symbols: DataFrame, n: int = SYMBOL_INDEX) -> DataFrame:
    """(repo_id, sha, name, kind, path, line): top-level symbols of each tree by name."""
    w = Window.partitionBy(*SCOPE).orderBy("name", "path", "line", "id")
    return symbols.where("parent_symbol is null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select(*SCOPE, "name", "kind", "path", "line")


def outline(symbols: DataFrame) -> DataFrame:
    """(repo_id, sha, path, n_symbols, outline): the symbols of each file in order of their lines."""
    entry = F.struct("line", "kind", "name")
    listed = F.array_sort(F.collect_list(entry))
    return symbols.groupBy(*SCOPE, "path").agg(F.count("*").alias("n_symbols"), F.array_join(F.transform(listed, lambda e: F.concat_ws(" ", e["line"].cast("string"), e["kind"], e["name"])), "; ").alias("outline"))


def tree(files: DataFrame) -> DataFrame:
    """(repo_id, sha, parent, name, is_dir, n_files, position): every entry of every directory, directories first, then by name."""
    parts = F.split("path", "/")
    rows = files.select(*SCOPE, "path").distinct().select(*SCOPE, parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("d"))
    rows = rows.select(*SCOPE, F.array_join(F.slice("parts", 1, F.col("d") - 1), "/").alias("parent"), F.element_at("parts", F.col("d")).alias("name"), (F.col("d") < F.size("parts")).alias("is_dir"))
    entries = rows.groupBy(*SCOPE, "parent", "name", "is_dir").agg(F.count("*").alias("n_files"))
    return entries.withColumn("position", F.row_number().over(Window.partitionBy(*SCOPE, "parent").orderBy(F.desc("is_dir"), "name")))


def complete(repos: DataFrame, **tables: DataFrame) -> DataFrame:
    """(repo_id, complete): whether every table has rows of a repository's last indexed commit."""
    heads = repos.select(F.col("id").alias("repo_id"), F.col("last_indexed_sha").alias("sha"))
    has = F.lit(True)
    for name, rows in tables.items():
        heads = heads.join(rows.select(*SCOPE).distinct().withColumn(name, F.lit(True)), list(SCOPE), "left")
        has = has & F.coalesce(name, F.lit(False))
    return heads.select("repo_id", has.alias("complete"))


def with_repos(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows (repo_id, ...) of known repositories with ``owner`` and ``name`` of each."""
    return rows.join(repos.select(F.col("id").alias("repo_id"), "owner", "name"), "repo_id")


def orientation(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, sha, languages, key_files, top_symbols, entry_points, readme): one row a tree, what a newcomer is shown, each list in its order."""

    def listed(rows: DataFrame, order, shown, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), shown.alias("s"))))  # a few entries a tree
        return rows.groupBy(*SCOPE).agg(F.array_join(F.transform(entries, lambda e: e["s"]), "; ").alias(name))

    parts = [
        listed(language_files(chunks), F.struct(-F.col("n_files"), "language"), F.concat_ws(" ", "language", F.col("n_files").cast("string")), "languages"),
        listed(key_files(symbols), F.col("rank"), F.col("path"), "key_files"),
        listed(top_symbols(symbols), F.col("position"), F.col("name"), "top_symbols"),
        listed(entry_points(files), F.col("position"), F.col("path"), "entry_points"),
        readmes(files).select(*SCOPE, F.col("path").alias("readme")),
    ]
    out = files.select(*SCOPE).distinct()
    for part in parts:
        out = out.join(part, list(SCOPE), "left")
    return out
