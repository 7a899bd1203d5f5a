"""Navigation over an indexed corpus: files, directories, text, symbols, history."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import lines, words

MAX_LINES = 400
MAX_MATCHES = 50
MAX_ROWS = 20
MAX_COMMITS = 20
SCOPE = ("repo_id", "sha")


def file_lines(files: DataFrame) -> DataFrame:
    """(repo_id, sha, path, line_no, line) of every line, numbered from 1."""
    return files.select(*SCOPE, "path", F.posexplode(lines(F.col("content"))).alias("pos", "line")).select(*SCOPE, "path", (F.col("pos") + 1).alias("line_no"), "line")


def read_file(files: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """The numbered lines start..end of each file, at most :data:`MAX_LINES`, and whether some were left out."""
    every = lines(F.col("content"))
    last = F.least(F.size(every), F.lit(end if end is not None else 2**31 - 1))
    shown = F.slice(every, start, F.greatest(F.least(last - (start - 1), F.lit(MAX_LINES)), F.lit(0)))
    cut = last - (start - 1) > MAX_LINES
    return files.where((F.size(every) >= start) & (last >= start)).select(*SCOPE, "path", F.size(every).alias("n_lines"), F.size(shown).alias("n_shown"), F.array_join(shown, "\n").alias("text"), cut.alias("truncated"))


def list_dir(files: DataFrame, path: str = "") -> DataFrame:
    """(repo_id, sha, entry): one level of a directory; directories end in a slash. The path is taken literally."""
    prefix = f"{path.strip('/')}/" if path.strip("/") else ""
    rest = F.substring("path", len(prefix) + 1, 2**31 - 1)
    entry = F.when(F.instr(rest, "/") > 0, F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    return files.where(F.col("path").startswith(prefix)).select(*SCOPE, entry.alias("entry")).where("entry != ''").distinct()


def required_literal(pattern: str) -> str | None:
    """A text that every match of a pattern must hold, or None when there is no such text to be sure of."""
    if re.search(r"[|]|\(\?", pattern):
        return None
    best = run = ""
    i, depth = 0, 0
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        if c == "\\":
            literal, i = (nxt if nxt and not nxt.isalnum() else None), i + 1
            nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        elif c == "[":
            close = pattern.find("]", i + 2)
            literal, i = None, close if close > 0 else len(pattern)
            nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        elif c in "(":
            depth, literal = depth + 1, None
        elif c in ")":
            depth, literal = depth - 1, None
        elif c in ".^$*+?{}":
            literal = None
            if c == "{":
                i = max(i, pattern.find("}", i))
        else:
            literal = c if depth == 0 else None
        if literal is not None and nxt not in ("*", "?", "{"):
            run += literal
        else:
            run = ""
        best = run if len(run) > len(best) else best
        if literal is not None and nxt == "+":
            run = ""
        i += 1
    return best if len(best) >= 3 else None


def grep(files: DataFrame, pattern: str, path: str = "", cap: int = MAX_MATCHES) -> DataFrame:
    """(repo_id, sha, path, line_no, line, total): matching lines of each tree, the first ``cap`` by path and line, with how many there are.

    ``path`` is a file or a directory. Texts without the pattern's literal part are dropped before they are cut into lines.
    One pass counts the matches of each file and keeps its first ``cap``; of each tree only files that can reach the first
    ``cap`` are then unfolded.
    """
    rows = files
    if p := path.strip("/"):
        rows = rows.where((F.col("path") == p) | F.col("path").startswith(p + "/"))
    if literal := required_literal(pattern):
        rows = rows.where(F.col("content").contains(literal))
    numbered = F.transform(lines(F.col("content")), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    matched = F.filter(numbered, lambda m: m["line"].rlike("(?U)" + pattern.replace("(?P<", "(?<")))
    found = rows.select(*SCOPE, "path", matched.alias("m")).select(*SCOPE, "path", F.size("m").alias("n"), F.slice("m", 1, cap).alias("first")).where("n > 0")
    tree = Window.partitionBy(*SCOPE)
    before = F.sum("n").over(tree.orderBy("path")) - F.sum("n").over(Window.partitionBy(*SCOPE, "path"))  # matches in files of lesser path
    found = found.withColumn("total", F.sum("n").over(tree)).withColumn("before", before).where(F.col("before") < cap)
    found = found.select(*SCOPE, "path", "total", F.explode("first").alias("m")).select(*SCOPE, "path", "m.line_no", "m.line", "total")
    return found.withColumn("n", F.row_number().over(tree.orderBy("path", "line_no", "line"))).where(F.col("n") <= cap).drop("n")


def lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The file of each key (repo_id, sha, path) that there is; of several loads the first by id."""
    rows = files.join(keys.select(*SCOPE, "path").distinct(), [*SCOPE, "path"], "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*SCOPE, "path").orderBy("id"))).where("n = 1").drop("n")


def first_symbols(symbols: DataFrame, cap: int = MAX_ROWS) -> DataFrame:
    """(repo_id, sha, name, n, places): every symbol name of a tree with how often it is defined and its first places."""
    name = Window.partitionBy(*SCOPE, "name")
    places = symbols.groupBy(*SCOPE, "name", "path", "line", "kind").agg(F.count("*").alias("loads"))
    ranked = places.withColumn("n", F.sum("loads").over(name)).withColumn("k", F.row_number().over(name.orderBy("path", "line", "kind"))).where(F.col("k") <= cap)
    return ranked.groupBy(*SCOPE, "name", "n").agg(F.array_sort(F.collect_list(F.struct("path", "line", "kind"))).alias("places"))


def find_symbol(symbols: DataFrame, name: str, cap: int = MAX_ROWS) -> DataFrame:
    """(repo_id, sha, path, line, kind, truncated): where a name is defined in each tree, the first by path and line."""
    w = Window.partitionBy(*SCOPE).orderBy("path", "line", "id")
    rows = symbols.where(F.col("name") == name).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap + 1)
    more = rows.groupBy(*SCOPE).agg((F.count("*") > cap).alias("truncated"))
    return rows.where(F.col("n") <= cap).join(more, list(SCOPE)).select(*SCOPE, "path", "line", "kind", "truncated")


def find_references(chunks: DataFrame, name: str, cap: int = MAX_ROWS) -> DataFrame:
    """(repo_id, sha, path, start_line, first_line, truncated): chunks that hold every word of a name, the first by path and line, and whether there are more."""
    wanted = [w.lower() for w in re.findall(r"[^\W]+", name)]
    text = F.concat_ws(" ", "content", "symbol_name")
    rows = chunks
    for w in wanted:
        rows = rows.where(F.lower(text).contains(w) & F.array_contains(words(text), w))
    w = Window.partitionBy(*SCOPE).orderBy("path", "start_line", "id")
    rows = rows.select(*SCOPE, "path", "start_line", "id", F.get(F.split("content", "\n"), 0).alias("first_line"))
    rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap + 1)
    rows = rows.withColumn("truncated", F.max("n").over(Window.partitionBy(*SCOPE)) > cap).where(F.col("n") <= cap)
    return rows.select(*SCOPE, "path", "start_line", "first_line", "truncated")


def git_log(files: DataFrame, n: int = 10) -> DataFrame:
    """(repo_id, sha, path, position, hash, author, date, subject): the newest commits of each file."""
    n = min(n, MAX_COMMITS)
    rows = files.where("git_log != ''").select("id", *SCOPE, "path", F.posexplode(F.slice(F.split("git_log", "\n"), 1, n)).alias("position", "entry"))
    part = F.split("entry", r"\|", 4)
    return rows.select("id", *SCOPE, "path", "position", F.get(part, 0).alias("hash"), F.get(part, 1).alias("author"), F.get(part, 2).alias("date"), F.get(part, 3).alias("subject"))


#: The tools by the name that a caller uses.
TOOLS = {"read_file": read_file, "list_dir": list_dir, "grep": grep, "find_symbol": find_symbol, "find_references": find_references, "git_log": git_log}
