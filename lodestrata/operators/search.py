"""Lexical, vector and hybrid search over chunks or documents."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import postings
from lodestrata.functions.text import words
from lodestrata.functions.vector import cosine_distance, unit

CANDIDATES = 50
RRF_K = 60
#: Bytes of text and number of questions that meet in one task when many questions are searched.
BLOCK_BYTES, BLOCK_QUESTIONS = 16 << 20, 500_000


def latest(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of each repository's last indexed commit."""
    heads = repos.where("last_indexed_sha is not null").select(F.col("id").alias("repo_id"), F.col("last_indexed_sha").alias("sha"))
    return rows.join(heads, ["repo_id", "sha"], "left_semi")


def tf_score(tokens: Column, terms: list[str]) -> Column:
    """Sum over the distinct terms of tf / (tf + 1), rounded to nine places."""
    total = F.lit(0.0)
    for term in dict.fromkeys(terms):
        tf = F.size(F.filter(tokens, lambda t: t == F.lit(term))).cast("double")  # noqa: B023
        total = total + tf / (tf + 1)
    return F.round(total, 9)


def lexical(texts: DataFrame, terms: list[str], every: bool = True, k: int | None = CANDIDATES) -> DataFrame:
    """(id, score) of the texts (id, text) that hold every term, or any, best first.

    A plain ``contains`` comes before the tokeniser and spares it most texts.
    """
    scored = _scored(texts, terms, every)
    if every:
        scored = scored.where("strict")
    scored = scored.select("id", "score")
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def _scored(texts: DataFrame, terms: list[str], every: bool) -> DataFrame:
    """(id, score, strict) of the texts with any term, or with ``every`` at least those with all; strict: it has all."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return texts.select("id", F.lit(0.0).alias("score"), F.lit(False).alias("strict")).limit(0)
    has = [F.lower("text").contains(t) for t in terms]
    tokens = texts.where(_all(has) if every else _any(has)).select("id", words(F.col("text")).alias("tokens"))
    # only the terms among the words, so that counting them is short work
    tokens = tokens.select("id", F.filter("tokens", lambda t: t.isin(*terms)).alias("tokens")).where(F.size("tokens") > 0)
    strict = _all([F.array_contains("tokens", t) for t in terms])
    return tokens.select("id", tf_score(F.col("tokens"), terms).alias("score"), strict.alias("strict"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def phrase(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(id) of the texts that hold the terms next to each other, in order."""
    joined = " " + " ".join(t.lower() for t in terms) + " "
    return texts.where(F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).contains(joined)).select("id")


def hashed_counts(texts: DataFrame, dims: int = 64) -> DataFrame:
    """(id, counts): how many words of each text (id, text) fall into each of so many buckets, by their MD5; a text without words has no row.

    A row's words are its own business: they are counted where the row lies, without a shuffle.
    """

    @F.pandas_udf("array<long>")
    def counted(tokens: pd.Series) -> pd.Series:
        buckets: dict[str, int] = {}
        out = []
        for row in tokens:
            at = [buckets[w] if w in buckets else buckets.setdefault(w, int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dims) for w in row]
            out.append(np.bincount(at, minlength=dims))
            if len(buckets) > 500_000:  # only a cache
                buckets.clear()
        return pd.Series(out)

    rows = texts.select("id", words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("id", counted("tokens").alias("counts"))


def embed(texts: DataFrame, dims: int = 64, model=None) -> DataFrame:
    """(id, embedding) of texts (id, text): by a model, a function from that DataFrame to this, or by hashed word counts."""
    if model is not None:
        return model(texts)
    return hashed_counts(texts, dims).select("id", unit(F.col("counts")).alias("embedding"))


def nearest(vectors: DataFrame, query: Column, k: int | None = CANDIDATES) -> DataFrame:
    """(id, distance) of the vectors (id, embedding) closest to a query vector, exact."""
    out = vectors.select("id", cosine_distance(F.col("embedding"), query).alias("distance")).where("distance is not null")
    return out if k is None else out.orderBy("distance", "id").limit(k)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors of every query row (query_id, query).

    Queries are a stated set: each vector row meets each query once, and only the k best of a task are shuffled.
    """
    from lodestrata.functions.knn import block_knn

    return block_knn(vectors, queries, k)


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) from rank lists (id, rank): reciprocal ranks summed, rounded to nine places."""
    return ranked.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """(id, rank) of a candidate list; the list is bounded by its caller's k, so one partition holds it."""
    return hits.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def hybrid(texts: DataFrame, vectors: DataFrame, terms: list[str], query: Column, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """(id, score, text): lexical and vector candidates fused by reciprocal rank, best first.

    Without any vector the lexical half takes texts with any term instead of every term. Distances come before the check
    that a vector belongs to a text, so ids and not vectors are shuffled. The candidates, which their number bounds, are
    read where the query is put together: so either list is made once, and the last scan asks for k ids only.
    """
    spark = texts.sparkSession
    near = nearest(vectors, query, None).join(texts.select("id"), "id", "left_semi").orderBy("distance", "id").limit(candidates)
    near = [r.id for r in near.collect()]
    lex = [r.id for r in lexical(texts, terms, every=bool(near), k=candidates).collect()]
    lists = [(i, n) for ids in (near, lex) for n, i in enumerate(ids, 1)]
    best = rrf(spark.createDataFrame(lists, "id long, rank int")).orderBy(F.desc("score"), "id").limit(k).collect()
    rows = texts.where(F.col("id").isin([r.id for r in best])).join(F.broadcast(spark.createDataFrame(best, "id long, score double")), "id")
    return rows.select("id", "score", "text").orderBy(F.desc("score"), "id")


def search_code(chunks: DataFrame, vectors: DataFrame, terms: list[str], query: Column, k: int = 10, repo_id: int | None = None, sha: str | None = None, repos: DataFrame | None = None) -> DataFrame:
    """(position, path, score, text): the best chunks of one tree, or of all last indexed commits of ``repos``, as an agent reads them."""
    scoped = latest(chunks, repos) if repo_id is None else chunks.where((F.col("repo_id") == repo_id) & (F.col("sha") == sha))
    best = hybrid(scoped.select("id", F.col("content").alias("text")), vectors, terms, query, min(k, 10))
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    shown = F.concat(place, F.lit(" ("), F.coalesce("symbol_name", F.lit("module")), F.lit(")\n"), "content")
    rows = scoped.join(F.broadcast(best.select("id", "score")), "id")
    position = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # k rows
    return rows.select("id", "path", "score", shown.alias("text")).select(position.alias("position"), "path", "score", "text")


def parse_query(query: str) -> list[list[tuple[str, list[str]]]]:
    """Alternatives, each a list of (kind, words) that must all hold: ``word``, ``"a phrase"`` and ``-word``; ``or`` parts alternatives."""
    out: list[list[tuple[str, list[str]]]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)"([^"]*)"?|(\S+)', query):
        if bare.lower() == "or" and not quoted:
            out.append([])
            continue
        if bare.startswith("-"):
            minus, bare = "-", bare[1:]
        found = re.findall(r"\w+", (quoted or bare).lower())
        if found:
            out[-1].append(("not" if minus else "all", found))
    return [alternative for alternative in out if alternative]


def web(texts: DataFrame, query: str, k: int | None = CANDIDATES) -> DataFrame:
    """(id, score) of the texts that a query of :func:`parse_query` matches, scored by its words that must hold, best first."""
    alternatives = parse_query(query)
    wanted = list(dict.fromkeys(w for a in alternatives for kind, words_ in a if kind == "all" for w in words_))
    if not wanted:
        return texts.select("id", F.lit(0.0).alias("score")).limit(0)
    joined = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))

    def holds(kind: str, found: list[str]) -> Column:
        has = F.array_contains("tokens", found[0]) if len(found) == 1 else joined.contains(" " + " ".join(found) + " ")
        return ~has if kind == "not" else has

    likely = _any([_all([F.lower("text").contains(w) for kind, found in a if kind == "all" for w in found] or [F.lit(True)]) for a in alternatives])
    rows = texts.where(likely).select("id", words(F.col("text")).alias("tokens")).where(_any([_all([holds(*item) for item in a]) for a in alternatives]))
    rows = rows.select("id", tf_score(F.col("tokens"), wanted).alias("score"))
    return rows if k is None else rows.orderBy(F.desc("score"), "id").limit(k)


def batch(texts: DataFrame, questions: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, block_questions: int = BLOCK_QUESTIONS) -> DataFrame:
    """(question_id, id, path, score, rank): the k best texts (repo_id, id, path, text) of each question (question_id, repo_id, terms) of its repository.

    The texts of a repository are dealt into blocks of a bounded number of bytes, and each of them meets the repository's
    questions in one task (:func:`lodestrata.functions.postings.best`), which gives out the k best of every question: what
    is shuffled are the words of the texts, once, and few hits, not the pairs of questions and texts that share a word.
    """
    asked = questions.where("repo_id is not null").select("question_id", "repo_id", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    rows = texts.where("repo_id is not null")
    parts = rows.groupBy("repo_id").agg(F.ceil(F.sum(F.octet_length("text")) / block_bytes).alias("blocks")).join(asked.groupBy("repo_id").agg(F.ceil(F.count("*") / block_questions).alias("shares")), "repo_id")
    parts = F.broadcast(parts.select("repo_id", F.greatest("blocks", F.lit(1)).alias("blocks"), "shares"))  # a row a repository
    block, share = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.pmod(F.xxhash64("question_id"), F.col("shares")).alias("share")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.select("repo_id", "id", "path", F.array_join(words(F.col("text")), " ").alias("words")).where("words != ''").join(parts, "repo_id").select("repo_id", block, every("shares").alias("share"), "id", "path", "words")
    right = asked.join(parts, "repo_id").select("repo_id", every("blocks").alias("block"), share, "question_id", "terms")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"question_id {kind(questions, 'question_id')}, id {kind(texts, 'id')}, path {kind(texts, 'path')}, score double"
    key = ["repo_id", "block", "share"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda t, q: postings.best(t, q, k), schema).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "id", "path")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
