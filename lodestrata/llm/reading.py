"""Reading level of each document (problem 8).

Documents and the words of their prose form a bipartite graph; a word node is a
word or a pair of neighbouring words, an edge weighs as often as it occurs.
Graded documents are clamped to their mean grade. Each harmonic iteration sets
every word to the weighted mean of its documents and every other document to
the weighted mean of its words. A word counts for more in a document's mean the
less its graded documents disagree, so that words found at every level say
little. The scores, which draw together as they spread, are then mapped to the
scale of the grades by isotonic regression on graded documents.

Code, tables, links, headings, lists of addresses and other markup are no prose.

How it runs: one Arrow pass turns each text into two short arrays of word hashes
and counts, written to the shared checkpoint folder. An iteration reads those
arrays, adds up per word inside each task and shuffles one row a word and task.
While the vocabulary is within :data:`BROADCAST_WORDS` (it is counted first) the
word scores go to the tasks as a broadcast of two arrays; beyond that a join on
the word replaces the broadcast, with the same result. Words are identified by
64-bit hashes. Iterations go on until the residual (:data:`TOLERANCE`) is reached; :func:`convergence` reports it.

Defined results:

- null or empty text, or fewer than :data:`MIN_WORDS` words of prose: level null, ``has_prose`` false.
- Prose of which a tenth or more is function words of another language, or less than :data:`ENGLISH_SHARE` function words of
  English (other scripts have none): level null, ``is_english`` false; it takes no part in the graph.
- Grades that are null or outside 1..5 are ignored; a grade repeated by the same rater counts once; raters are averaged.
- No grades at all: every level null. Repeated documents are nodes of their own; repeated doc_ids keep their rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut

#: Harmonic iterations go on until scores, in standard deviations, change by no more than this in the mean over all
#: occurrences of words, and stop in any case after so many.
TOLERANCE, MOST_ITERATIONS = 0.025, 12
#: Words of prose below which a text has hardly any.
MIN_WORDS = 8
#: How sharply words whose graded documents disagree lose weight.
SHARPNESS = 2.0
#: Occurrences by which a word starts at the mean grade before its own are counted.
PRIOR = 2.0
#: The variance of grades that a word has besides what is measured.
VARIANCE_FLOOR = 0.08
#: Word scores up to this many (24 bytes each, counted first) are broadcast; more are joined.
BROADCAST_WORDS = 2_000_000
#: Grades table up to this many documents (16 bytes each) is broadcast; more are joined.
BROADCAST_GRADES = 1_000_000
#: Graded documents that the mapping to the scale is fitted on at most, taken by hash.
CALIBRATION_ROWS = 100_000

_NOT_PROSE = re.compile(
    r"(?:[|#<=]|!\[|\*\*[\w.-]+\*\* (?:commented|wrote|replied)|\S+:\d+(?:-\d+)?:?$|[*+-]?\s*(?:https?://|www\.)\S+$|[0-9a-f]{7,40}\b|[-*_=~]{3,}$|"
    r"(?:feat|fix|chore|docs|refactor|test|perf|ci|build|style|revert)(?:\([\w./-]+\))?!?: |\[[^\]]*\]:\s|@@|diff |index [0-9a-f]|Traceback |File \"|>>> |\$ )"
)
_BULLET = re.compile(r"(?:[-*+>]|\d+[.)])\s+")
_SPAN = re.compile(r"\(see `[^`]*`\)|`[^`]*`")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_HTML = re.compile(r"<[^>\s][^>]*>")
_DOTTED = re.compile(r"\.\w")
_NO_WORD = re.compile(r"[/\\_@]|\w\.\w|\w\(\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*+")
# Frequent function words that English lacks, and those that English prose does not go without.
_FOREIGN = frozenset(
    "der die das und ist nicht mit ein eine einen den dem des für von auf werden wird el la los las una que con para por del est les dans pour sur une il lo gli di che della sono non são não uma os le".split()
)
_ENGLISH = frozenset("the of and to in is a that it for on with as are this be by an or not from you if when can which has its at have but was will each one all so no than".split())
#: Of the words of English prose at least this share is among the latter, and less than a tenth among the former.
ENGLISH_SHARE = 0.02


def prose(text: str) -> str:
    """The running text of a document, without code, tables, links, headings and other markup."""
    kept, fence = [], ""
    for raw in text.split("\n"):
        line = raw.strip()
        if fence:
            if line[:3] == fence:
                fence = ""
            continue
        if not line or line[0] in "|#<=":
            continue
        if line[:3] in ("```", "~~~"):
            fence = line[:3]
            continue
        # a line that begins like a sentence needs no closer look unless it holds a colon or a file's name
        if raw[:4] == "    " or raw[0] == "\t" or (":" in line or not line[0].isupper() or line[:4] == "File") and _NOT_PROSE.match(line):
            continue
        if line[0] in "-*+>0123456789" and (m := _BULLET.match(line)):
            line = line[m.end() :].strip()
            if not line or _NOT_PROSE.match(line):
                continue
        if "`" in line:
            line = _SPAN.sub(" ", line)
        if "](" in line:
            line = _LINK.sub(r" \1 ", _IMAGE.sub(" ", line))
        if "<" in line:
            line = _HTML.sub(" ", line)
        if "/" in line or "_" in line or "@" in line or "\\" in line or "()" in line or _DOTTED.search(line):
            line = " ".join([w for w in line.split() if not _NO_WORD.search(w)])
        kept.append(line)
    return "\n".join(kept)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        if len(self) > 500_000:  # only a cache
            self.clear()
        return value


def _has_english(found: list[str]) -> bool:
    """Whether at least :data:`ENGLISH_SHARE` of the words are function words of English; seen early in English prose."""
    left = math.ceil(ENGLISH_SHARE * len(found))
    for w in found:
        if left <= 0:
            break
        left -= w in _ENGLISH
    return left <= 0


def _graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _Hashes()
    for batch in batches:
        words_of, counts_of, n_words, english = [], [], [], []
        for text in batch.text:
            found = _WORD.findall(prose(text).lower()) if text else []
            foreign = 0 if _FOREIGN.isdisjoint(found) else sum(w in _FOREIGN for w in found)
            n_words.append(len(found))
            english.append(10 * foreign < max(len(found), 1) and _has_english(found))
            if len(found) >= MIN_WORDS and english[-1]:
                ids = np.array([hashes[w] for w in found], np.uint64)
                pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]
                every = np.sort(np.concatenate([ids, pairs ^ pairs >> np.uint64(29)]))
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                counts = np.empty(len(first), np.int32)
                counts[:-1], counts[-1] = first[1:] - first[:-1], len(every) - first[-1]
                words_of.append(every[first].view(np.int64))
                counts_of.append(counts)
            else:
                words_of.append(np.empty(0, np.int64))
                counts_of.append(np.empty(0, np.int32))
        yield pd.DataFrame({"doc_id": batch.doc_id, "grade": batch.grade, "n_words": n_words, "is_english": english, "words": words_of, "counts": counts_of})


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) of each edge in a batch of documents."""
    sizes = np.array([len(w) for w in batch.words])
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.repeat(np.arange(len(batch)), sizes), np.concatenate(batch.words.to_list()).astype(np.int64), np.concatenate(batch.counts.to_list()).astype(float)


class _Sums:
    """Sums per word within a task, given out whenever they fill up."""

    def __init__(self, most: int = 1_000_000):
        self.parts, self.size, self.most = [], 0, most

    def add(self, words: np.ndarray, *values: np.ndarray) -> pd.DataFrame | None:
        self.parts.append(self._summed(words, values))
        self.size += len(self.parts[-1][0])
        if len(self.parts) > 1 and self.size > self.most:
            self.parts = [self._summed(np.concatenate([p[0] for p in self.parts]), [np.concatenate(c) for c in zip(*[p[1] for p in self.parts], strict=True)])]
            self.size = len(self.parts[0][0])
            if self.size > self.most:
                return self.rest()
        return None

    @staticmethod
    def _summed(words: np.ndarray, values) -> tuple[np.ndarray, list[np.ndarray]]:
        nodes, at = np.unique(words, return_inverse=True)
        return nodes, [np.bincount(at, v, len(nodes)) for v in values]

    def rest(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        nodes, values = self._summed(np.concatenate([p[0] for p in self.parts]), [np.concatenate(c) for c in zip(*[p[1] for p in self.parts], strict=True)])
        self.parts, self.size = [], 0
        return pd.DataFrame({"word": nodes, **{f"s{k}": v for k, v in enumerate(values)}})


def _seed_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word: occurrences in graded documents, their grades and squared grades, and all occurrences."""
    sums = _Sums()
    for batch in batches:
        row, word, count = _flat(batch)
        grade = batch.grade.to_numpy(float)[row] if len(row) else np.empty(0)
        graded = np.where(np.isnan(grade), 0.0, count)
        grade = np.nan_to_num(grade)
        if (out := sums.add(word, graded, graded * grade, graded * grade**2, count)) is not None:
            yield out
    if (out := sums.rest()) is not None:
        yield out


def _means(n: int, row: np.ndarray, at: np.ndarray, count: np.ndarray, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted mean of the scores of each of n documents' words, which stand at ``at``; NaN without words."""
    w = count * weight[at]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(row, w * score[at], n) / np.bincount(row, w, n)


def _scores(batch: pd.DataFrame, nodes: np.ndarray, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted mean of the scores of each document's words; NaN without words."""
    row, word, count = _flat(batch)
    return _means(len(batch), row, np.searchsorted(nodes, word), count, score, weight)


def _step(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per word of the document scores, graded documents clamped; a task holds one sum for each word of the vocabulary."""
    nodes, score, weight = shared.value
    pulled = np.zeros(len(nodes))
    for batch in batches:
        row, word, count = _flat(batch)
        at = np.searchsorted(nodes, word)
        grade = batch.grade.to_numpy(float)
        of_doc = np.where(np.isnan(grade), _means(len(batch), row, at, count, score, weight), grade)
        pulled += np.bincount(at, count * of_doc[row], len(nodes))
    some = np.flatnonzero(pulled)  # grades are at least 1
    yield pd.DataFrame({"word": nodes[some], "s0": pulled[some]})


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the mean of each document's distinct raters."""
    valid = labels.where("level between 1 and 5 and doc_id is not null").groupBy("doc_id", "rater").agg(F.avg("level").alias("level"))
    return valid.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("level").alias("grade"))


def graph(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, n_words, is_english, words, counts): each document with its edges."""
    graded = grades(labels)
    n = graded.count()
    graded = F.broadcast(graded) if n <= BROADCAST_GRADES else graded
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(graded, "doc_id", "left").select("doc_id", "text", "grade")
    return rows.mapInPandas(_graph, "doc_id long, grade double, n_words int, is_english boolean, words array<long>, counts array<int>")


def _isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map from score to grade (pool adjacent violators): a block's two ends and its mean."""
    order = np.argsort(score, kind="stable")
    x, y = score[order], grade[order]
    blocks: list[list[float]] = []  # sum, count, first and last score
    for a, b in zip(x, y, strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ys


def _iterated(edges: DataFrame, tolerance: float, most: int, broadcast_words: int) -> tuple[DataFrame, list[float], bool] | None:
    """(words, residual of each iteration, whether the words are to be broadcast); None without any grade."""
    mean, spread_ = edges.where("grade is not null").agg(F.avg("grade"), F.var_pop("grade")).first()
    if mean is None:  # nothing to learn from
        return None
    sums = edges.mapInPandas(_seed_sums, "word long, s0 double, s1 double, s2 double, s3 double")
    sums = sums.groupBy("word").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    n = F.col("s0") + PRIOR
    score = (F.col("s1") + PRIOR * mean) / n
    variance = F.greatest((F.col("s2") + PRIOR * (mean**2 + spread_ + VARIANCE_FLOOR)) / n - score * score, F.lit(0.0))
    words = cut(sums.select("word", score.alias("score"), F.pow(variance + VARIANCE_FLOOR, F.lit(-SHARPNESS)).alias("weight"), F.col("s3").alias("count")))
    small, residuals = words.count() <= broadcast_words, []
    while len(residuals) < most and (not residuals or residuals[-1] > tolerance):
        if small:
            shared = _shared(words)
            pulled = edges.select("grade", "words", "counts").mapInPandas(lambda b, s=shared: _step(s, b), "word long, s0 double").groupBy("word").agg(F.sum("s0").alias("pulled"))
        else:
            pulled = _pulled_by_join(edges, words)
        both = cut(words.withColumnRenamed("score", "old").join(pulled, "word").select("word", ((F.col("pulled") + PRIOR * mean) / (F.col("count") + PRIOR)).alias("score"), "weight", "count", "old"))
        residuals.append(_residual(both))
        words = both.drop("old")
    return words, residuals, small


def _residual(words: DataFrame) -> float:
    """The mean change from ``old`` to ``score`` over all occurrences of words, both in standard deviations from their mean."""
    n = F.sum("count")
    moments = words.agg(*[m for c in ("old", "score") for m in ((F.sum(F.col("count") * F.col(c)) / n).alias(c), (F.sum(F.col("count") * F.col(c) * F.col(c)) / n).alias(f"{c}2"))]).first()
    z = lambda c: (F.col(c) - moments[c]) / max(moments[f"{c}2"] - moments[c] ** 2, 1e-12) ** 0.5
    return words.agg((F.sum(F.col("count") * F.abs(z("score") - z("old"))) / n).alias("residual")).first()[0]


def convergence(documents: DataFrame, labels: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS) -> DataFrame:
    """(iteration, residual) of the harmonic iterations; no row without any grade."""
    out = _iterated(cut(graph(documents, labels)).where(F.size("words") > 0), tolerance, most, BROADCAST_WORDS)
    return documents.sparkSession.createDataFrame([(k, float(r)) for k, r in enumerate(out[1] if out else [], 1)], "iteration int, residual double")


def reading_levels(documents: DataFrame, labels: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, n_words, has_prose, is_english, grade, score, free_level, reading_level, level) of every document.

    ``reading_level`` is continuous: the grade of a graded document with prose, which stays clamped, and ``free_level`` of any
    other. ``free_level`` is what a document's words say, its own grade aside from its share in theirs; ``level`` is the nearest
    whole grade to ``reading_level``.
    """
    docs = cut(graph(documents, labels))
    iterated = _iterated(docs.where(F.size("words") > 0), tolerance, most, broadcast_words)
    if iterated is None:
        none = F.lit(None)
        return docs.select(
            "doc_id", "n_words", (F.col("n_words") >= MIN_WORDS).alias("has_prose"), "is_english", "grade",
            *[none.cast("double").alias(c) for c in ("score", "free_level", "reading_level")], none.cast("int").alias("level"),
        )
    words, _, small = iterated
    if small:
        shared = _shared(words)

        def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.drop(columns=["words", "counts"]).assign(score=_scores(batch, *shared.value))

        scored = docs.mapInPandas(final, "doc_id long, grade double, n_words int, is_english boolean, score double")
    else:
        scored = _scored_by_join(docs.withColumn("row", F.monotonically_increasing_id()), words).select("doc_id", "grade", "n_words", "is_english", "score")
    scored = scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    sample = scored.where("grade is not null and score is not null").select("score", "grade", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(CALIBRATION_ROWS).toPandas()
    xs, ys = _isotonic(sample.score.to_numpy(), sample.grade.to_numpy())

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(free_level=np.interp(batch.score.to_numpy(float), xs, ys))

    out = scored.mapInPandas(mapped, "doc_id long, grade double, n_words int, is_english boolean, score double, free_level double")
    out = out.withColumn("free_level", F.when(F.col("score").isNotNull(), F.col("free_level")))
    out = out.withColumn("reading_level", F.when(F.col("score").isNotNull(), F.coalesce("grade", "free_level")))
    return out.select("doc_id", "n_words", (F.col("n_words") >= MIN_WORDS).alias("has_prose"), "is_english", "grade", "score", "free_level", "reading_level", F.round("reading_level").cast("int").alias("level"))


def _shared(words: DataFrame):
    """The word scores as a broadcast; only for a vocabulary within the bound."""
    table = words.select("word", "score", "weight").toPandas().sort_values("word")
    return words.sparkSession.sparkContext.broadcast((table.word.to_numpy(), table.score.to_numpy(), table.weight.to_numpy()))


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("row", "grade", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n")))).select("row", "grade", F.col("word").cast("long").alias("word"), F.col("n").cast("double").alias("n"))


def _scored_by_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    edges = _exploded(docs.where(F.size("words") > 0)).join(words.select("word", "score", "weight"), "word")
    means = edges.groupBy("row").agg((F.sum(F.col("n") * F.col("weight") * F.col("score")) / F.sum(F.col("n") * F.col("weight"))).alias("score"))
    return docs.join(means, "row", "left")


def _pulled_by_join(edges: DataFrame, words: DataFrame) -> DataFrame:
    docs = edges.withColumn("row", F.monotonically_increasing_id())
    scored = _scored_by_join(docs, words).withColumn("score", F.coalesce("grade", "score"))
    return _exploded_scores(scored).groupBy("word").agg(F.sum(F.col("n") * F.col("score")).alias("pulled"))


def _exploded_scores(scored: DataFrame) -> DataFrame:
    pairs = F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n")))
    return scored.select("score", pairs).select("score", F.col("word").cast("long").alias("word"), F.col("n").cast("double").alias("n"))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose English prose is at level 5.

    Raters differ by one at times, so a graded document too is judged by what its words say, ``free_level``.
    """
    return reading_levels(documents, labels).where("round(free_level) = 5 and is_english and has_prose").select("doc_id")
