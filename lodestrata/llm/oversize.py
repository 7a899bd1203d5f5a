"""Splitting oversized chunks at natural boundaries (problem 4).

A chunk longer than the limit of its kind is cut by a hierarchy of separators:
section (a blank line before a line at the chunk's base indentation),
paragraph (blank line), line, sentence, word, character. Segments are packed
greedily into pieces; a segment that does not fit into an empty piece is cut at
the next finer separator. Every piece starts with the last ``overlap_lines``
lines of the piece before it.

Only oversized rows leave the JVM: length, limit and filter are plain columns.
The cutting of one chunk needs nothing but that chunk, so there is no shuffle.

Defined results:

- ``content``, ``symbol_kind`` or limit null, limit below 1, or a kind without a limit: not oversized, no pieces.
- Several limits for one kind: the smallest ``max_chars`` and its largest ``overlap_lines``.
- ``start_line`` null: counted from 1.
- A repeated chunk row is split again under its own id.
- Overlap lines are left out, oldest first, only where they would leave less than an eighth of the limit for what is new; a
  last line that is itself too long lends its final eighth of a limit. ``short_overlap`` marks such pieces. So a piece never
  exceeds the limit and always moves on.
- Joining the pieces' bodies (``content`` without its first ``overlap_chars`` characters) gives the chunk's content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = (
    "chunk_id long, piece_no int, symbol_kind string, start_line int, body_line int, end_line int, "
    "boundary string, overlap_chars int, short_overlap boolean, content string"
)

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?]\s+|[;}]\s*")
_WORD = re.compile(r"\s+")
_FINER = {1: _PARAGRAPH, 2: _LINE, 3: _SENTENCE, 4: _WORD}


def _section(text: str) -> re.Pattern:
    """A blank line before a line that is indented as little as the chunk's first line."""
    indent = re.match(r"[ \t]*", text.lstrip("\r\n")).group().replace("\t", r"\t")
    return re.compile(r"\n[ \t\r]*\n(?=" + indent + r"[^\s})\]])")


def cut_text(text: str, limit: int, overlap_lines: int) -> list[tuple[int, int, int, str]]:
    """(start with overlap, start of body, end, kind of boundary at the end) of each piece of text."""
    section = _section(text)
    todo = [(0, len(text), 0, "end")]  # segments still to place, the next one last; with the level to cut at and what ends them
    pieces: list[tuple[int, int, int, str]] = []
    start = body = end = 0  # the open piece is text[start:end], its body text[body:end]
    ended_by = "end"
    while todo:
        a, b, level, by = todo.pop()
        if b - start <= limit:
            end, ended_by = b, by
        elif end > body and (level == 5 or b - (fresh := _overlap(text, start, end, limit, overlap_lines)) <= limit):
            pieces.append((start, body, end, ended_by))
            start, body = _overlap(text, start, end, limit, overlap_lines) if level == 5 else fresh, end
            todo.append((a, b, level, by))
        elif level == 5:
            at = start + limit
            if at - 1 > a and text[at - 1] == "\r" and text[at] == "\n":
                at -= 1
            todo.append((at, b, 5, by))
            end, ended_by = at, LEVELS[5]
        else:
            found = (section if level == 0 else _FINER[level]).finditer(text, a, b)
            cuts = [m.end() for m in found if a < m.end() < b]
            kinds = [LEVELS[level]] * len(cuts) + [by]
            todo.extend(reversed([(x, y, level + 1, k) for x, y, k in zip([a, *cuts], [*cuts, b], kinds, strict=True)]))
    if end > body or not pieces:
        pieces.append((start, body, end, ended_by))
    return pieces


def _overlap(text: str, start: int, end: int, limit: int, lines: int) -> int:
    """Where the overlap that follows a piece text[start:end] begins."""
    room, at = limit - max(1, limit // 8), end
    for k in range(lines):
        line = text.rfind("\n", start, at - 1) + 1 if at > start else start
        line = max(line, start)
        if end - line > room:
            return max(start, end - limit // 8) if k == 0 else at
        at = line
        if at == start:
            break
    return at


def _short(text: str, previous: int, start: int, body: int, lines: int) -> bool:
    """Whether text[start:body] lacks some of the last so many lines of text[previous:body]."""
    at = body
    for _ in range(lines):
        at = max(text.rfind("\n", previous, max(at - 1, previous)) + 1, previous) if at > previous else previous
    return start > at


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in batches:
        out = []
        for i, kind, first, text, limit, lines in zip(batch.chunk_id, batch.symbol_kind, batch.first_line, batch.content, batch.max_chars, batch.overlap_lines, strict=True):
            seen, at, previous = 0, 0, 0  # line ends up to the last body start, and where the piece before began
            for n, (start, body, end, boundary) in enumerate(cut_text(text, int(limit), int(lines)), 1):
                seen, at = seen + text.count("\n", at, body), body
                top = first + seen - text.count("\n", start, body)
                last = first + seen + text.count("\n", body, end) - (text[end - 1] == "\n")
                out.append((i, n, kind, top, first + seen, max(last, top), boundary, body - start, n > 1 and _short(text, previous, start, body, int(lines)), text[start:end]))
                previous = start
        yield pd.DataFrame(out, columns=names)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks over the limit of their kind, with ``max_chars`` and ``overlap_lines``."""
    per_kind = (
        limits.where("symbol_kind is not null and max_chars >= 1")
        .groupBy("symbol_kind")
        .agg(F.min(F.struct("max_chars", -F.greatest(F.coalesce("overlap_lines", F.lit(0)), F.lit(0)))).alias("m"))
        .select("symbol_kind", F.col("m.max_chars").alias("max_chars"), (-F.col("m.col2")).alias("overlap_lines"))
    )
    rows = chunks.select(
        F.col("id").cast("long").alias("chunk_id"), "symbol_kind", F.coalesce("start_line", F.lit(1)).alias("first_line"), "content"
    )
    return rows.join(per_kind, "symbol_kind").where(F.length("content") > F.col("max_chars"))


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of all oversized chunks (see the module's description), columns as in :data:`PIECES`."""
    return oversized(chunks, limits).mapInPandas(_pieces, PIECES)
