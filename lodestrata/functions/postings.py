"""The best texts for many lists of words at once, within one block of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of a question and a text that are held at once; a single question may have as many as there are texts in its block.
PAIRS = 1 << 20


def best(texts: pa.Table, asked: pa.Table, k: int, pairs: int = PAIRS) -> pa.Table:
    """(question_id, id, path, score): the k best of texts (id, path, words) for every question (question_id, terms) all of whose terms they hold.

    ``words`` are parted by blanks; rows of one id and path are one text. Each question takes the texts of its rarest term
    and looks its other terms up among their words, so that a term that many texts hold is not joined with them.
    """
    texts = texts.take(pc.sort_indices(texts, sort_keys=[("id", "ascending"), ("path", "ascending")], null_placement="at_start")).combine_chunks()
    asked = asked.combine_chunks()
    at, of, scores = _found(*_numbered(texts, asked), k, pairs) if len(texts) and len(asked) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    at, of = pa.array(at), pa.array(of)
    return pa.table([asked["question_id"].take(at), texts["id"].take(of), texts["path"].take(of), pa.array(scores, pa.float64())], ["question_id", "id", "path", "score"])


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and the row of each."""
    column = column.combine_chunks()
    return column.flatten(), np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))


def _numbered(texts: pa.Table, asked: pa.Table) -> tuple:
    """First row of each text; texts and counts of each word in one array with its bounds; the terms of all questions by number, and the question of each."""
    new = np.concatenate([[True], (np.diff(_codes(texts["id"])) != 0) | (np.diff(_codes(texts["path"])) != 0)])
    text = np.cumsum(new) - 1
    terms, question = _lists(asked["terms"])
    known = pc.unique(terms)
    words, row = _lists(pc.split_pattern(texts["words"], " "))
    number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, tf = np.unique(number[number >= 0] * (text[-1] + 1) + text[row[number >= 0]], return_counts=True)
    return np.flatnonzero(new), keys, tf / (tf + 1), pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64), question, len(asked), len(known)


def _found(first: np.ndarray, keys: np.ndarray, weight: np.ndarray, terms: np.ndarray, question: np.ndarray, n_questions: int, n_words: int, k: int, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row of the text, score) of the k best of every question; keys are word * texts + text."""
    n = len(first)
    bounds = np.searchsorted(keys, np.arange(n_words + 1) * n)
    held = np.diff(bounds)
    order = np.lexsort((held[terms], question))  # the rarest term of each question comes first
    terms, size = terms[order], np.bincount(question, minlength=n_questions)
    begins = np.cumsum(size) - size
    some = np.flatnonzero(size)
    some = some[held[terms[begins[some]]] > 0]
    many = held[terms[begins[some]]]
    out = []
    for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(many) // pairs)) + 1):
        q = np.repeat(some[part], many[part])
        ends = np.cumsum(many[part])
        at = np.arange(len(q)) + np.repeat(bounds[terms[begins[some[part]]]] - ends + many[part], many[part])
        text, score = keys[at] % n, weight[at]
        for j in range(1, int(size[some[part]].max(initial=1))):
            more = size[q] > j
            wanted = terms[np.where(more, begins[q] + j, 0)] * n + text
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            holds = keys[at] == wanted
            keep = holds | ~more
            q, text, score = q[keep], text[keep], (score + np.where(more, weight[at], 0.0))[keep]
        by = np.lexsort((text, -np.floor(score * 1e9 + 0.5), q))
        q, text, score = q[by], text[by], score[by]
        begun = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(begun, np.diff(np.append(begun, len(q)))) < k
        out.append((q[keep], first[text[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
