"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE vocabulary. A parameter of every operator that counts tokens; never copied here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's published pre-tokenizer splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BREAK = re.compile(r"\r?\n[ \t]*\r?\n")


@cache
def encoding(path: str):
    """The tokenizer at path, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def prompt_length(text: str) -> int:
    """Characters of the part that asks: the first paragraph with the break after it; 0 for a text of one paragraph."""
    m = _BREAK.search(text)
    return m.end() if m and text[m.end() :].strip() else 0


def source_key(source: Column) -> Column:
    """One spelling for all spellings of a source; null stays null."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, loss_tokens) of every row, empty and null texts with 0.

    The first paragraph counts as the prompt of an instruction example; the
    tokens after it bear loss. A text of one paragraph bears loss as a whole.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.text]
            cuts = [prompt_length(t) for t in texts]
            asked = [len(encode.encode_ordinary(t[:c])) if c else 0 for t, c in zip(texts, cuts, strict=True)]
            told = [len(encode.encode_ordinary(t[c:])) for t, c in zip(texts, cuts, strict=True)]
            yield pd.DataFrame({"doc_id": batch.doc_id, "source": batch.source, "n_tokens": [a + b for a, b in zip(asked, told, strict=True)], "loss_tokens": told})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(count, "doc_id long, source string, n_tokens long, loss_tokens long")
