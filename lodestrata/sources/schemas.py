"""Schemas of the index tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


FILES = _schema(id=_LONG, repo_id=_LONG, sha=_TEXT, path=_TEXT, content=_TEXT, git_log=_TEXT)
CHUNKS = _schema(
    id=_LONG, repo_id=_LONG, sha=_TEXT, path=_TEXT, language=_TEXT, symbol_name=_TEXT, symbol_kind=_TEXT, start_line=_INT, end_line=_INT,
    parent_symbol=_TEXT, imports=T.ArrayType(_TEXT), content=_TEXT,
)
SYMBOLS = _schema(id=_LONG, repo_id=_LONG, sha=_TEXT, name=_TEXT, kind=_TEXT, path=_TEXT, line=_INT, parent_symbol=_TEXT)
REPOS = _schema(id=_LONG, owner=_TEXT, name=_TEXT, default_branch=_TEXT, stars=_INT, last_indexed_sha=_TEXT, status=_TEXT)
EVENTS = _schema(event_id=_LONG, ts=T.TimestampNTZType(), user_id=_LONG, event_type=_TEXT, value=T.DoubleType(), props=_TEXT)
