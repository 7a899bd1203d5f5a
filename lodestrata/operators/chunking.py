"""Source files cut into symbol-aligned chunks.

Each top-level function and class is a chunk; statements between them form
module chunks, and a run of nothing but imports has none. A class over the
budget becomes a header chunk and one chunk a member, a function over it pieces
that each begin with its signature. A file most of whose top-level statements
do not parse is one module chunk without imports.

Python statements are found by ``ast``, each for itself where the file as a
whole does not parse; TypeScript ones by brackets outside strings and comments.
A file is one row in and its chunks are rows out: no shuffle.

Defined results: null content, null path or another suffix: no chunk. Empty
file: no chunk. Repeated rows: chunks for each. Lines are those between \\n.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import language

MAX_CHARS = 6000
#: Lines of a signature repeated on each piece of a long function.
SIGNATURE_LINES = 8
CHUNKS = "file_id long, repo_id long, sha string, path string, language string, symbol_name string, symbol_kind string, parent_symbol string, start_line int, end_line int, imports array<string>, content string"

_TOKENS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[(,=:\[!&|?;])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|[()\[\]{}]|;|\n""", re.DOTALL)
_UNIT = re.compile(
    r"(?:@[^\n]*\n)*\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?P<k>function|class)\s*\*?\s*(?P<n>[\w$]+)|"
    r"(?:const|let|var)\s+(?P<a>[\w$]+)[^=\n]*=\s*(?:\w+\()*(?:async\s*)?(?:function\b|\([^)]*\)[^=\n]*=>|[\w$]+\s*=>|<))"
)
_MEMBER = re.compile(r"\s*(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?\s*(?P<n>#?[\w$]+)\s*(?:<[^>]*>)?\s*\(")
_TS_IMPORT = re.compile(r"""^\s*(?:import|export)\b[^;'"]*?(?:from\s*)?['"]([^'"]+)['"]""", re.MULTILINE)


class Unit(NamedTuple):
    """A stretch of whole lines, first to last from 1, and what it defines."""

    first: int
    last: int
    kind: str  # function, class, import, broken or other
    name: str | None
    members: tuple = ()
    head: int = 0  # last line of the signature
    statements: tuple = ()  # first lines of the statements of a function's body


def _python_units(text: str) -> list[Unit]:
    lines = text.split("\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return [_python_unit(n, 0) for n in ast.parse(text).body]
        except (SyntaxError, ValueError, RecursionError):
            pass
        starts = [i for i, x in enumerate(lines) if x[:1] not in ("", " ", "\t", "#", ")", "]", "}", "\r")]
        units = []
        for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
            part = "\n".join(lines[a:b])
            try:
                units += [_python_unit(n, a) for n in ast.parse(part).body]
            except (SyntaxError, ValueError, RecursionError):
                if part.startswith("@") and units and units[-1].kind == "broken":
                    continue
                units.append(Unit(a + 1, a + len(part.rstrip().split("\n")), "broken", None))
        return units


def _python_unit(node: ast.stmt, shift: int) -> Unit:
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    kind, members, head, statements = "other", (), 0, ()
    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        statements = tuple(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) + shift for n in node.body)
        kind, head = "function", node.body[0].lineno - 1 if node.body[0].lineno > node.lineno else node.lineno
    elif isinstance(node, ast.ClassDef):
        kind = "class"
        members = tuple(_python_unit(n, shift) for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))
    elif isinstance(node, ast.Import | ast.ImportFrom):
        kind = "import"
    return Unit(first + shift, node.end_lineno + shift, kind, getattr(node, "name", None), members, head + shift, statements)


def _typescript_units(text: str, first: int = 1, member: bool = False) -> list[Unit]:
    units, depth, begun, line, opened = [], 0, None, first, 0
    at = 0

    def close(end: int) -> None:
        nonlocal begun
        if begun is not None:
            units.append(_typescript_unit(text[begun[0] : end], begun[1], line, member, opened))
        begun = None

    for m in _TOKENS.finditer(text):
        if begun is None and text[at : m.start()].strip():
            lead = len(text[at : m.start()]) - len(text[at : m.start()].lstrip())
            begun, opened = (at + lead, line), 0
        t = m.group()
        if t in "([{":
            if begun is None:
                begun, opened = (m.start(), line), 0
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
            if depth == 0 and t == "}" and re.match(r"\s*(?:\n|$|//)", text[m.end() :]) and not re.match(r"\s*(?:else|catch|finally|while)\b", text[m.end() :]):
                close(m.end())
        elif t == ";" and depth == 0:
            close(m.end())
        elif t == "\n" and depth == 0 and begun is not None and not re.match(r"\s*(?:[.?:=+\-*/&|,)\]}<>]|\{|else|catch|finally|extends|implements|from)", text[m.end() :]) and not re.search(r"(?:[=+\-*/&|,(<>?:.]|=>|extends|implements|\bfrom)\s*$", text[begun[0] : m.start()]):
            if not text[begun[0]] == "@":
                close(m.start())
        if t in ("{", "(") and depth == 1 and not opened:
            opened = line
        line += t.count("\n")
        at = m.end()
    if begun is None and text[at:].strip():
        begun = (at, line)
    close(len(text))
    return units


def _typescript_unit(text: str, first: int, last: int, member: bool, head: int) -> Unit:
    if member:
        m = _MEMBER.match(text)
        return Unit(first, last, "function" if m and "{" in text else "other", m.group("n") if m else None, (), head)
    m = _UNIT.match(text)
    if not m:
        return Unit(first, last, "import" if re.match(r"\s*(?:import\b|export\s+(?:\*|\{)[^;]*from\b)", text) else "other", None)
    kind = m.group("k") if m.group("k") == "class" else "function"
    members = ()
    if kind == "class" and "{" in text:
        body = text.index("{", m.end("n"))
        members = tuple(u for u in _typescript_units(text[body + 1 : text.rindex("}") if "}" in text[body:] else len(text)], first + text.count("\n", 0, body + 1), True) if u.kind == "function")
    return Unit(first, last, kind, m.group("n") or m.group("a"), members, head)


def python_imports(text: str) -> list[str]:
    """Modules that a Python text imports, in order; of ``from`` imports the module only."""
    found = re.findall(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import|import[ \t]+([\w. ,]+))", text, re.MULTILINE)
    names = [a or x.split()[0] for a, b in found for x in (b.split(",") if b else [a]) if (a or x).strip()]
    return list(dict.fromkeys(names))


def _packed(lines: list[str], first: int, last: int, budget: int, starts: tuple = ()) -> Iterator[tuple[int, int]]:
    """Runs of lines first..last that each stay within a budget where single lines allow it.

    With ``starts``, the lines on which statements begin, a run ends before one of them unless one statement alone is over the budget.
    """
    begins = sorted({first, *(s for s in starts if first < s <= last)}) if starts else range(first, last + 1)
    width = lambda a, b: sum(len(x) + 1 for x in lines[a - 1 : b])
    start, size = first, 0
    for a, b in zip(begins, [*(s - 1 for s in begins[1:]), last], strict=True):
        wide = width(a, b)
        if size and size + wide > budget:
            yield start, a - 1
            start, size = a, 0
        if wide > budget and b > a:
            *pieces, (start, _) = _packed(lines, start, b, budget)
            yield from pieces
            wide = width(start, b) - size
        size += wide
    yield start, last


def _statements(text: str, u: Unit) -> tuple:
    """First lines of the statements in the body of a TypeScript function."""
    lines = text.split("\n")
    body = "\n".join(lines[u.first - 1 : u.last])
    at = body.find("{", sum(len(x) + 1 for x in lines[u.first - 1 : max(u.head, u.first) - 1]))
    if at < 0 or "}" not in body[at:]:
        return ()
    return tuple(s.first for s in _typescript_units(body[at + 1 : body.rindex("}")], u.first + body.count("\n", 0, at + 1)))


def cut(text: str, lang: str, max_chars: int = MAX_CHARS) -> list[tuple]:
    """(name, kind, parent, first line, last line, content) of each chunk of a file."""
    if not text.strip():
        return []
    lines = text.split("\n")
    units = _python_units(text) if lang == "python" else _typescript_units(text)
    out: list[tuple] = []

    def emit(first: int, last: int, kind: str, name: str | None, parent: str | None = None, signature: str = "") -> None:
        body = "\n".join(lines[first - 1 : last])
        if body.strip():
            out.append((name, kind, parent, first, last, f"{signature}\n{body}" if signature else body))

    def function(u: Unit, kind: str, parent: str | None) -> None:
        if len("\n".join(lines[u.first - 1 : u.last])) <= max_chars:
            emit(u.first, u.last, kind, u.name, parent)
            return
        head = lines[u.first - 1 : min(max(u.head, u.first), u.first + SIGNATURE_LINES - 1)]
        signature = "\n".join([*head, "..."] if u.head - u.first >= SIGNATURE_LINES else head)
        room = max(max_chars - len(signature) - 1, max_chars // 4)
        for k, (a, b) in enumerate(_packed(lines, u.first, u.last, room, u.statements or (_statements(text, u) if lang != "python" else ()))):
            emit(a, b, kind, u.name, parent, signature if k else "")

    def klass(u: Unit, parent: str | None) -> None:
        if len("\n".join(lines[u.first - 1 : u.last])) <= max_chars or not u.members:
            function(u, "class", parent)
            return
        for a, b in _packed(lines, u.first, u.members[0].first - 1, max_chars) if u.members[0].first > u.first else ():
            emit(a, b, "class", u.name, parent)
        for m in u.members:
            klass(m, u.name) if m.kind == "class" else function(m, "method", u.name)

    if not units or 2 * sum(u.kind == "broken" for u in units) > len(units):
        for a, b in _packed(lines, 1, len(lines) - (lines[-1] == ""), max_chars):
            emit(a, b, "module", None)
        return out
    run: list[Unit] = []

    def module() -> None:
        if any(u.kind != "import" for u in run):
            for a, b in _packed(lines, run[0].first, run[-1].last, max_chars):
                emit(a, b, "module", None)
        run.clear()

    for u in units:
        if u.kind in ("function", "class"):
            module()
            klass(u, None) if u.kind == "class" else function(u, "function", None)
        else:
            run.append(u)
    module()
    return out


def symbols_of(text: str, lang: str) -> list[tuple]:
    """(name, kind, parent, line of the name) of every function, class and member."""
    lines, out = text.split("\n"), []

    def add(u: Unit, kind: str, parent: str | None) -> None:
        place = next((n for n in range(u.first, u.last + 1) if re.search(rf"(?<![\w$@.]){re.escape(u.name)}(?![\w$])", lines[n - 1]) and not lines[n - 1].lstrip().startswith("@")), u.first)
        out.append((u.name, kind, parent, place))
        for m in u.members:
            add(m, "class" if m.kind == "class" else "method", u.name)

    for u in _python_units(text) if lang == "python" else _typescript_units(text):
        if u.kind in ("function", "class") and u.name:
            add(u, u.kind, None)
    return out


def chunk_files(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The chunks of every source file (id, repo_id, sha, path, content); columns as in :data:`CHUNKS`."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                chunks = cut(r.content, r.language, max_chars)
                whole = len(chunks) > 0 and all(c[1] == "module" for c in chunks) and chunks[0][3] == 1
                imports = [] if whole else python_imports(r.content) if r.language == "python" else list(dict.fromkeys(_TS_IMPORT.findall(r.content)))
                out += [(r.file_id, r.repo_id, r.sha, r.path, r.language, name, kind, parent, a, b, imports, body) for name, kind, parent, a, b, body in chunks]
            yield pd.DataFrame(out, columns=names)

    rows = files.select(F.col("id").alias("file_id"), "repo_id", "sha", "path", language(F.col("path")).alias("language"), "content").where("language is not null and content is not null")
    return rows.mapInPandas(run, CHUNKS)


def extract_symbols(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, sha, path, name, kind, parent_symbol, line) of every symbol of every source file."""
    schema = "file_id long, repo_id long, sha string, path string, name string, kind string, parent_symbol string, line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.file_id, r.repo_id, r.sha, r.path, *s) for r in batch.itertuples(index=False) for s in symbols_of(r.content, r.language)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    rows = files.select(F.col("id").alias("file_id"), "repo_id", "sha", "path", language(F.col("path")).alias("language"), "content").where("language is not null and content is not null")
    return rows.mapInPandas(run, schema)
