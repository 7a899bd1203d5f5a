"""Functions paired with their documentation (problem 1).

Three steps:

1. :func:`symbols` reads every function, method and class chunk once and emits a
   symbol table across files: qualified name, normalised signature, place, code
   and the chunk's own documentation, a docstring or the comment directly above.
2. :func:`offers` makes the table of documentation that stands apart from its
   definition: a comment that ends a "module" chunk on the line before the
   definition, and documented declarations without a body (overload signatures,
   stubs, declaration files). Plain column predicates find the few chunks that
   can hold such, so only those are read again, once.
3. :func:`pair` joins definitions without documentation of their own to that
   table, by place or by qualified name: first among the declarations of the
   definition's own module (with its stub or declaration file), the one of the
   same normalised signature, else of as many parameters, else any; then among
   the declarations of all other files of the repository at that commit, of the
   same signature, else of as many parameters, if they agree on one text. Only
   then are pairs with empty or trivial documentation dropped.

The code text never takes part in a shuffle of :func:`pair` unless it is asked
for. Definitions that need no join carry a key of their own, so they spread
evenly; a hot file or a group of copies is split by the skew handling of
adaptive execution, as the other side holds one row a key.

Defined results:

- null or empty content, or a kind other than function, method, class and module: nothing.
- null path: the language column decides; neither known: nothing. Null repo_id, sha or start_line: no join, own documentation only.
- A repeated chunk row gives its pairs again under its own id; one name twice in a chunk gives one row in :func:`found`.
- Several module comments or declarations of one module for one key: the alphabetically first text. Declarations in other
  files that say different things for one key: none of them.
- Functions inside functions and the documentation of classes are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import cut, language_of, small

SYMBOLS = (
    "chunk_id long, repo_id long, sha string, path string, module string, qualified string, symbol_name string, "
    "signature string, arity int, top_line int, doc string, origin string, has_body boolean, code string"
)
_COLUMNS = [x.split()[0] for x in SYMBOLS.split(", ")]

_PY = re.compile(
    r"""\#[^\n]*|\"{3}[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*(?:\"{3}|\Z)|'{3}[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*(?:'{3}|\Z)|"""
    r""""[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'""",
    re.DOTALL,
)
_TS = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`|"""
    r"""(?<=[(,=:\[!&|?;])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:\\.|[^\]\\\n])*\])+/[a-z]*""",
    re.DOTALL,
)
_PY_DEF = re.compile(r"^(?P<in>[ \t]*)(?:(?P<class>class)|(?:async[ \t]+)?def)[ \t]+(?P<name>\w+)", re.MULTILINE)
_PY_DECORATOR = re.compile(r"^[ \t]*@[\w.]+(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?[ \t]*\r?\n", re.MULTILINE)
_PY_DOC = re.compile(r'''(?:\s|\#[^\n]*\n)*(?P<p>[A-Za-z]{0,2})(?P<q>"""|\'\'\'|"|')(?P<t>[^\\"']*(?:(?:\\.|(?!(?P=q))["'])[^\\"']*)*)(?P=q)[ \t]*(?=$|[\r\n#;])''', re.DOTALL)
_TS_DECORATOR = re.compile(r"^[ \t]*@[\w.]+(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?[ \t]*\r?\n", re.MULTILINE)
_TS_FUNCTION = re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<name>[\w$]+)", re.MULTILINE)
_TS_ARROW = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:const|let|var)[ \t]+(?P<name>[\w$]+)[ \t]*(?::[^=\n]+?(?:=>[^=\n]+)?)?=[ \t\r\n]*(?:\w+\()*(?:async\b[ \t]*)?"
    r"(?:function\b|<[^>\n]*>[ \t]*\(|\(|[\w$]+[ \t]*=>)",
    re.MULTILINE,
)
_TS_CLASS = re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:class|interface)[ \t]+(?P<name>[\w$]+)", re.MULTILINE)
_TS_METHOD = re.compile(
    r"^[ \t]*(?:(?:public|private|protected|static|override|readonly|abstract|declare|accessor)[ \t]+)*(?:async[ \t]+)?(?:(?:get|set)[ \t]+)?\*?[ \t]*(?P<name>\#?[\w$]+)[ \t]*\??"
    r"(?:<[^>\n]*>)?[ \t]*(?P<how>\(|=[ \t]*(?:async\b[ \t]*)?(?:\(|[\w$]+[ \t]*=>))",
    re.MULTILINE,
)
_NOT_METHODS = frozenset({"if", "for", "while", "switch", "catch", "return", "function", "with", "constructor_"})
_BLANK = re.compile(r"[^\n]")

# Instructions to tools; a line that starts so documents nothing.
_DIRECTIVE = re.compile(
    r"(?i)^(?:eslint|prettier|tslint|jshint|jslint|stylelint|biome|deno-|istanbul|c8|v8 ignore|nyc|@ts-|ts-|noqa|type:\s*ignore|pylint|flake8|fmt:|isort|mypy|pyright|"
    r"pragma|\#?region|\#?endregion|yapf|ruff|nosec|nosonar|noinspection|webpack|@jsx|@vite|cspell|spell-?checker|coverage|black:|-\*-|!/|globals?\s|exported\s|sourcemappingurl|"
    r"<reference|@__pure__|\#__pure__|@preserve|@license|codegen|vim:|\$\w+\$)"
)
# Texts that stand where documentation is still to be written.
_FILLER = re.compile(
    r"(?i)^\W*(?:todo|fixme|wip|tbd|tba|xxx+|hack|n/?a|none|null|undocumented|docstring|doc|docs|documentation|description|desc|summary|_summary_|\[summary\]|_description_|"
    r"placeholder|no (?:description|documentation|docs?)(?: (?:yet|given|available|provided))?|see above|see below|same as above|ditto|missing[ \w]*documentation comment[ \w.]*|"
    r"lorem ipsum.*|fill (?:me )?in|to be (?:done|written|documented)|needs? (?:docs?|documentation)|document me|write (?:me|docs))\W*$|^\W*(?:todo|fixme|xxx|hack)\b"
)
_TAG = re.compile(r"^[@:\\](?P<tag>\w+):?(?P<rest>.*)$")
_SECTION = re.compile(r"(?i)^(?:args?|arguments|params?|parameters|returns?|raises|throws|yields?|attributes|examples?|notes?|see also|kwargs|keyword arguments)\s*:?\s*$")
_ITEM = re.compile(r"^\*{0,2}[\w$.]+(?:\s*\([^)]*\))?\s*:\s*(?P<rest>.*)$")
_CODE = re.compile(
    r"[;{}]\s*$|^[\w$.\[\]\"']+\s*(?:=|\+=|-=|:=)\s*\S|^(?:await\s+|return\s+|yield\s+|new\s+)?[\w$.]+\([^)]*\)[;,:]?\s*$|^(?:import|from)\s+[\w.{*]+.*(?:import|['\";])|"
    r"^(?:if|elif|for|while|with|try|except|else|def|class)\b.*:\s*$|^(?:return|pass|break|continue)(?:\s+[\w$.\[\]()]+)?$|^(?:const|let|var)\s+\w+\s*=|^@\w+\(.*\)$|^</?\w+[^>]*>$|^\)|^[\])}]"
)
_STOP = frozenset(
    "a an and are as at be by do does for from function functions helper implementation in is it its method methods of on or our routine that the their these this to we which will with".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_NOTE = re.compile(r"(?i)\b(?:login|works|key|password|secret|token)\b.*(?::|->|\bis)\s+\S*\d\S*\s*$|_(?:pw|pass|auth|secret|key|token|password) is \S+$")


def name_words(name: str) -> set[str]:
    """Lower-case words of a snake_case or camelCase name."""
    return {w.lower() for part in _CAMEL.split(name) for w in _WORD.findall(part.replace("_", " "))}


def _restates(word: str, names: set[str]) -> bool:
    if word in names:
        return True
    return any(word.startswith(n[: max(3, len(n) - 1)]) and abs(len(word) - len(n)) <= 3 for n in names if len(n) >= 3)


def documentation(text: str | None, name: str) -> str | None:
    """The lines of a comment or docstring that say something the name does not, or None."""
    if not text:
        return None
    kept, said, names, tagged, fenced = [], set(), name_words(name), False, False
    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith("```"):
            fenced = not fenced
            continue
        line = line.strip("*/# \t\r").strip() if not line[:1] in "@:" else line
        if fenced or not line or _DIRECTIVE.match(line):
            continue
        if _FILLER.search(line) or _SECTION.match(line) or _NOTE.search(line):
            continue
        body = line
        if m := _TAG.match(line):
            rest = m.group("rest").strip()
            rest = re.sub(r"^(?:\{[^}]*\}\s*)?(?:[\w$.\[\]=]+\s*:?\s*)?", "", rest, count=1) if m.group("tag") in ("param", "arg", "argument", "type", "property", "throws", "raises", "rtype", "template", "typeparam") else rest
            body, tagged = rest.lstrip("-: "), True
            if not body:
                continue
        elif m := _ITEM.match(line):
            body = m.group("rest") or line
        elif _CODE.search(line):
            continue
        words = [w.lower() for w in _WORD.findall(body)]
        said.update(w for w in words if not (w.isascii() and len(w) < 2) and w not in _STOP and not _restates(w, names))
        if words:
            kept.append(line)
    return "\n".join(kept) if said else None


def _masked(text: str, token: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """text with strings and comments blanked, line ends kept; and where the comments are."""
    out, at, comments = [], 0, []
    for m in token.finditer(text):
        a, b = m.span()
        out.append(text[at:a])
        piece = text[a:b]
        out.append(_BLANK.sub(" ", piece) if "\n" in piece else " " * (b - a))
        if piece[0] == "#" or piece[:2] in ("//", "/*"):
            comments.append((a, b))
        at = b
    out.append(text[at:])
    return "".join(out), comments


def _closing(masked: str, at: int) -> int:
    """Where the bracket at ``at`` is closed, just behind it."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(masked, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


class _Above:
    """Finds the comments directly above a place in a text."""

    def __init__(self, text: str, comments: list[tuple[int, int]], decorators: re.Pattern, masked: str):
        self.text, self.comments, self.ends = text, comments, [b for _, b in comments]
        self.decorators = {m.end(): m.start() for m in decorators.finditer(masked)} if "@" in masked else {}

    def __call__(self, start: int) -> tuple[str, bool]:
        """The comments that end just above ``start``, and whether nothing else precedes them in the text."""
        found, at, text = [], start, self.text
        while True:
            if at in self.decorators:
                at = self.decorators[at]
                continue
            k = bisect_right(self.ends, at) - 1
            if k < 0:
                break
            a, b = self.comments[k]
            gap = text[b:at]
            line = text.rfind("\n", 0, a) + 1
            if gap.strip() or gap.count("\n") > 1 or text[line:a].strip():
                break
            found.append(text[a:b])
            at = line
            if a == 0:
                break
        return "\n".join(reversed(found)), not text[:at].strip("﻿")


def _normal(parameters: str) -> tuple[str, int]:
    """A parameter list without names, defaults and white space, and how many there are."""
    depth, part, parts = 0, "", []
    for c in parameters:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append(part)
            part = ""
        else:
            part += c
    parts = [p for p in [*parts, part] if p.strip() and p.strip() not in ("self", "cls", "*", "/")]
    kinds = [re.sub(r"\s+", "", p.split("=")[0].partition(":")[2]) or "_" for p in parts]
    return "(" + ",".join(kinds) + ")", len(kinds)


def _python(text: str) -> Iterator[tuple]:
    masked, comments = _masked(text, _PY)
    above = None
    open_: list[tuple[int, str, bool, int]] = []  # indent, name, is a class, where its body starts
    for m in _PY_DEF.finditer(masked):
        indent = len(m.group("in").expandtabs(8))
        while open_ and (open_[-1][0] >= indent or re.search(rf"^[ \t]{{0,{open_[-1][0]}}}[^\s@)\]}}]", masked[open_[-1][3] : m.start()], re.MULTILINE)):
            open_.pop()
        name = m.group("name")
        inside = any(not is_class for _, _, is_class, _ in open_)
        paren = masked.find("(", m.end())
        if m.group("class"):
            colon = masked.find(":", m.end())
            open_.append((indent, name, True, (colon if colon >= 0 else m.end()) + 1))
            continue
        end = _closing(masked, paren) if paren >= 0 else m.end()
        colon = masked.find(":", end)
        colon = len(masked) - 1 if colon < 0 else colon
        outer = ".".join(n for _, n, _, _ in open_)
        open_.append((indent, name, False, colon + 1))
        if inside:
            continue
        above = above or _Above(text, comments, _PY_DECORATOR, masked)
        comment, top = above(m.start())
        doc = _PY_DOC.match(text, colon + 1)
        docstring = doc.group("t") if doc and doc.group("p").lower() in ("", "r", "u") else None
        close = re.compile(rf"^[ \t]{{0,{len(m.group('in'))}}}[^\s#)\]}}]", re.MULTILINE).search(masked, colon + 1)
        stop = close.start() if close else len(text)
        before = masked[max(0, m.start() - 80) : m.start()]
        stub = "@overload" in before.replace(" ", "") or "@typing.overload" in before
        yield name, f"{outer}.{name}" if outer else name, text[paren + 1 : end - 1], comment, docstring, top, not stub, text[m.start() : stop].rstrip()


def _typescript(text: str, kind: str) -> Iterator[tuple]:
    masked, comments = _masked(text, _TS)
    above = _Above(text, comments, _TS_DECORATOR, masked)
    spots: list[tuple[int, str, int, str]] = []  # where, class, where the head goes on, name
    if kind == "method":
        bodies = [(0, len(masked), "")]
    else:
        bodies, depths = [], _depths(masked)
        for m in _TS_CLASS.finditer(masked):
            brace = masked.find("{", m.end())
            if brace >= 0 and depths(m.start()) == 0:
                bodies.append((brace + 1, _closing(masked, brace) - 1, m.group("name")))
        for rule in (_TS_FUNCTION, _TS_ARROW):
            spots += [(m.start(), "", m.end(), m.group("name")) for m in rule.finditer(masked) if depths(m.start()) == 0]
    for a, b, owner in bodies:
        at = _depths(masked, a, b)
        for m in _TS_METHOD.finditer(masked, a, b):
            if m.group("name") not in _NOT_METHODS and at(m.start("name")) == 0:
                spots.append((m.start(), owner, m.end("name") if m.group("how") == "(" else m.end(), m.group("name").lstrip("#")))
    for start, owner, go, name in sorted(spots):
        paren = masked.find("(", go - 1) if masked[go - 1 : go] == "(" else masked.find("(", go)
        end = _closing(masked, paren) if paren >= 0 else go
        tail = re.compile(r"[^{;=\n]*").match(masked, end)
        arrow = masked.startswith("=>", tail.end())
        brace = masked.find("{", tail.end())
        has_body = arrow or masked[tail.end() : tail.end() + 1] in ("{", "=") or (masked[tail.end() :].lstrip()[:1] == "{")
        if not has_body:
            stop = tail.end()
        elif arrow and masked[tail.end() + 2 :].lstrip()[:1] != "{":
            semi = masked.find(";", tail.end())
            stop = semi + 1 if semi >= 0 else len(text)
        else:
            stop = _closing(masked, brace) if brace >= 0 else len(text)
        comment, top = above(start)
        yield name, f"{owner}.{name}" if owner else name, text[paren + 1 : end - 1] if paren >= 0 else "", comment, None, top, has_body, text[start:stop].strip()


def _depths(masked: str, a: int = 0, b: int | None = None):
    """A function from a place to the number of brackets open there, counted from a."""
    places, depth, now = [a], [0], 0
    for m in re.compile(r"[()\[\]{}]").finditer(masked, a, len(masked) if b is None else b):
        now += 1 if m.group() in "([{" else -1
        places.append(m.end())
        depth.append(now)
    return lambda at: depth[bisect_right(places, at) - 1]


def read_symbols(text: str, language: str, kind: str) -> Iterator[tuple]:
    """(name, qualified name, parameters, comment above, docstring, at the top, has a body, code) of each function."""
    return _python(text) if language == "python" else _typescript(text, kind)


def trailing_comment(text: str, language: str) -> str | None:
    """The comment on the last lines of a text, if that is how it ends."""
    _, comments = _masked(text, _PY if language == "python" else _TS)
    end = len(text.rstrip("\n")) if text.endswith("\n") and not text.endswith("\n\n") else len(text)
    found = []
    for a, b in reversed(comments):
        gap = text[b:end]
        line = text.rfind("\n", 0, a) + 1
        if gap.strip() or gap.count("\n") > 1 or found and gap.count("\n") != 1 or text[line:a].strip():
            break
        found.append(text[a:b])
        end = a
    return "\n".join(reversed(found)) or None


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            parent = r.parent_symbol
            for name, qualified, parameters, comment, docstring, top, has_body, code in read_symbols(r.content, r.lang, r.symbol_kind):
                doc, origin = documentation(docstring, name), "docstring"
                if doc is None:
                    doc, origin = documentation(comment, name), "comment"
                signature, arity = _normal(parameters)
                if parent and r.symbol_kind == "method" and "." not in qualified:
                    qualified = f"{parent}.{qualified}"
                line = int(r.start_line) if top and not pd.isna(r.start_line) else None
                out.append((r.chunk_id, r.repo_id, r.sha, r.path, r.module, qualified, name, signature, arity, line, doc, origin if doc else None, has_body, code))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"repo_id": "Int64", "top_line": "Int32"})


def _prepared(chunks: DataFrame) -> DataFrame:
    path = F.col("path")
    lang = F.coalesce(language_of(path), F.when(F.lower("language").startswith("py"), "python").when(F.lower("language").isin("ts", "tsx", "js", "jsx", "typescript", "javascript"), "typescript"))
    return chunks.select(
        F.col("id").cast("long").alias("chunk_id"), F.col("repo_id").cast("long").alias("repo_id"), "sha", "path",
        F.regexp_replace(path, r"(\.d)?\.(pyi?|tsx?|jsx?)$", "").alias("module"),
        lang.alias("lang"), "symbol_kind", "parent_symbol", "start_line", "end_line", "content",
    ).where("content is not null and content != '' and lang is not null")


def symbols(chunks: DataFrame) -> DataFrame:
    """The symbol table (columns as in :data:`SYMBOLS`) of all function, method and class chunks."""
    return _prepared(chunks).where(F.col("symbol_kind").isin("function", "method", "class")).mapInPandas(_symbols, SYMBOLS)


OFFERS = "repo_id long, sha string, path string, line int, module string, qualified string, signature string, arity int, doc string"


def _offers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OFFERS.split(", ")]
    for batch in batches:
        out = []
        comments = batch.symbol_kind == "module"
        for r in batch[comments].itertuples(index=False):
            if doc := trailing_comment(r.content, r.lang):
                out.append((r.repo_id, r.sha, r.path, None if pd.isna(r.end_line) else int(r.end_line) + 1, None, None, None, None, doc))
        for found in _symbols(iter([batch[~comments]])):
            for r in found[~found.has_body & found.doc.notna()].itertuples(index=False):
                out.append((r.repo_id, r.sha, r.path, None, r.module, r.qualified, r.signature, r.arity, r.doc))
        yield pd.DataFrame(out, columns=names).astype({"repo_id": "Int64", "line": "Int32", "arity": "Int32"})


def offers(chunks: DataFrame) -> DataFrame:
    """Documentation apart from its definition (columns as in :data:`OFFERS`): module comments with the line they stand above, declarations with their names."""
    rows = _prepared(chunks)
    last = F.trim(F.element_at(F.split(F.regexp_replace("content", r"\r?\n?$", ""), "\n"), -1))
    comment = (F.col("symbol_kind") == "module") & (last.startswith("#") | last.startswith("//") | last.endswith("*/") | last.endswith("*/\r"))
    bodiless = (
        F.col("content").contains("overload") | F.lower("path").rlike(r"\.(d\.ts|pyi)$")
        | F.col("content").rlike(r"(?m)^[ \t]*(export[ \t]+)?(declare[ \t]+)?(async[ \t]+)?function[ \t]+\w+[^{}]*\)[ \t]*(:[^{};=]+)?;")
        | F.col("content").rlike(r"(?m)^[ \t]+(abstract[ \t]+)?\w+\([^(){}]*\)[ \t]*:[^{};=()]+;[ \t\r]*$")
    )
    return rows.where(comment | (F.col("symbol_kind").isin("function", "method", "class") & bodiless)).mapInPandas(_offers, OFFERS)


@F.pandas_udf(T.StringType())
def _documentation(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([documentation(t, n) if t else None for t, n in zip(text, name, strict=True)], dtype=object)


def pair(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """(chunk_id, symbol_name, qualified, signature, doc, origin[, code]) of every documented function."""
    table = symbols(chunks).where("has_body")
    if not with_code:
        table = table.drop("code")
    apart = cut(offers(chunks))
    place, own_file, any_file = ["repo_id", "sha", "path", "line"], ["repo_id", "sha", "module", "name_key"], ["repo_id", "sha", "name_key"]
    comments = small(apart.where("line is not null").groupBy(*place).agg(F.min("doc").alias("above_doc")))
    declared = apart.where("qualified is not null").withColumnRenamed("qualified", "name_key")
    own = -1 - F.pmod(F.hash("chunk_id", "qualified"), F.lit(2**31 - 2))  # a key without a partner for those that need none
    table = table.withColumn("line", F.when(F.col("doc").isNull(), F.col("top_line"))).withColumn("line", F.coalesce("line", own))
    near = table.join(comments, place, "left")
    near = near.withColumn("above_doc", _documentation("above_doc", "symbol_name")).withColumn("origin", F.when(F.col("doc").isNotNull(), F.col("origin")).when(F.col("above_doc").isNotNull(), "module comment"))
    near = near.withColumn("doc", F.coalesce("doc", "above_doc"))
    far = near.withColumn("name_key", F.when(F.col("doc").isNull(), F.col("qualified")).otherwise(F.concat(F.lit("\0"), own.cast("string"))))
    agreed = F.when(F.min("doc") == F.max("doc"), F.min("doc"))
    levels = [([*own_file, "signature"], F.min("doc")), ([*own_file, "arity"], F.min("doc")), (own_file, F.min("doc")), ([*any_file, "signature"], agreed), ([*any_file, "arity"], agreed)]
    for k, (key, doc) in enumerate(levels):
        far = far.join(small(declared.groupBy(*key).agg(doc.alias(f"declared{k}"))), key, "left")
    chosen = F.coalesce(*[f"declared{k}" for k in range(len(levels))])
    out = far.withColumn("origin", F.coalesce("origin", F.when(chosen.isNotNull(), "declaration"))).withColumn("doc", F.coalesce("doc", chosen))
    keep = ["chunk_id", "symbol_name", "qualified", "signature", "doc", "origin", *(["code"] if with_code else [])]
    return out.where("doc is not null").select(*keep)


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, symbol_name) of every documented function, each once a chunk."""
    return pair(chunks, with_code=False).select("chunk_id", "symbol_name").distinct()
