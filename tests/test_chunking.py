from __future__ import annotations

from lodestrata.operators.chunking import chunk_files, cut, python_imports, symbols_of
from lodestrata.sources import schemas

PYTHON = '''"""Notes."""
import os
from pathlib import Path

LIMIT = 3


def helper(a):
    return a


class Worker:
    """Works."""

    size = 1

    def run(self):
        return 1

    @property
    def stop(self):
        return 2


@wrap(1)
async def last():
    pass


if __name__ == "__main__":
    helper(1)
'''
TYPESCRIPT = '''import { readFile } from "node:fs";
import type { T } from "./types";

// A limit.
const LIMIT = 3;

export const wrapped = memo(async (a: string) => a);

export function parse(
  text: string,
): number {
  return text.length; // "}"
}

export class Server<T> extends Base {
  private port = 1;

  start(a: Map<string, number>) {
    return `${a} }{`;
  }

  async stop() {
    return /[{}]/.test("x");
  }
}
'''


def places(text, lang, budget=10_000):
    return [(name, kind, a, b) for name, kind, _, a, b, _ in cut(text, lang, budget)]


def test_python_chunks():
    assert places(PYTHON, "python") == [(None, "module", 1, 5), ("helper", "function", 8, 9), ("Worker", "class", 12, 22), ("last", "function", 25, 27), (None, "module", 30, 31)]
    assert python_imports(PYTHON) == ["os", "pathlib"]
    assert places("import os\nimport sys\n\n\ndef f():\n    pass\n", "python") == [("f", "function", 5, 6)]


def test_a_class_over_the_budget_is_cut_at_its_members():
    got = cut(PYTHON, "python", 100)
    assert [(n, k, p) for n, k, p, *_ in got if p == "Worker" or n == "Worker"] == [("Worker", "class", None), ("run", "method", "Worker"), ("stop", "method", "Worker")]


def test_a_function_over_the_budget_repeats_its_signature():
    text = "def long(\n    a,\n    b,\n):\n" + "".join(f"    a += {i}\n" for i in range(60))
    got = cut(text, "python", 200)
    assert len(got) > 3 and {c[0] for c in got} == {"long"} and all(c[5].startswith("def long(") and len(c[5]) <= 200 for c in got)
    assert len({c[3] for c in got}) == len(got) and got[-1][4] == 64
    wide = "def configure(\n" + "".join(f"    option_{i}=None,\n" for i in range(15)) + "):\n" + "    x = 1\n" * 5
    assert all(c[5].startswith("def configure(") for c in cut(wide, "python", 250))


def test_broken_files():
    assert places("def broken(:\n    x\n", "python") == [(None, "module", 1, 2)]
    minor = "def good():\n    return 1\n\n\ndef bad(:\n    return\n\n\ndef fine():\n    return 3\n"
    assert places(minor, "python") == [("good", "function", 1, 2), (None, "module", 5, 6), ("fine", "function", 9, 10)]
    assert cut("", "python") == [] and cut("\n \n", "typescript") == []


def test_typescript_chunks():
    got = places(TYPESCRIPT, "typescript")
    assert ("wrapped", "function", 7, 7) in got and ("parse", "function", 9, 13) in got and ("Server", "class", 15, 25) in got
    assert [(n, k, p) for n, k, p, _ in symbols_of(TYPESCRIPT, "typescript")] == [("wrapped", "function", None), ("parse", "function", None), ("Server", "class", None), ("start", "method", "Server"), ("stop", "method", "Server")]


def test_table(spark):
    rows = [(1, 1, "s", "a.py", PYTHON, ""), (2, 1, "s", "b.go", "func main() {}", ""), (3, 1, "s", "c.ts", None, ""), (4, 1, "s", None, "x", ""), (5, 1, "s", "bad.py", "def broken(:\n", "")]
    got = chunk_files(spark.createDataFrame(rows, schemas.FILES)).collect()
    assert {r.file_id for r in got} == {1, 5}
    assert {tuple(r.imports) for r in got} == {("os", "pathlib"), ()}
    assert chunk_files(spark.createDataFrame([], schemas.FILES)).collect() == []


def test_long_functions_are_cut_between_statements():
    body = "".join(f"    x{i} = [\n        {i},\n        {i + 1},\n    ]\n" for i in range(12))
    text = f"def big(a):\n{body}    return a\n"
    pieces = [c for c in cut(text, "python", 200) if c[1] == "function"]
    lines = text.split("\n")
    assert len(pieces) > 2 and [p[3] for p in pieces[1:]] == [p[4] + 1 for p in pieces[:-1]] and pieces[0][3] == 1 and pieces[-1][4] == 50
    assert all(lines[p[3] - 1].startswith(("    x", "    return", "def")) for p in pieces) and all(p[5].startswith("def big(a):") for p in pieces)
    script = "function big(a) {\n" + "".join(f"  call({{\n    k: {i},\n    v: {i},\n  }});\n" for i in range(12)) + "  return a;\n}\n"
    parts = [c for c in cut(script, "typescript", 200) if c[1] == "function"]
    assert len(parts) > 2 and all(script.split("\n")[c[3] - 1].startswith(("  call", "  return", "function")) for c in parts)


def test_a_statement_over_the_budget_is_cut_by_lines():
    text = "def big(a):\n    x = [\n" + "".join(f"        {i},\n" for i in range(60)) + "    ]\n    return x\n"
    pieces = [c for c in cut(text, "python", 120) if c[1] == "function"]
    assert [p[3] for p in pieces[1:]] == [p[4] + 1 for p in pieces[:-1]] and pieces[-1][4] == 64 and len(pieces) > 3
