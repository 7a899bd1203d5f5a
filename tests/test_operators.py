from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.functions.vector import cosine_distance
from lodestrata.operators import browse, citations, evaluate, filters, search, tools
from lodestrata.sources import corpus, schemas, store
from lodestrata.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def files(spark, *rows):
    made = [(i, 1, "s", path, content, "") for i, (path, content) in enumerate(rows, 1)]
    return spark.createDataFrame(made, schemas.FILES)


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb", "a\n\nb\n", "\n", "a\x0bb\x0cc", "x y", "a\rb"])
def test_lines_are_those_of_python(spark, text):
    assert one(spark, tx.lines(F.lit(text))) == text.splitlines()


def test_query_words(spark):
    ask = lambda q: one(spark, tx.query_words(F.lit(q)))
    assert ask("how does click handle option parsing") == ["click", "handle", "option", "parsing"]
    assert ask("SessionStore") == ["sessionstore"]
    assert ask("find_symbol()") == ["find_symbol"]
    assert ask("how does it work") == ["how", "does", "it", "work"]


def test_cosine_has_no_distance_to_nothing(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, cosine_distance(unit, zero)) is None
    assert one(spark, cosine_distance(unit, unit)) == 0
    assert one(spark, cosine_distance(unit, F.array(F.lit(1.0)))) is None


def test_filters(spark):
    paths = ["keep.py", "keep.ts", "a.min.js", "a/package-lock.json", "x.d.ts", "README.md", "vendor/a.py", "n/node_modules/b.js", "x.generated.ts", ".py", "UP.PY"]
    kept = {r.path for r in filters.source_files(files(spark, *[(p, "") for p in paths])).collect()}
    assert kept == {"keep.py", "keep.ts", "UP.PY"}
    assert {r.path for r in filters.doc_files(files(spark, ("README.md", ""), ("a/README.md", ""), ("setup.py", ""))).collect()} == {"README.md"}
    keep = lambda b: one(spark, filters.keep_bytes(F.lit(b)))
    assert keep(b"text") and not keep(b"a\0b") and keep(b"x" * 1024 + b"\0") and not keep(b"x" * (filters.MAX_FILE_BYTES + 1))


def test_a_skipped_file_uses_up_no_budget(spark):
    rows = files(spark, ("a.py", "x" * 50), ("bb.py", "x" * 30), ("ccc.py", "x" * 5)).withColumn("size", F.length("content").cast("long"))
    kept = {r.path: r.kept for r in filters.within_budget(rows, max_files=10, max_bytes=60).collect()}
    assert kept == {"a.py": True, "bb.py": False, "ccc.py": True}
    assert {r.kept for r in filters.within_budget(rows, 10, 1000).collect()} == {True}
    low = files(spark, ("tests/a.py", "x"), ("deep/er/b.py", "x")).withColumn("size", F.lit(1).cast("long"))
    assert {r.path for r in filters.within_budget(low, 1, 100).where("kept").collect()} == {"deep/er/b.py"}


def test_rrf_is_the_sum_of_reciprocal_ranks(spark):
    lists = [["a", "b", "c"], ["c", "a"]]
    ranked = spark.createDataFrame([(x, r) for one_list in lists for r, x in enumerate(one_list, 1)], "id string, rank int")
    got = {r.id: r.score for r in search.rrf(ranked).collect()}
    assert got == {"a": round(1 / 61 + 1 / 62, 9), "b": round(1 / 62, 9), "c": round(1 / 63 + 1 / 61, 9)}


def test_hybrid_ranks_what_both_halves_find_first(spark):
    texts = spark.createDataFrame([(1, "class SessionStore"), (2, "class SessionStore"), (3, "class Unrelated")], "id long, text string")
    hot = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    vectors = spark.createDataFrame([(1, hot(0)), (2, hot(3)), (3, hot(1)), (9, hot(0))], "id long, embedding array<float>")
    query = F.array(*[F.lit(x) for x in hot(0)])
    got = [r.id for r in search.hybrid(texts, vectors, ["SessionStore"], query, k=3).collect()]
    assert got[0] == 1 and set(got) == {1, 2, 3}
    none = vectors.where("false")
    assert [r.id for r in search.hybrid(texts, none, ["SessionStore", "class"], query, k=3).collect()] == [1, 2, 3]
    assert search.hybrid(texts.where("false"), vectors, ["x"], query).collect() == []


def test_knn_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = vectors.where("id % 50 = 0 and id < 300").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in search.knn(vectors, asked, 5).collect()}
    for r in asked.collect():
        best = vectors.select("id", cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in r["query"]])).alias("d")).where("d is not null").orderBy("d", "id").limit(5).collect()
        assert [got[r.query_id, k][0] for k in range(1, 6)] == [b.id for b in best]


@pytest.mark.parametrize(
    "pattern, literal",
    [("def echo", "def echo"), (r"class\s+Command", "Command"), ("createStore", "createStore"), (r"\w+", None), ("a|b", None), ("foo|barbaz", None), (r"\bdef\b", "def"), ("colou?r", "colo"), ("(?i)hello", None), ("foo.barr", "barr"), ("ab*cde", "cde"), (r"x\.pyc", "x.pyc")],
)
def test_required_literal(pattern, literal):
    assert tools.required_literal(pattern) == literal


def test_grep_narrowed_is_grep(spark):
    rows = files(spark, ("a.py", "foo = 1\nbar = foo\n"), ("d/b.py", "colour\ncolor\n"), ("d/c.py", None))
    for pattern in (r"fo+", r"colou?r", r"(?i)FOO", r"foo|color", r"bar = \w+"):
        got = [(r.path, r.line_no) for r in tools.grep(rows, pattern).orderBy("path", "line_no").collect()]
        rx = re.compile(pattern)
        want = [(r.path, n) for r in rows.collect() for n, line in enumerate((r.content or "").splitlines(), 1) if rx.search(line)]
        assert got == sorted(want)
    assert {r.path for r in tools.grep(rows, "color", "d").collect()} == {"d/b.py"} == {r.path for r in tools.grep(rows, "color", "d/b.py").collect()}
    assert {r.total for r in tools.grep(rows, r"o", cap=1).collect()} == {4}


def test_list_dir_takes_its_path_literally(spark):
    rows = files(spark, ("src/a.py", ""), ("src/n/u.py", ""), ("s_c/x.py", ""), ("top.py", ""))
    assert {r.entry for r in tools.list_dir(rows).collect()} == {"src/", "s_c/", "top.py"}
    assert {r.entry for r in tools.list_dir(rows, "s_c").collect()} == {"x.py"}
    assert {r.entry for r in tools.list_dir(rows, "/src/").collect()} == {"a.py", "n/"}


def test_read_file(spark):
    rows = files(spark, ("a", "1\n2\n3\n"), ("empty", ""))
    got = tools.read_file(rows, 2, 3).collect()
    assert [(r.path, r.text, r.truncated) for r in got] == [("a", "2\n3", False)]
    long = files(spark, ("long", "x\n" * 500))
    assert [(r.n_shown, r.truncated) for r in tools.read_file(long).collect()] == [(400, True)]
    assert tools.read_file(rows, 9).collect() == []


def test_find_symbol_says_when_there_are_more(spark):
    rows = spark.createDataFrame([(i, 1, "s", "f", "function", "p", i, None) for i in range(20)], schemas.SYMBOLS)
    assert {r.truncated for r in tools.find_symbol(rows, "f").collect()} == {False}
    more = rows.union(spark.createDataFrame([(99, 1, "s", "f", "function", "q", 1, None)], schemas.SYMBOLS))
    got = tools.find_symbol(more, "f").collect()
    assert len(got) == 20 and {r.truncated for r in got} == {True}


def test_citations(spark):
    tree = files(spark, ("src/app.py", "a\nb\nc\nd\n"))
    sha = tree.first().sha
    texts = lambda t: spark.createDataFrame([(1, 1, sha, t)], "doc_id long, repo_id long, sha string, text string")
    say = lambda t: [(r.path, r.first, r.last, r.valid) for r in citations.validate(texts(t), tree).orderBy("n").collect()]
    assert say("see src/app.py:1-4") == [("src/app.py", 1, 4, True)]
    assert say("src/app.py:2 and gone.py:1") == [("src/app.py", 2, 2, True), ("gone.py", 1, 1, False)]
    assert say("src/app.py:4-5, src/app.py:0") == [("src/app.py", 4, 5, False), ("src/app.py", 0, 0, False)]
    assert say("nothing") == []
    assert say("a.py:99999999999999999999") == [("a.py", None, None, False)]
    strip = lambda t: citations.stripped(texts(t), tree).first()
    assert strip("x src/app.py:1-4 y gone.py:1 z gone.py:1 .")[1:] == (1, 2, "x src/app.py:1-4 y  z  .")
    assert strip("nothing")[1:] == (0, 0, "nothing") and strip(None)[1:] == (0, 0, None)


def test_citations_go_by_the_commit_of_the_answer(spark):
    rows = [(1, 1, "old", "a.py", "1\n2\n3\n", ""), (2, 1, "new", "a.py", "1\n", "")]
    tree = spark.createDataFrame(rows, "id long, repo_id long, sha string, path string, content string, git_log string")
    texts = spark.createDataFrame([(1, 1, "new", "a.py:3"), (2, 1, "old", "a.py:3"), (3, 1, None, "a.py:1")], "doc_id long, repo_id long, sha string, text string")
    assert {r.doc_id: r.valid for r in citations.validate(texts, tree).collect()} == {1: False, 2: True, 3: False}


def test_queries_with_phrases_alternatives_and_words_that_must_not_be_there(spark):
    assert search.parse_query('"Short name" -logger or worker settings') == [[("all", ["short", "name"]), ("not", ["logger"])], [("all", ["worker"]), ("all", ["settings"])]]
    assert search.parse_query("") == search.parse_query("or") == []
    texts = spark.createDataFrame([(1, "a short name"), (2, "short; name logger"), (3, "name short"), (4, "settings of a worker"), (5, None)], "id long, text string")
    found = lambda q: sorted(r.id for r in search.web(texts, q).collect())
    assert found('"short name" -logger') == [1] and found('"short name" -logger or worker settings') == [1, 4] and found("short name") == [1, 2, 3] and found("-short") == []


def test_code_search_is_scoped_and_formatted(spark):
    rows = [(1, "c.py", "s1"), (2, "a.py", "s1"), (3, "b.py", "s1"), (4, "old.py", "s0")]
    chunks = spark.createDataFrame([(i, 1, sha, path, "class Store" if path != "b.py" else "class Other", "Store" if i < 3 else None, 1, 2) for i, path, sha in rows], "id long, repo_id long, sha string, path string, content string, symbol_name string, start_line int, end_line int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [1.0, 0.0])], "id long, embedding array<double>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    got = search.search_code(chunks, vectors, ["store"], query, 3, repo_id=1, sha="s1").orderBy("position").collect()
    assert [r.path for r in got] == ["c.py", "a.py", "b.py"] and got[0].text == "c.py:1-2 (Store)\nclass Store" and got[2].text.startswith("b.py:1-2 (module)\n")
    assert search.search_code(chunks.where("false"), vectors, ["store"], query, 3, repo_id=1, sha="s1").collect() == []


def test_nearest_neighbours_in_slices_equal_brute_force(spark):
    from lodestrata.functions.knn import block_knn

    rows = [(i, [float((i * 7 + k * 3) % 11) for k in range(4)]) for i in range(40)] + [(90, [0.0] * 4), (91, None), (92, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = vectors.where("id % 5 = 0").selectExpr("id as query_id", "embedding as query")
    cos = lambda a, b: round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)
    want = {(q, i) for q, a in rows if q % 5 == 0 and a and any(a) for _, i in sorted((cos(a, b), i) for i, b in rows if b and any(b) and len(b) == len(a))[:3]}
    for size in (1 << 20, 100):
        assert {(r.query_id, r.id) for r in block_knn(vectors, queries, 3, size).collect()} == want


def test_lookup_pending_ignored_and_complete(spark):
    from lodestrata.operators import browse
    from lodestrata.sources import store

    tree = files(spark, ("a.py", "x"), ("b.py", "y"))
    assert [r.path for r in tools.lookup(tree.union(tree), tree.where("path = 'a.py'")).collect()] == ["a.py"]
    assert [r.path for r in filters.not_ignored(tree, tree.where("path = 'a.py'")).collect()] == ["b.py"]
    vectors = spark.createDataFrame([(2, [1.0]), (3, None)], "id long, embedding array<double>")
    rows = spark.createDataFrame([(1, i) for i in (4, 3, 2, 1)], "repo_id long, id long")
    assert [(r.id, r.position) for r in store.pending(rows, vectors, 2).orderBy("id").collect()] == [(1, 1), (3, 2)]
    repos = spark.createDataFrame([(1, tree.first().sha), (2, None)], "id long, last_indexed_sha string")
    assert {r.repo_id: r.complete for r in browse.complete(repos, files=tree).collect()} == {1: True, 2: False}


def test_frames_fold_to_an_exchange(spark):
    rows = [(1, 1, "step_start", 1, "grep", None), (1, 2, "step_result", 1, None, "3 matches"), (1, 3, "step_start", 2, "read_file", None), (1, 5, "token", None, None, "world"), (1, 4, "token", None, None, "hello "), (1, 7, "done", None, None, None), (2, 8, "error", None, None, "quota")]
    frames = spark.createDataFrame([(*r, None, None, None) for r in rows] + [(1, 6, "citation", None, None, None, "a.py", 1, 2)], "run_id int, event_id int, type string, step int, tool string, text string, path string, first int, last int")
    got = {r.run_id: r for r in progress.fold_exchange(frames).collect()}
    assert got[1].answer == "hello world" and [tuple(s) for s in got[1].steps] == [(1, "grep", "3 matches"), (2, "read_file", None)] and [tuple(c) for c in got[1].citations] == [("a.py", 1, 2)]
    assert got[1].done and got[1].error is None and got[2].done and got[2].error == "quota" and got[2].answer == ""
    assert progress.fold_exchange(frames.where("false")).collect() == []


def test_results_are_written_as_json(spark, tmp_path):
    questions = spark.createDataFrame([(1, 7, ["a", "b"]), (2, 7, ["c"])], "question_id int, repo_id int, truth array<string>")
    hits = spark.createDataFrame([(1, "a"), (1, "z")], "question_id int, path string")
    evaluate.write_results(evaluate.searched(questions, hits), str(tmp_path / "out"))
    assert {r.question_id: (r.recall, r.missing) for r in spark.read.json(str(tmp_path / "out")).collect()} == {1: (0.5, ["b"]), 2: (0.0, ["c"])}


def _shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_many_questions_do_not_shuffle_their_pairs_with_texts(spark):
    n = 1000
    texts = spark.range(n).selectExpr("id % 2 as repo_id", "id", "concat('f', id) as path", "concat('get item value w', id) as text").repartition(4)
    questions = spark.range(n).selectExpr("id as question_id", "id % 2 as repo_id", "array('get', 'item', 'value', concat('w', id)) as terms")
    before = _shuffled(spark)
    got = search.batch(texts, questions).collect()
    assert sorted((r.question_id, r.id, r.rank, r.score) for r in got) == [(i, i, 1, 2.0) for i in range(n)]
    assert _shuffled(spark) - before < 10 * n


def test_many_questions_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [(rng.choice([1, 2, None]), rng.choice([None, *range(40)]), rng.choice("ab"), " ".join(rng.choices(["x", "Y", "z_", "w", "ä", "-"], k=rng.randrange(9)))) for _ in range(300)]
    questions = [(q, rng.choice([1, 2, 3, None]), rng.choices(["x", "y", "z_", "w", "ä", "none"], k=rng.randrange(4))) for q in range(60)]
    held = {}  # rows of one id and path are one text
    for repo, i, path, text in texts:
        for w in re.findall(r"\w+", text.lower()):
            of = held.setdefault((repo, i, path), {})
            of[w] = of.get(w, 0) + 1
    want = []
    for q, repo, terms in questions:
        hits = [(-round(sum(of[t] / (of[t] + 1) for t in set(terms)), 9), i is not None, i, path) for (r, i, path), of in held.items() if repo is not None and r == repo and terms and all(t in of for t in terms)]
        want += [(q, i, path, -score, n) for n, (score, _, i, path) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0, h[3]))[:3], 1)]
    t = spark.createDataFrame(texts, "repo_id long, id long, path string, text string")
    a = spark.createDataFrame(questions, "question_id long, repo_id long, terms array<string>")
    for bounds in ({}, {"block_bytes": 200, "block_questions": 7}):
        got = [(r.question_id, r.id, r.path, r.score, r["rank"]) for r in search.batch(t, a, 3, **bounds).collect()]
        assert sorted(got, key=lambda r: (r[0], r[4])) == want


def test_recall(spark):
    s = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, evaluate.recall(s("a", "b"), s("a", "c"))) == 0.5
    assert one(spark, evaluate.recall(s("a"), s("a"))) == 1.0
    assert one(spark, evaluate.recall(s("a"), s("b"))) == 0.0
    assert one(spark, evaluate.recall(s(), s("b"))) == 1.0
    evaluate.check_regression(0.9, 0.91)
    with pytest.raises(ValueError):
        evaluate.check_regression(0.88, 0.91)


def test_repository_addresses(spark):
    ask = lambda u: one(spark, corpus.repository(F.lit(u)))
    for url in ("https://git.example/o/n", "https://git.example/o/n/", "https://git.example/o/n.git", " http://git.example/o/n "):
        assert ask(url) == Row(owner="o", name="n")
    for url in ("git@host:o/n", "https://git.example/o", "https://git.example/o/n/tree/x", "", "x https://git.example/o/n"):
        assert ask(url) is None


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes("x = 'é'\n".encode())
    (tmp_path / "bad.py").write_bytes(b"a\xffb")
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    got = {r.path: r.content for r in corpus.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": "x = 'é'\n", "bad.py": "a�b"}


def test_store_keeps_old_commits_and_shows_the_newest(spark, tmp_path):
    root = str(tmp_path / "index")
    repo = lambda sha: spark.createDataFrame([(1, "o", "n", None, None, sha, "ready")], schemas.REPOS)
    tree = lambda sha, *paths: {"files": spark.createDataFrame([(i, 1, sha, p, "x", "") for i, p in enumerate(paths)], schemas.FILES)}
    store.write_index(spark, root, tree("s1", "a", "b"), repo("s1"))
    store.write_index(spark, root, tree("s1", "a", "c"), repo("s1"))
    assert {r.path for r in store.read_table(spark, root, "files").collect()} == {"a", "c"}
    store.write_index(spark, root, tree("s2", "d"), repo("s2"))
    assert {r.path for r in store.read_table(spark, root, "files").collect()} == {"d"}
    assert {r.path for r in store.read_table(spark, root, "files", latest=False).collect()} == {"a", "c", "d"}
    store.write_index(spark, root, tree("s3", "e"), repo("s3"), update_latest=False)
    assert store.read_manifest(spark, root).first().last_indexed_sha == "s2"


def test_manifest_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "o", "n", "main", 5, "s1", "ready"), (2, "p", "m", None, None, None, "indexing")], schemas.REPOS)
    new = spark.createDataFrame([(1, None, None, None, None, "s2", None), (3, "q", "k", None, None, "s9", "ready")], schemas.REPOS)
    got = {r.id: r for r in store.merge_manifest(old, new).collect()}
    assert (got[1].owner, got[1].stars, got[1].last_indexed_sha, got[1].status) == ("o", 5, "s2", "ready")
    assert got[2].status == "indexing" and got[3].last_indexed_sha == "s9"
    held = {r.id: r for r in store.merge_manifest(old, new, update_latest=False).collect()}
    assert held[1].last_indexed_sha == "s1" and held[3].last_indexed_sha is None


def test_frames(spark):
    text = 'data: {"a":1}\n\n: beat\n\ndata: {"b":2}\n\ndata: {"cut'
    assert one(spark, progress.frames(F.lit(text))) == ['{"a":1}', '{"b":2}']


def test_progress_stream(spark, sf, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(str(source))
    stream = progress.progress_stream(spark, str(source), schemas.EVENTS)
    progress.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    closed = got.agg(F.max("window.end")).first()[0]
    want = events.where(F.col("ts").cast("timestamp") < F.lit(closed)).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "user_id").count().count()
    assert got.count() == want and got.agg(F.sum("n")).first()[0] == events.where(F.col("ts").cast("timestamp") < F.lit(closed)).count()


def test_backfill_stream_writes_each_batch_once(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string").write.parquet(str(tmp_path / "in"))
    pending = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    embed = lambda b: b.select("id", F.array(F.length("text").cast("float")).alias("embedding"))
    for _ in range(2):
        progress.backfill_stream(pending, embed, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_starter_questions_and_outline(spark):
    rows = spark.createDataFrame([(1, 1, "s", "App", "class", "src/app.py", 3, None), (2, 1, "s", "_Hidden", "class", "src/app.py", 9, None), (3, 1, "s", "run", "method", "src/app.py", 4, "App"), (4, 1, "s", "T", "class", "tests/t.py", 1, None)], schemas.SYMBOLS)
    assert [r.question for r in browse.starter_questions(rows).orderBy("position").collect()] == ["What does `App` in src/app.py do?", "How is src/app.py organised?"]
    assert {r.path: r.outline for r in browse.outline(rows).collect()}["src/app.py"] == "3 class App; 4 method run; 9 class _Hidden"


def test_empty_tables(spark):
    none = spark.createDataFrame([], schemas.FILES)
    assert tools.grep(none, "x").collect() == [] and tools.list_dir(none).collect() == [] and tools.git_log(none).collect() == []
    assert browse.tree(none).collect() == [] and browse.readmes(none).collect() == []
    assert filters.within_budget(none.withColumn("size", F.lit(0).cast("long"))).collect() == []
