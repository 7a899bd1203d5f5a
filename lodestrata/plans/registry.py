"""The queries over the test tables, and SQL for those it can express.

Every query runs over its whole tables. Where a tool takes an argument (a
pattern, a name, a question) the query fixes one; row limits stand only where
they are the feature: the first matches of each tree, the best k of a search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as tx
from lodestrata.operators import browse, chunking, citations, evaluate, filters, search, tools
from lodestrata.sources import corpus, store
from lodestrata.streaming import progress

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Terms and vector that the search queries ask for.
TERMS = ["worker", "settings"]
GREP = r"raise \w+Error\("


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(n: int = 64):
    return F.array(*[F.lit(1.0 if k % 3 == 0 else -0.5) for k in range(n)])


_QV = "list_transform(range(64), lambda k: CASE WHEN k % 3 = 0 THEN 1.0 ELSE -0.5 END)"
_TOKENS = "regexp_extract_all(lower(@), '[\\p{L}\\p{N}_]+')"
_SPLIT = "regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_LINES = f"(CASE WHEN {_SPLIT}[-1] = '' THEN {_SPLIT}[:-2] ELSE {_SPLIT} END)"


def _tokens(column: str) -> str:
    return _TOKENS.replace("@", column)


_LATEST = "JOIN repos r ON r.id = {0}.repo_id AND r.last_indexed_sha = {0}.sha"
_KEEP = """
    regexp_matches(lower(path), '[^/]\\.(py|ts|tsx|js|jsx)$')
    AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'vendor', 'dist', 'build', '__pycache__', '.next', '.venv', 'out'])
    AND NOT list_contains(['package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'bun.lockb', 'poetry.lock', 'Pipfile.lock', 'uv.lock', 'Cargo.lock'], string_split(path, '/')[-1])
    AND NOT regexp_matches(string_split(path, '/')[-1], '(\\.min\\.js|\\.min\\.css|\\.min\\.mjs|\\.map|\\.d\\.ts)$')
    AND NOT contains(string_split(path, '/')[-1], '.generated.') AND NOT contains(string_split(path, '/')[-1], '.pb.')
"""
_SCORE = "round(" + " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE / (len(list_filter(t, lambda x: x = '{w}')) + 1)" for w in TERMS) + ", 9)"
_CORE = "path NOT LIKE 'test%' AND path NOT LIKE '%/test%' AND path NOT LIKE 'example%'"
_KEYS = f"""
    SELECT repo_id, sha, path, defs, CAST(row_number() OVER (PARTITION BY repo_id, sha ORDER BY defs DESC, path) AS INT) AS rank
    FROM (SELECT repo_id, sha, path, count(*) AS defs FROM symbols WHERE {_CORE} GROUP BY ALL)
    QUALIFY rank <= 5
"""


# ------------------------------------------------------------------ filters


@query(f"SELECT id, path FROM files WHERE {_KEEP}")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    """Source files that the index takes."""
    return filters.source_files(table(spark, d, "files")).select("id", "path")


@query(
    f"""SELECT id, path FROM (SELECT id, string_split(path, '/')[-1] AS path FROM files)
    WHERE lower(path) IN ('readme.md', 'readme.rst', 'readme.txt', 'pyproject.toml', 'package.json', 'setup.py', 'setup.cfg', 'cargo.toml', 'go.mod', 'dockerfile', 'makefile') AND NOT ({_KEEP})"""
)
def doc_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that would stand at the root of a tree, were every directory one of its own."""
    return filters.doc_files(table(spark, d, "files").withColumn("path", tx.basename(F.col("path")))).select("id", "path")


@query(
    """SELECT id, path, CASE WHEN regexp_matches(lower(path), '[^/]\\.py$') THEN 'python'
    WHEN regexp_matches(lower(path), '[^/]\\.(ts|tsx|js|jsx)$') THEN 'typescript' END AS language FROM files"""
)
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    """Language of every file."""
    return table(spark, d, "files").select("id", "path", tx.language(F.col("path")).alias("language"))


@query("SELECT id, path FROM files WHERE octet_length(encode(content)) <= 4096 AND NOT contains(content[:1024], chr(0))")
def binary_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files of at most four kibibytes and without NUL bytes at their start."""
    return table(spark, d, "files").where(filters.keep_bytes(F.col("content").cast("binary"), 4096)).select("id", "path")


@query(
    """SELECT f.* FROM (SELECT id, repo_id, sha, path, length(content) AS n_chars FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, sha, path ORDER BY id) = 1) f
    SEMI JOIN (SELECT DISTINCT repo_id, sha, path FROM symbols WHERE name = 'encode') s USING (repo_id, sha, path)"""
)
def file_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The files in which `encode` is defined, by their keys."""
    keys = table(spark, d, "symbols").where("name = 'encode'")
    return tools.lookup(table(spark, d, "files"), keys).select("id", "repo_id", "sha", "path", F.length("content").cast("long").alias("n_chars"))


@query(
    """WITH RECURSIVE items AS (
        SELECT repo_id, sha, path, size, row_number() OVER (PARTITION BY repo_id, sha ORDER BY low, deep, long, path, size) AS n FROM (
            SELECT repo_id, sha, path, octet_length(encode(content)) AS size, len(string_split(path, '/')) AS deep, length(path) AS long,
            CAST(len(list_filter(string_split(lower(path), '/'), lambda p: p IN ('test', 'tests', 'spec', 'specs', 'example', 'examples', 'docs', 'doc', 'benchmark', 'benchmarks', 'fixtures', 'testdata', 'third_party'))) > 0 AS INT) AS low
            FROM files)),
    fold AS (
        SELECT repo_id, sha, path, size, n, size <= 20000 AS kept, CASE WHEN size <= 20000 THEN 1 ELSE 0 END AS files, CASE WHEN size <= 20000 THEN size ELSE 0 END AS bytes FROM items WHERE n = 1
        UNION ALL
        SELECT i.repo_id, i.sha, i.path, i.size, i.n, f.files < 4 AND f.bytes + i.size <= 20000, f.files + CASE WHEN f.files < 4 AND f.bytes + i.size <= 20000 THEN 1 ELSE 0 END,
            f.bytes + CASE WHEN f.files < 4 AND f.bytes + i.size <= 20000 THEN i.size ELSE 0 END
        FROM fold f JOIN items i ON i.repo_id = f.repo_id AND i.sha = f.sha AND i.n = f.n + 1)
    SELECT repo_id, sha, path, CAST(size AS BIGINT) AS size, kept FROM fold"""
)
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    """Files of each tree that fit a budget of four files and 20,000 bytes."""
    rows = table(spark, d, "files").withColumn("size", F.octet_length("content").cast("long"))
    return filters.within_budget(rows, max_files=4, max_bytes=20_000)


# --------------------------------------------------------------------- text


@query(f"SELECT id, CAST(len({_LINES}) AS INT) AS n_lines, {_LINES}[1] AS first_line FROM files")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Number of lines and first line of every file."""
    rows = tools.file_lines(table(spark, d, "files").select("repo_id", "sha", F.col("id").cast("string").alias("path"), "content"))
    by = rows.groupBy("path").agg(F.count("*").alias("n"), F.max(F.when(F.col("line_no") == 1, F.col("line"))).alias("first_line"))
    ids = table(spark, d, "files").select("id", F.col("id").cast("string").alias("path"))
    return ids.join(by, "path", "left").select("id", F.coalesce("n", F.lit(0)).cast("int").alias("n_lines"), "first_line")


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs and in how many documents."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(tx.words(F.col("text"))).alias("term"))
    per_doc = rows.groupBy("term", "doc_id").agg(F.count("*").alias("n"))  # counts, not words, are shuffled
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(
    f"""SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ') AS query FROM (
        SELECT doc_id, w, list_filter(w, lambda x: x NOT IN ({_STOP})) AS k FROM (
            SELECT doc_id, list_filter({_tokens('title')}, lambda x: length(x) > 1) AS w FROM documents WHERE title IS NOT NULL))"""
)
def lexical_query(spark: SparkSession, d: str) -> DataFrame:
    """The words of every title that a lexical query keeps."""
    rows = table(spark, d, "documents").where("title is not null")
    return rows.select("doc_id", F.array_join(tx.query_words(F.col("title")), " ").alias("query"))


@query("SELECT id, path || ':' || start_line || '-' || end_line || chr(10) || content AS embedded FROM chunks")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded for every chunk."""
    return table(spark, d, "chunks").select("id", tx.embedding_text(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("embedded"))


@query(f"SELECT id, array_to_string(({_LINES})[1:6], chr(10)) AS snippet FROM chunks")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first six lines of every chunk."""
    return table(spark, d, "chunks").select("id", tx.snippet(F.col("content")).alias("snippet"))


@query(
    """SELECT id, owner, name FROM (SELECT id, regexp_extract(trim(url), '^https?://[\\w.-]+/([\\w.-]+)/([\\w.-]+?)(?:\\.git)?/?$', 1) AS owner,
    regexp_extract(trim(url), '^https?://[\\w.-]+/([\\w.-]+)/([\\w.-]+?)(?:\\.git)?/?$', 2) AS name FROM index_runs) WHERE owner <> ''"""
)
def url_parse(spark: SparkSession, d: str) -> DataFrame:
    """Owner and name of the repository of every run."""
    rows = table(spark, d, "index_runs").select("id", corpus.repository(F.col("url")).alias("r")).where("r is not null")
    return rows.select("id", "r.owner", "r.name")


# ----------------------------------------------------------------- chunking


@query()
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every source file."""
    return chunking.chunk_files(table(spark, d, "files"))


@query("SELECT DISTINCT repo_id, sha, path, symbol_name, end_line FROM chunks WHERE symbol_kind = 'function'")
def chunk_functions(spark: SparkSession, d: str) -> DataFrame:
    """The last lines of whole functions in every file that has symbols, as a file that does not parse has no chunk but itself in the table."""
    whole = table(spark, d, "symbols").select("repo_id", "sha", "path").distinct()
    rows = chunking.chunk_files(table(spark, d, "files"), max_chars=1_000_000).where("symbol_kind = 'function'").join(whole, ["repo_id", "sha", "path"], "left_semi")
    return rows.select("repo_id", "sha", "path", "symbol_name", "end_line").distinct()


@query("SELECT DISTINCT repo_id, sha, path, name, kind, parent_symbol, line FROM symbols")
def symbol_extract(spark: SparkSession, d: str) -> DataFrame:
    """The symbols read from the source of every file that was cut into chunks; the table has none of files that do not parse."""
    cut = table(spark, d, "chunks").where("symbol_kind != 'module'").select("repo_id", "sha", "path").distinct()
    rows = chunking.extract_symbols(table(spark, d, "files").join(cut, ["repo_id", "sha", "path"], "left_semi"))
    return rows.select("repo_id", "sha", "path", "name", "kind", "parent_symbol", "line").distinct()


# ------------------------------------------------------------------- search

_LEX = f"SELECT id, {_SCORE} AS score FROM (SELECT doc_id AS id, {_tokens('text')} AS t FROM documents) WHERE "
_AND = " AND ".join(f"list_contains(t, '{w}')" for w in TERMS)
_OR = " OR ".join(f"list_contains(t, '{w}')" for w in TERMS)


@query(_LEX + _AND)
def fts_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document with all terms, scored."""
    return search.lexical(_texts(spark, d), TERMS, k=None)


@query(_LEX + "(" + _OR + ")" + " ORDER BY score DESC, id LIMIT 50")
def fts_topk(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best documents with any term."""
    return search.lexical(_texts(spark, d), TERMS, every=False)


@query(f"SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string({_tokens('text')}, ' ') || ' ', ' short name ')")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two words next to each other."""
    return search.phrase(_texts(spark, d), ["short", "name"])


@query(
    f"""SELECT id, {_SCORE.replace("worker", "@1").replace("settings", "short").replace("@1", "name")[:-4]} + len(list_filter(t, lambda x: x = 'worker'))::DOUBLE / (len(list_filter(t, lambda x: x = 'worker')) + 1)
    + len(list_filter(t, lambda x: x = 'settings'))::DOUBLE / (len(list_filter(t, lambda x: x = 'settings')) + 1), 9) AS score
    FROM (SELECT doc_id AS id, {_tokens('text')} AS t FROM documents)
    WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' short name ') AND NOT list_contains(t, 'logger') OR list_contains(t, 'worker') AND list_contains(t, 'settings')"""
)
def fts_web(spark: SparkSession, d: str) -> DataFrame:
    """Documents for a query with a phrase, a word that must not be there, and an alternative."""
    return search.web(_texts(spark, d), '"short name" -logger or worker settings', k=None)


_DIST = f"round(1 - list_sum(list_transform(list_zip(embedding, {_QV}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({_QV}, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"


@query(f"SELECT vec_id AS id, {_DIST} AS distance FROM embeddings ORDER BY distance, id LIMIT 50")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The fifty vectors nearest to a query."""
    return search.nearest(_vectors(spark, d), _query_vector())


@query(
    """SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 - list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
        / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) + 0.0 AS distance,
        CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
        / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6), e.vec_id) AS INT) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10"""
)
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth vector."""
    vectors = _vectors(spark, d)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    out = search.knn(vectors, asked)
    return out.select("query_id", "id", (F.col("distance") + 0.0).alias("distance"), "rank")


_RANKS = f"""near AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT vec_id AS id, {_DIST} AS distance FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY distance, id LIMIT 50)),
    lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_LEX}{_AND} ORDER BY score DESC, id LIMIT 50)),
    best AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM lex) GROUP BY id ORDER BY score DESC, id LIMIT 10)"""


@query(f"WITH {_RANKS} SELECT b.id, b.score, d.text FROM best b JOIN documents d ON d.doc_id = b.id")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by words and vectors together."""
    return search.hybrid(_texts(spark, d), _vectors(spark, d), TERMS, _query_vector())


@query(
    f"""WITH lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_LEX}({_OR}) ORDER BY score DESC, id LIMIT 50))
    SELECT l.id, round(1.0 / (60 + rank), 9) AS score, d.text FROM lex l JOIN documents d ON d.doc_id = l.id ORDER BY score DESC, l.id LIMIT 10"""
)
def hybrid_lexical_only(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents when nothing has a vector yet: any term counts."""
    return search.hybrid(_texts(spark, d), _vectors(spark, d).where(F.size("embedding") < 0), TERMS, _query_vector())


_CODE = f"(SELECT c.* FROM chunks c {_LATEST.format('c')})"


@query(
    f"""WITH near AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT vec_id AS id, {_DIST} AS distance FROM embeddings WHERE vec_id IN (SELECT id FROM {_CODE}) ORDER BY distance, id LIMIT 50)),
    lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {_SCORE.replace("worker", "def").replace("settings", "result")} AS score FROM (SELECT id, {_tokens('content')} AS t FROM {_CODE})
        WHERE list_contains(t, 'def') AND list_contains(t, 'result') ORDER BY score DESC, id LIMIT 50)),
    best AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM lex) GROUP BY id ORDER BY score DESC, id LIMIT 10)
    SELECT CAST(row_number() OVER (ORDER BY b.score DESC, b.id) AS INT) AS position, path, b.score, path || ':' || start_line || '-' || end_line || ' (' || coalesce(symbol_name, 'module') || ')' || chr(10) || content AS text
    FROM best b JOIN {_CODE} c ON c.id = b.id"""
)
def search_code(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of the last indexed commits, as an agent reads them."""
    return search.search_code(table(spark, d, "chunks"), _vectors(spark, d), ["def", "result"], _query_vector(), repos=table(spark, d, "repos"))


@query(
    f"""SELECT id, array_to_string(list_transform(range(64), lambda b: len(list_filter(h, lambda x: x = b))), ' ') AS counts FROM (
    SELECT doc_id AS id, list_transform({_tokens('text')}, lambda w: CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64) AS h FROM documents) WHERE len(h) > 0"""
)
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The hashed word counts that stand in for every document's vector."""
    return search.hashed_counts(_texts(spark, d)).select("id", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"))


# -------------------------------------------------------------------- tools


@query(f"SELECT c.id, c.path, c.symbol_name FROM chunks c {_LATEST.format('c')}")
def latest_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each repository's last indexed commit."""
    return search.latest(table(spark, d, "chunks"), table(spark, d, "repos")).select("id", "path", "symbol_name")


@query(
    f"""SELECT id, n_lines, n_shown, text, truncated FROM (SELECT id, CAST(len(l) AS INT) AS n_lines, CAST(len(l[5:404]) AS INT) AS n_shown, array_to_string(l[5:404], chr(10)) AS text, len(l) - 4 > 400 AS truncated
    FROM (SELECT id, {_LINES} AS l FROM files) WHERE len(l) >= 5)"""
)
def read_file(spark: SparkSession, d: str) -> DataFrame:
    """Every file from its fifth line, at most 400 lines."""
    rows = table(spark, d, "files").select("repo_id", "sha", F.col("id").alias("path"), "content")
    return tools.read_file(rows, start=5).select(F.col("path").alias("id"), "n_lines", "n_shown", "text", "truncated")


@query(
    """SELECT DISTINCT repo_id, sha, CASE WHEN instr(rest, '/') > 0 THEN split_part(rest, '/', 1) || '/' ELSE rest END AS entry
    FROM (SELECT repo_id, sha, substr(path, 5) AS rest FROM files WHERE starts_with(path, 'src/'))"""
)
def list_dir(spark: SparkSession, d: str) -> DataFrame:
    """One level below src/ of every tree."""
    return tools.list_dir(table(spark, d, "files"), "src")


@query(
    f"""SELECT repo_id, sha, path, line_no, line, total FROM (SELECT *, count(*) OVER (PARTITION BY repo_id, sha) AS total, row_number() OVER (PARTITION BY repo_id, sha ORDER BY path, line_no, line) AS n FROM (
        SELECT repo_id, sha, path, CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT repo_id, sha, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT repo_id, sha, path, {_LINES} AS l FROM files)))
        WHERE regexp_matches(line, 'raise \\w+Error\\(')) WHERE n <= 50"""
)
def grep(spark: SparkSession, d: str) -> DataFrame:
    """Lines that raise an error: the first fifty of each tree and how many there are."""
    return tools.grep(table(spark, d, "files"), GREP)


@query(
    """SELECT repo_id, sha, path, line, kind, false AS truncated FROM symbols WHERE name = 'encode'
    QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY path, line, id) <= 20 AND count(*) OVER (PARTITION BY repo_id, sha) <= 20
    UNION ALL SELECT repo_id, sha, path, line, kind, true FROM symbols WHERE name = 'encode'
    QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY path, line, id) <= 20 AND count(*) OVER (PARTITION BY repo_id, sha) > 20"""
)
def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Where `encode` is defined in every tree."""
    return tools.find_symbol(table(spark, d, "symbols"), "encode")


@query(
    """SELECT repo_id, sha, name, count(*) AS n, array_to_string(list_transform(list_sort(list_distinct(list({'path': path, 'line': line, 'kind': kind})))[1:20], lambda p: p.path || ':' || p.line), ' ') AS places
    FROM symbols GROUP BY repo_id, sha, name"""
)
def symbol_places(spark: SparkSession, d: str) -> DataFrame:
    """Where every name of every tree is defined."""
    rows = tools.first_symbols(table(spark, d, "symbols"))
    places = F.array_join(F.transform("places", lambda p: F.concat(p["path"], F.lit(":"), p["line"].cast("string"))), " ")
    return rows.select("repo_id", "sha", "name", "n", places.alias("places"))


@query(
    f"""SELECT repo_id, sha, path, start_line, split_part(content, chr(10), 1) AS first_line, count(*) OVER (PARTITION BY repo_id, sha) > 20 AS truncated FROM (SELECT *, {_tokens("concat_ws(' ', content, symbol_name)")} AS t FROM chunks) WHERE list_contains(t, 'logger') AND list_contains(t, 'warning')
    QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY path, start_line, id) <= 20"""
)
def find_references(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that mention logger.warning, the first of each tree."""
    return tools.find_references(table(spark, d, "chunks"), "logger.warning")


@query(
    """SELECT id, CAST(i - 1 AS INT) AS position, split_part(e, '|', 1) AS hash, split_part(e, '|', 2) AS author, split_part(e, '|', 3) AS date, split_part(e, '|', 4) AS subject FROM (
    SELECT id, l[i] AS e, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, string_split(git_log, chr(10))[1:10] AS l FROM files WHERE git_log <> '')))"""
)
def git_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten commits of every file."""
    return tools.git_log(table(spark, d, "files")).select("id", "position", "hash", "author", "date", "subject")


# ------------------------------------------------------------------- browse


@query(
    """SELECT r.id AS repo_id, r.owner, r.name, r.status, r.last_indexed_sha AS sha,
    (SELECT count(*) FROM chunks c WHERE c.repo_id = r.id AND c.sha = r.last_indexed_sha) AS n_chunks, (SELECT count(*) FROM symbols s WHERE s.repo_id = r.id AND s.sha = r.last_indexed_sha) AS n_symbols FROM repos r"""
)
def repo_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every repository with its chunks and symbols."""
    return browse.counts(table(spark, d, "repos"), table(spark, d, "chunks"), table(spark, d, "symbols")).select("repo_id", "owner", "name", "status", "sha", "n_chunks", "n_symbols")


@query("SELECT repo_id, sha, language, count(DISTINCT path) AS n_files FROM chunks GROUP BY ALL")
def languages(spark: SparkSession, d: str) -> DataFrame:
    """Files of each language in every tree."""
    return browse.language_files(table(spark, d, "chunks"))


@query(_KEYS)
def key_files(spark: SparkSession, d: str) -> DataFrame:
    """The five files of every tree with the most definitions."""
    return browse.key_files(table(spark, d, "symbols"))


@query(
    f"""SELECT s.repo_id, s.sha, s.name, s.kind, s.path, s.line, CAST(row_number() OVER (PARTITION BY s.repo_id, s.sha ORDER BY k.rank, s.line, s.id) AS INT) AS position
    FROM symbols s JOIN ({_KEYS}) k USING (repo_id, sha, path) WHERE s.kind = 'class' AND s.parent_symbol IS NULL AND left(s.name, 1) <> '_' QUALIFY position <= 10"""
)
def top_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Public classes of the key files."""
    return browse.top_symbols(table(spark, d, "symbols"))


@query(
    """SELECT repo_id, sha, path, CAST(row_number() OVER (PARTITION BY repo_id, sha ORDER BY noise, depth, path) AS INT) AS position FROM (
        SELECT DISTINCT repo_id, sha, path, CAST(list_has_any(string_split(path, '/'), ['tests', 'test', 'examples', 'docs', 'scripts']) AS INT) AS noise, len(string_split(path, '/')) AS depth FROM files
        WHERE string_split(path, '/')[-1] IN ('main.py', '__main__.py', 'manage.py', 'app.py', 'cli.py', 'index.ts', 'index.js', 'server.ts', 'Dockerfile', 'Makefile')) QUALIFY position <= 5"""
)
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Likely ways into every tree."""
    return browse.entry_points(table(spark, d, "files"))


@query(
    """SELECT repo_id, sha, path, CAST(length(content) AS INT) AS n_chars FROM files WHERE starts_with(lower(string_split(path, '/')[-1]), 'readme')
    QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY len(string_split(path, '/')), path, id) = 1"""
)
def readme(spark: SparkSession, d: str) -> DataFrame:
    """The first readme of every tree."""
    return browse.readmes(table(spark, d, "files"))


@query(
    f"""WITH keys AS ({_KEYS}), tops AS (SELECT s.repo_id, s.sha, s.name, s.path, row_number() OVER (PARTITION BY s.repo_id, s.sha ORDER BY k.rank, s.line, s.id) AS position
    FROM symbols s JOIN keys k USING (repo_id, sha, path) WHERE s.kind = 'class' AND s.parent_symbol IS NULL AND left(s.name, 1) <> '_' QUALIFY position <= 10)
    SELECT repo_id, sha, question, CAST(row_number() OVER (PARTITION BY repo_id, sha ORDER BY p, question) AS INT) AS position FROM (
    SELECT repo_id, sha, 'What does `' || name || '` in ' || path || ' do?' AS question, position AS p FROM tops UNION ALL SELECT repo_id, sha, 'How is ' || path || ' organised?', rank + 10 FROM keys) QUALIFY position <= 5"""
)
def starter_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions to begin with, for every tree."""
    return browse.starter_questions(table(spark, d, "symbols"))


@query("SELECT repo_id, sha, name, kind, path, line FROM symbols WHERE parent_symbol IS NULL QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY name, path, line, id) <= 200")
def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    """Top-level symbols of every tree by name."""
    return browse.symbol_index(table(spark, d, "symbols"))


@query(
    """SELECT repo_id, sha, path, count(*) AS n_symbols, string_agg(line || ' ' || kind || ' ' || name, '; ' ORDER BY line, kind, name) AS outline FROM symbols GROUP BY repo_id, sha, path"""
)
def symbol_outline(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of every file in order."""
    return browse.outline(table(spark, d, "symbols"))


@query(
    """SELECT repo_id, sha, array_to_string(p[:i - 1], '/') AS parent, p[i] AS name, i < len(p) AS is_dir, count(*) AS n_files,
    CAST(row_number() OVER (PARTITION BY repo_id, sha, array_to_string(p[:i - 1], '/') ORDER BY i < len(p) DESC, p[i]) AS INT) AS position FROM (
    SELECT repo_id, sha, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT repo_id, sha, string_split(path, '/') AS p FROM files)) GROUP BY repo_id, sha, array_to_string(p[:i - 1], '/'), p[i], i < len(p)"""
)
def tree(spark: SparkSession, d: str) -> DataFrame:
    """Every directory of every tree with its entries."""
    return browse.tree(table(spark, d, "files"))


@query(
    f"""WITH k AS ({_KEYS}), t AS (SELECT s.repo_id, s.sha, s.name, row_number() OVER (PARTITION BY s.repo_id, s.sha ORDER BY k.rank, s.line, s.id) AS position
        FROM symbols s JOIN k USING (repo_id, sha, path) WHERE s.kind = 'class' AND s.parent_symbol IS NULL AND left(s.name, 1) <> '_' QUALIFY position <= 10),
    e AS (SELECT repo_id, sha, path, row_number() OVER (PARTITION BY repo_id, sha ORDER BY noise, depth, path) AS position FROM (
        SELECT DISTINCT repo_id, sha, path, CAST(list_has_any(string_split(path, '/'), ['tests', 'test', 'examples', 'docs', 'scripts']) AS INT) AS noise, len(string_split(path, '/')) AS depth FROM files
        WHERE string_split(path, '/')[-1] IN ('main.py', '__main__.py', 'manage.py', 'app.py', 'cli.py', 'index.ts', 'index.js', 'server.ts', 'Dockerfile', 'Makefile')) QUALIFY position <= 5),
    l AS (SELECT repo_id, sha, language, count(DISTINCT path) AS n FROM chunks GROUP BY ALL),
    m AS (SELECT repo_id, sha, path FROM files WHERE starts_with(lower(string_split(path, '/')[-1]), 'readme') QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY len(string_split(path, '/')), path, id) = 1)
    SELECT f.repo_id, f.sha, ll.languages, kk.key_files, tt.top_symbols, ee.entry_points, m.path AS readme FROM (SELECT DISTINCT repo_id, sha FROM files) f
    LEFT JOIN (SELECT repo_id, sha, string_agg(language || ' ' || n, '; ' ORDER BY n DESC, language) AS languages FROM l GROUP BY ALL) ll USING (repo_id, sha)
    LEFT JOIN (SELECT repo_id, sha, string_agg(path, '; ' ORDER BY rank) AS key_files FROM k GROUP BY ALL) kk USING (repo_id, sha)
    LEFT JOIN (SELECT repo_id, sha, string_agg(name, '; ' ORDER BY position) AS top_symbols FROM t GROUP BY ALL) tt USING (repo_id, sha)
    LEFT JOIN (SELECT repo_id, sha, string_agg(path, '; ' ORDER BY position) AS entry_points FROM e GROUP BY ALL) ee USING (repo_id, sha)
    LEFT JOIN m USING (repo_id, sha)"""
)
def orientation(spark: SparkSession, d: str) -> DataFrame:
    """What a newcomer to every tree is shown, in one row."""
    return browse.orientation(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "symbols"))


@query("SELECT i.id, i.status, r.owner, r.name FROM (SELECT DISTINCT ON (id) * FROM index_runs) i JOIN repos r ON r.id = i.repo_id")
def run_scope(spark: SparkSession, d: str) -> DataFrame:
    """Every run of a known repository with that repository's name."""
    return browse.with_repos(table(spark, d, "index_runs").dropDuplicates(["id"]), table(spark, d, "repos")).select("id", "status", "owner", "name")


# --------------------------------------------------- citations and evaluation

_REF = "'\\b([\\w./\\-]+):(\\d+)(?:-(\\d+))?\\b'"
_CITED = f"""SELECT doc_id, repo_id, sha, CAST(i - 1 AS INT) AS n, p[i] AS path, TRY_CAST(f[i] AS BIGINT) AS first, TRY_CAST(CASE WHEN l[i] <> '' THEN l[i] ELSE f[i] END AS BIGINT) AS last, r[i] AS ref FROM (
    SELECT doc_id, repo_id, sha, p, f, l, r, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, d.repo_id, h.last_indexed_sha AS sha, regexp_extract_all(text, {_REF}, 1) AS p,
    regexp_extract_all(text, {_REF}, 2) AS f, regexp_extract_all(text, {_REF}, 3) AS l, regexp_extract_all(text, {_REF}) AS r FROM documents d LEFT JOIN repos h ON h.id = d.repo_id))"""
_COUNTS = f"SELECT repo_id, sha, path, max(len({_LINES})) AS n_lines FROM files GROUP BY repo_id, sha, path"
_VALID = f"""SELECT c.*, coalesce(first >= 1 AND first <= last AND last <= n_lines, false) AS valid FROM ({_CITED}) c
    LEFT JOIN ({_COUNTS}) k ON k.repo_id = c.repo_id AND k.sha = c.sha AND k.path = c.path"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers about their repository at its last indexed commit."""
    heads = table(spark, d, "repos").select(F.col("id").alias("repo_id"), F.col("last_indexed_sha").alias("sha"))
    return table(spark, d, "documents").select("doc_id", "repo_id", "text").join(heads, "repo_id", "left")


@query(_VALID)
def validate_citations(spark: SparkSession, d: str) -> DataFrame:
    """Every reference in every document, checked against its repository's last indexed commit."""
    return citations.validate(_answers(spark, d), table(spark, d, "files"))


@query(
    f"""SELECT doc_id, count(*) AS n_cited, count(*) FILTER (WHERE valid) AS n_valid, coalesce(array_to_string(list_sort(list_distinct(list(ref) FILTER (WHERE NOT valid))), ' '), '') AS invalid FROM ({_VALID}) GROUP BY doc_id"""
)
def citation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Valid and invalid references of every document."""
    return citations.summary(_answers(spark, d), table(spark, d, "files"))


@query(
    f"""SELECT d.doc_id, coalesce(n_valid, 0) AS n_valid, coalesce(n_invalid, 0) AS n_invalid, list_reduce(list_prepend(d.text, coalesce(wrong, CAST([] AS VARCHAR[]))), lambda t, r: replace(t, r, '')) AS answer FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid, list(ref ORDER BY n) FILTER (WHERE NOT valid) AS wrong FROM ({_VALID}) GROUP BY doc_id) v ON v.doc_id = d.doc_id"""
)
def validate_answer(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the references that do not hold."""
    return citations.stripped(_answers(spark, d), table(spark, d, "files"))


@query(f"SELECT doc_id, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS position FROM (SELECT doc_id, path, min(n) AS n FROM ({_CITED}) GROUP BY doc_id, path)")
def files_read_union(spark: SparkSession, d: str) -> DataFrame:
    """The files that every document refers to, each once, in order."""
    return citations.files_read(citations.cited(_answers(spark, d)))


_QUESTIONS = f"""SELECT row_number() OVER (ORDER BY repo_id, name) AS question_id, repo_id, name, list_sort(list_distinct(list(path))) AS truth, list_distinct(regexp_extract_all(lower(replace(name, '_', ' ')), '[\\p{{L}}\\p{{N}}_]+')) AS terms
    FROM (SELECT s.* FROM symbols s {_LATEST.format('s')}) GROUP BY repo_id, name"""
_HITS = f"""SELECT question_id, id, path, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
    SELECT question_id, id, path, any_value(n_terms) AS n_terms, count(*) AS held, round(sum(tf::DOUBLE / (tf + 1)), 9) AS score FROM (
        SELECT repo_id, id, path, word, count(*) AS tf FROM (SELECT repo_id, id, path, unnest({_tokens('content')}) AS word FROM {_CODE}) GROUP BY ALL) JOIN (
        SELECT question_id, repo_id, len(terms) AS n_terms, unnest(terms) AS word FROM q) USING (repo_id, word) GROUP BY question_id, id, path) WHERE held = n_terms QUALIFY rank <= 10"""
_SEARCHED = f"""WITH q AS ({_QUESTIONS}), h AS (SELECT question_id, list_sort(list_distinct(list(path))) AS hits FROM ({_HITS}) GROUP BY question_id),
    r AS (SELECT q.*, coalesce(hits, CAST([] AS VARCHAR[])) AS hits FROM q LEFT JOIN h USING (question_id))"""


def _searched(spark: SparkSession, d: str) -> DataFrame:
    """Questions for the files that define each name of the last indexed commits, searched among the chunks by the words of that name."""
    repos = table(spark, d, "repos")
    truth = search.latest(table(spark, d, "symbols"), repos).groupBy("repo_id", "name").agg(F.array_sort(F.collect_set("path")).alias("truth"))
    questions = truth.withColumn("question_id", F.struct("repo_id", "name")).withColumn("terms", tx.words(F.replace("name", F.lit("_"), F.lit(" "))))
    texts = search.latest(table(spark, d, "chunks"), repos).select("repo_id", "id", "path", F.col("content").alias("text"))
    return evaluate.searched(questions, search.batch(texts, questions, 10))


@query(f"{_SEARCHED} SELECT repo_id, count(*) AS n_questions, round(avg(len(list_intersect(truth, hits))::DOUBLE / len(truth)), 9) AS recall, round(avg(len(hits)), 9) AS files_seen FROM r GROUP BY repo_id")
def recall_report(spark: SparkSession, d: str) -> DataFrame:
    """Recall at ten of the files that define each name when it is searched, by repository."""
    return evaluate.report(_searched(spark, d))


@query(f"{_SEARCHED} SELECT round(avg(recall), 9) AS recall, count(*) AS n_repos FROM (SELECT repo_id, round(avg(len(list_intersect(truth, hits))::DOUBLE / len(truth)), 9) AS recall FROM r GROUP BY repo_id)")
def recall_overall(spark: SparkSession, d: str) -> DataFrame:
    """The mean recall over repositories, each counted once."""
    return evaluate.overall(evaluate.report(_searched(spark, d)))


@query(f"{_SEARCHED} SELECT repo_id, name, array_to_string(list_sort(list_filter(truth, lambda p: NOT list_contains(hits, p))), ' ') AS missing FROM r WHERE len(list_intersect(truth, hits)) < len(truth)")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose search misses files, and which."""
    rows = _searched(spark, d).where(F.size("missing") > 0)
    return rows.select("repo_id", F.col("question_id.name").alias("name"), F.array_join("missing", " ").alias("missing"))


@query(
    """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"""
)
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, the batch form of the progress stream (an extension)."""
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    """SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (
    SELECT *, sum(CASE WHEN p IS NULL OR date_diff('microsecond', p, ts) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, session"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user, parted by an hour of silence (an extension)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    rows = table(spark, d, "events").withColumn("new", F.when(gap <= 3_600_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


# -------------------------------------------------------- store and progress


@query(
    """SELECT coalesce(n.id, o.id) AS id, o.owner, coalesce(n.status, o.status) AS status, coalesce(n.sha, o.last_indexed_sha) AS last_indexed_sha FROM repos o FULL JOIN (
    SELECT repo_id AS id, arg_max(sha, (started_at, id)) AS sha, arg_max(status, (started_at, id)) AS status FROM index_runs WHERE repo_id IS NOT NULL AND status = 'done' GROUP BY repo_id) n ON n.id = o.id"""
)
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The repositories after the newest finished run of each."""
    repos = table(spark, d, "repos")
    done = table(spark, d, "index_runs").where("repo_id is not null and status = 'done'")
    order = F.struct("started_at", "id")
    new = done.groupBy(F.col("repo_id").alias("id")).agg(F.max_by("sha", order).alias("last_indexed_sha"), F.max_by("status", order).alias("status"))
    new = new.select("id", *[F.col(c) if c in ("last_indexed_sha", "status") else F.lit(None).cast(repos.schema[c].dataType).alias(c) for c in repos.columns if c != "id"])
    return store.merge_manifest(repos, new).select("id", "owner", "status", "last_indexed_sha")


@query(
    """SELECT d.doc_id AS id, coalesce(len(e.embedding), 0) AS dims, e.embedding IS NULL AS pending FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
)
def embed_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Documents after their vectors were filled in."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("array<float>").alias("embedding"))
    out = store.backfill(chunks, _vectors(spark, d))
    return out.select("id", F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"), F.col("embedding").isNull().alias("pending"))


@query(
    """SELECT r.repo_id, count(*) AS total, count(e.vec_id) AS done, CAST(floor(count(e.vec_id) * 100 / count(*)) AS INT) AS percent FROM documents r LEFT JOIN embeddings e ON e.vec_id = r.doc_id GROUP BY r.repo_id"""
)
def embed_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far the embedding of each repository's documents has come."""
    rows = table(spark, d, "documents").select("repo_id", F.col("doc_id").alias("id")).join(_vectors(spark, d).select("id", F.lit(1).alias("has")), "id", "left")
    by = rows.groupBy("repo_id").agg(F.count("*").alias("total"), F.count("has").alias("done"))
    return by.withColumn("percent", tx.percent(F.col("done"), F.col("total")))


@query(
    """SELECT user_id, event_id, round(date_diff('microsecond', p, ts) / 1e6, 6) AS silent_seconds FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE date_diff('microsecond', p, ts) / 1e6 > 20"""
)
def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Events that follow more than twenty seconds of silence of their user."""
    return progress.heartbeat_gaps(table(spark, d, "events"), "user_id").select("user_id", "event_id", "silent_seconds")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_stage(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each type of every user."""
    return progress.latest_stage(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT url, arg_max(status, (started_at, id)) AS state, count(*) AS n_runs, max(started_at) AS last_started FROM (SELECT DISTINCT ON (id) * FROM index_runs) GROUP BY url")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """State of every address by its latest run."""
    return progress.run_states(table(spark, d, "index_runs"))


@query(
    """SELECT id, CAST(json_extract_string(stats, '$.files') AS BIGINT) AS files, CAST(json_extract_string(stats, '$.chunks') AS BIGINT) AS chunks,
    CASE WHEN json_extract(stats, '$.ms') IS NOT NULL THEN coalesce(CAST(list_sum(list_transform(json_extract(stats, '$.ms.*'), lambda v: CAST(v AS BIGINT))) AS BIGINT), 0) END AS total_ms FROM index_runs"""
)
def stage_total(spark: SparkSession, d: str) -> DataFrame:
    """What every run counted and how long its stages took."""
    return progress.stage_totals(table(spark, d, "index_runs"))


@query(
    """SELECT event_id, 'data: ' || j || chr(10) || chr(10) AS frame, j AS payload FROM (SELECT event_id, CAST(to_json({'event_id': event_id, 'event_type': event_type, 'value': value}) AS VARCHAR) AS j FROM events)"""
)
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a frame, and what a client reads from it."""
    framed = table(spark, d, "events").select("event_id", progress.frame(F.struct("event_id", "event_type", "value")).alias("frame"))
    return framed.select("event_id", "frame", F.get(progress.frames(F.col("frame")), 0).alias("payload"))


@query(
    """SELECT repo_id, id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY id) AS INT) AS position FROM (SELECT repo_id, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL))
    QUALIFY position <= 100"""
)
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """The hundred oldest documents of every repository that lack a vector."""
    return store.pending(table(spark, d, "documents").select("repo_id", F.col("doc_id").alias("id")), _vectors(spark, d), 100)


@query(
    """SELECT r.id AS repo_id, EXISTS (SELECT 1 FROM files f WHERE f.repo_id = r.id AND f.sha = r.last_indexed_sha) AND EXISTS (SELECT 1 FROM chunks c WHERE c.repo_id = r.id AND c.sha = r.last_indexed_sha)
    AND EXISTS (SELECT 1 FROM symbols s WHERE s.repo_id = r.id AND s.sha = r.last_indexed_sha) AS complete FROM repos r"""
)
def index_complete(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last indexed commit of every repository has files, chunks and symbols."""
    return browse.complete(table(spark, d, "repos"), **{t: table(spark, d, t) for t in ("files", "chunks", "symbols")})


@query(
    """SELECT r.id, r.status, coalesce(p.pending, 0) AS pending, r.status = 'done' AND coalesce(p.pending, 0) = 0 AS finished FROM (SELECT DISTINCT ON (id) * FROM index_runs) r LEFT JOIN (
    SELECT repo_id, sha, count(*) AS pending FROM chunks WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) GROUP BY repo_id, sha) p ON p.repo_id = r.repo_id AND p.sha = r.sha"""
)
def run_pending(spark: SparkSession, d: str) -> DataFrame:
    """Every run with the chunks of its commit that lack a vector."""
    return progress.run_pending(table(spark, d, "index_runs"), table(spark, d, "chunks"), _vectors(spark, d))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step FROM events")
def step_trace(spark: SparkSession, d: str) -> DataFrame:
    """The events of every user numbered as steps."""
    return progress.steps(table(spark, d, "events"), "user_id")


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def run_usage(spark: SparkSession, d: str) -> DataFrame:
    """How many events every user has and what they add up to."""
    return progress.usage(table(spark, d, "events"), "user_id", "value")
