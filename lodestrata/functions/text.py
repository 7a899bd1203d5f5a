"""Lines, words, paths and citations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a lexical query, as the search they serve is defined.
STOPWORDS = (
    "a an the and or but if then than that this these those of in on at to for from by with without into over under is are was were be been being do does did doing "
    "have has had having how what when where which who whom why can could should would will shall may might must it its as i you we they them their there here about "
    "across after against all also any because before between both during each few more most other our out same some such through up down very work works working use "
    "used using get gets getting make makes made does like"
).split()
# Languages by file extension.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}
CITATION = r"\b([\w./\-]+):(\d+)(?:-(\d+))?\b"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lines(text: Column) -> Column:
    """The lines of a text; no last empty line, none at all for an empty text."""
    parts = F.split(text, _LINE_END)
    ended = F.element_at(parts, -1) == ""
    return F.when(ended, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; repeated words stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_words(question: Column) -> Column:
    """Words of a question longer than one letter without stop words; all of them if only stop words remain."""
    every = F.filter(words(question), lambda w: F.length(w) > 1)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    kept = F.filter(every, lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    """Number of components of a path."""
    return F.size(F.split(path, "/"))


def language(path: Column) -> Column:
    """Language of a path by its suffix; null for other suffixes and for names that are nothing but a suffix."""
    suffix = F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        out = F.when(suffix == ext, name).otherwise(out)
    return out


def citations(text: Column) -> Column:
    """array<struct<path, first, last, ref>> of the path:line and path:first-last references in a text, in order; ref is how it is written."""
    rx = F.lit(CITATION)
    parts = F.arrays_zip(
        F.regexp_extract_all(text, rx, F.lit(1)).alias("path"), F.regexp_extract_all(text, rx, F.lit(2)).alias("first"), F.regexp_extract_all(text, rx, F.lit(3)).alias("last"),
        F.regexp_extract_all(text, rx, F.lit(0)).alias("ref"),
    )
    return F.transform(
        parts,
        lambda c: F.struct(
            c["path"].alias("path"), c["first"].try_cast("long").alias("first"), F.coalesce(F.when(c["last"] != "", c["last"]).try_cast("long"), c["first"].try_cast("long")).alias("last"), c["ref"].alias("ref")
        ),
    )


def snippet(text: Column, n: int = 6) -> Column:
    """The first n lines."""
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def embedding_text(path: Column, first: Column, last: Column, content: Column) -> Column:
    """What is embedded for a chunk: its place, then its text."""
    return F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n"), content)


def percent(done: Column, total: Column) -> Column:
    """Whole percent done; 100 when there is nothing to do."""
    return F.when(total == 0, F.lit(100)).otherwise(F.floor(done * 100 / F.nullif(total, F.lit(0)))).cast("int")
