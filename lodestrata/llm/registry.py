"""The pN_ queries over the test tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import docpairs, mixing, origin, oversize, packing, reading, secrets, syntax
from lodestrata.llm.common import read, spread
from lodestrata.llm.tokens import source_key


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions and methods."""
    return docpairs.found(spread(read(spark, sf_dir, "chunks")))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of every documented function and method."""
    return docpairs.pair(spread(read(spark, sf_dir, "chunks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a working credential begins, in files and chunks."""
    return p2_findings(spark, sf_dir).select("origin", "row_id", "line_no").distinct()


def p2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential with its kind and place."""
    rows = secrets.texts(read(spark, sf_dir, "files"), read(spark, sf_dir, "chunks"))
    return secrets.find_credentials(spread(rows))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and hash of every text after redaction; only changed texts differ from their source."""
    rows = secrets.texts(read(spark, sf_dir, "files"), read(spark, sf_dir, "chunks"))
    return secrets.redact(spread(rows)).select(
        "origin", "row_id", "changed", F.length("content").alias("n_chars"), F.xxhash64("content").alias("content_hash")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that do not parse."""
    return syntax.found(spread(read(spark, sf_dir, "files")))


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair cost and reason of every source file."""
    return syntax.repairs(spread(read(spark, sf_dir, "files")))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files by repository and language."""
    return syntax.rates(spread(read(spark, sf_dir, "files")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split."""
    pieces = oversize.split_oversized(spread(read(spark, sf_dir, "chunks")), read(spark, sf_dir, "chunk_limits"))
    return pieces.where("piece_no = 1").select("chunk_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the chunks that had to be split."""
    return oversize.split_oversized(spread(read(spark, sf_dir, "chunks")), read(spark, sf_dir, "chunk_limits"))


def p4_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every oversized chunk put together again from the bodies of its pieces."""
    body = F.expr("substring(content, overlap_chars + 1, length(content))")
    pieces = p4_pieces(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body")))).alias("pieces"))
    return pieces.select("chunk_id", F.md5(F.array_join("pieces.body", "")).alias("content_hash"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that were not written by hand in their repository."""
    return origin.found(spread(read(spark, sf_dir, "files")), read(spark, sf_dir, "upstream_files"))


def p5_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every source file comes from, and its clusters."""
    return origin.origins(spread(read(spark, sf_dir, "files")), read(spark, sf_dir, "upstream_files"))


def p5_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many source files each combination of evidence decides."""
    return origin.evidence(spread(read(spark, sf_dir, "files")), read(spark, sf_dir, "upstream_files"))


def p5_hand_written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of hand-written source files only."""
    files = read(spark, sf_dir, "files")
    kept = p5_origins(spark, sf_dir).where("hand_written").join(files.select(F.col("id").alias("file_id"), "sha"), "file_id")
    chunks = read(spark, sf_dir, "chunks").select("id", "repo_id", "sha", "path", "symbol_kind", "start_line", "end_line")
    return chunks.join(kept.select("repo_id", "sha", "path"), ["repo_id", "sha", "path"], "left_semi").select(F.col("id").alias("chunk_id"), "repo_id", "path", "symbol_kind", "start_line", "end_line")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, for each budget."""
    return packing.pack(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "pack_budgets"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each budget are."""
    return packing.fill(p6_containers(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay below their share of a mix though used as often as allowed."""
    return _mix(spark, sf_dir).shares().where("short").select("mix_id", "source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of every source in every mix."""
    return _mix(spark, sf_dir).shares()


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes: every copy of every document taken, in random order."""
    return _mix(spark, sf_dir).rows()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose English prose is at level 5."""
    return reading.found(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "reading_labels"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    return reading.reading_levels(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "reading_labels"))


def p8_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual of every harmonic iteration."""
    return reading.convergence(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "reading_labels"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each level and their mean level, by source and repository."""
    documents = read(spark, sf_dir, "documents")
    levels = p8_levels(spark, sf_dir).groupBy("doc_id").agg(F.first("level").alias("level"), F.first("reading_level").alias("reading_level"))
    placed = documents.select("doc_id", "repo_id", source_key(F.col("source")).alias("source")).join(levels, "doc_id")
    return placed.groupBy("source", "repo_id", "level").agg(F.count("*").alias("n_docs"), F.avg("reading_level").alias("mean_level"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_findings": p2_findings,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_repairs": p3_repairs,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_joined": p4_joined,
    "p5_found": p5_found,
    "p5_origins": p5_origins,
    "p5_evidence": p5_evidence,
    "p5_hand_written_chunks": p5_hand_written_chunks,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_mix": p7_mix,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_convergence": p8_convergence,
    "p8_profile": p8_profile,
}

ORACLE_SQL = {
    "p4_found": """
        SELECT c.id AS chunk_id FROM chunks c JOIN chunk_limits l ON c.symbol_kind = l.symbol_kind
        WHERE length(c.content) > l.max_chars
    """,
    "p4_joined": """
        SELECT c.id AS chunk_id, md5(c.content) AS content_hash FROM chunks c JOIN chunk_limits l ON c.symbol_kind = l.symbol_kind
        WHERE length(c.content) > l.max_chars
    """,
}
