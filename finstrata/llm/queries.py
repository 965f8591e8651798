"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canon, cosine_join, leak, quality, scans, splitter, tokenize


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(table(spark, sf_dir, "sections"), table(spark, sf_dir, "parsed_documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines of scanned pages and the kinds of their noise."""
    return _noise(spark, sf_dir).select("doc_id", "section_idx", "line_no", "noise_kind").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned sections as continuous paragraphs."""
    return scans.repair_scans(table(spark, sf_dir, "sections"), _noise(spark, sf_dir), documents=table(spark, sf_dir, "parsed_documents"))


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned document's text as continuous paragraphs, in place of its raw_text."""
    docs = table(spark, sf_dir, "parsed_documents")
    pages = scans.with_raw_texts(table(spark, sf_dir, "sections"), docs)
    return scans.repair_documents(pages, scans.scan_noise(pages, docs), docs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that look the same and differ in characters."""
    return canon.look_alike_pairs(table(spark, sf_dir, "annotated_chunks"))


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have look-alikes, with their class."""
    return canon.look_alike_rows(table(spark, sf_dir, "annotated_chunks"))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text and span texts in canonical form."""
    df = table(spark, sf_dir, "annotated_chunks").dropDuplicates(["chunk_key"])
    return canon.canonicalize_spans(canon.canonicalize(df)).select("chunk_key", "canonical_text", F.to_json("canonical_spans").alias("canonical_spans"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training chunk and a validation or test chunk with the same or nearly the same text."""
    t, e = F.col("chunk_key_train"), F.col("chunk_key_eval")
    return cosine_join.cross_split_overlaps(table(spark, sf_dir, "annotated_chunks")).select(F.least(t, e).alias("chunk_key_a"), F.greatest(t, e).alias("chunk_key_b"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with training per split and source."""
    return cosine_join.overlap_counts(table(spark, sf_dir, "annotated_chunks"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that overlaps with the other side, with its class and its links."""
    found = cosine_join.linked_classes(table(spark, sf_dir, "annotated_chunks"), group="source")
    return cosine_join.overlap_rows(found).withColumnsRenamed({"key": "chunk_key", "group": "source"}).drop("train")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk."""
    return splitter.split_oversized(table(spark, sf_dir, "chunks").dropDuplicates(["doc_id", "chunk_id"])).select("doc_id", "chunk_id", "piece_no", "n_pieces", "section_anchor", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are cut for their number of words."""
    pieces = splitter.split_oversized(table(spark, sf_dir, "chunks").select("doc_id", "chunk_id", "text"))
    return pieces.where("n_pieces > 1 and n_words > 128").select("doc_id", "chunk_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokenize.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of evaluation items, and the items."""
    return leak.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and kind."""
    return quality.describe_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def p9_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain ratios of every document."""
    return p9_statistics(spark, sf_dir).select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly no natural prose."""
    return p9_statistics(spark, sf_dir).where("text_kind <> 'prose'").select("doc_id", "text_kind").distinct()


QUERIES = {q.__name__: q for q in (p1_found, p1_repaired, p1_documents, p4_found, p4_rows, p4_canonical, p5_found, p5_counts, p5_rows, p6_found, p6_pieces, p7_ids, p8_found, p9_found, p9_statistics, p9_ratios)}

_SPACES = r"\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}"
_COMMON = ", ".join(f"'{w}'" for w in sorted(quality.COMMON_WORDS))

ORACLES = {
    "p9_ratios": rf"""
        WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_SPACES}]+') AS w, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS p,
            list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^{_SPACES}]')) AS l FROM documents),
        s AS (SELECT *, list_sum(list_transform(w, lambda x: length(x))) AS solid FROM t WHERE len(w) > 0)
        SELECT d.doc_id, len(w)::BIGINT AS word_count, round(solid / len(w), 6) AS mean_word_length, round((solid - coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)) / solid, 6) AS symbol_ratio,
            round(len(list_filter(l, lambda s: regexp_matches(s, '[.!?…:;»"”)][{_SPACES}]*$'))) / len(l), 6) AS punct_line_share,
            round(len(list_filter(p, lambda x: x IN ({_COMMON}))) / greatest(1, len(p)), 6) AS common_word_share
        FROM documents d LEFT JOIN s USING (doc_id)""",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        ds AS (SELECT doc_id, array_to_string(w[k : k + 17], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 16)) AS k FROM d)),
        its AS (SELECT item_id, array_to_string(w[k : k + 17], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 16)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM ds JOIN its USING (g)""",
    "p6_found": r"""
        SELECT DISTINCT doc_id, chunk_id FROM chunks
        WHERE len(regexp_extract_all(text, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}]+')) > 128""",
}
