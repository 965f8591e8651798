"""Chunks of cleaned sections: titles anchor, long texts are sliced with overlap, pieces are packed greedily."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import once, strip, words


def overlap_words(max_words: int, ratio: float) -> int:
    """max(1, ratio of the limit, rounded half to even)."""
    return max(1, round(max_words * ratio))


def slices(text: Column, max_words: int, overlap: int) -> Column:
    """ARRAY<STRUCT<piece, n>>: the text itself when it is within the limit, else overlapping runs of its words."""
    step = max_words - overlap
    if step <= 0:
        raise ValueError("the limit must exceed the overlap")
    back = min(overlap, step)

    def run(ws: Column, i: Column) -> Column:
        first = F.greatest(i - back, F.lit(0))
        return F.slice(ws, first + 1, i + step - first)

    def cut(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(step)), lambda i: once(run(ws, i), lambda w: F.struct(F.array_join(w, " ").alias("piece"), F.size(w).alias("n"))))
        return F.when(F.size(ws) <= max_words, F.array(F.struct(text.alias("piece"), F.size(ws).alias("n")))).otherwise(many)

    return once(words(text), cut)


def slice_sections(df: DataFrame, max_words: int = 150, overlap_ratio: float = 0.05) -> DataFrame:
    """(doc_id, section_idx, slice_no, piece, n_words) of the sections with text."""
    s = slices(F.col("text"), max_words, overlap_words(max_words, overlap_ratio))
    src = df.where(F.length(strip(F.col("text"))) > 0)
    return src.select("doc_id", "section_idx", F.posexplode(s).alias("slice_no", "s")).select("doc_id", "section_idx", "slice_no", F.col("s.piece").alias("piece"), F.col("s.n").cast("int").alias("n_words"))


def packages(counts: list[int], max_words: int) -> list[int]:
    """The number of the package of every piece, filled in order up to ``max_words``."""
    out, words, number = [], 0, 0
    for n in counts:
        if out and words + n > max_words:
            words, number = 0, number + 1
        words += n
        out.append(number)
    return out


def pack(counts: Column, max_words: int) -> Column:
    """ARRAY<INT>: :func:`packages` of an array of word counts, in one Arrow pass."""

    @F.arrow_udf("array<int>")
    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else packages(x, max_words) for x in lists.to_pylist()], pa.list_(pa.int32()))

    return packed(counts)


def chunk_sections(df: DataFrame, max_words: int = 150, overlap_ratio: float = 0.05) -> DataFrame:
    """(doc_id, chunk_id, text, section_anchor, page): sections in order of ``section_idx``, grouped under titles, packed up to the limit.

    A title begins a new chunk, gives it its anchor and page, and is its first piece.  Before the first title the
    anchor is null and the page 1.  Blank texts are skipped.  ``chunk_id`` counts from 1 in a document.  What is
    gathered at a time is the pieces under one title.
    """
    order = W.partitionBy("doc_id").orderBy("section_idx")
    src = df.where(F.length(strip(F.col("text"))) > 0).withColumn("__title", F.coalesce(F.col("block_type") == "title", F.lit(False)))
    src = src.withColumn("__group", F.sum(F.col("__title").cast("int")).over(order))
    s = slices(F.col("text"), max_words, overlap_words(max_words, overlap_ratio))
    pieces = src.select("doc_id", "section_idx", "__group", "__title", "page", "text", F.posexplode(s).alias("slice_no", "s"))
    first_title = F.min(F.when(F.col("__title"), F.struct("section_idx", "slice_no", "text", "page")))
    groups = pieces.groupBy("doc_id", "__group").agg(
        F.array_sort(F.collect_list(F.struct("section_idx", "slice_no", F.col("s.piece").alias("piece"), F.col("s.n").alias("n")))).alias("p"), first_title.alias("t"),
    )
    groups = groups.withColumn("g", pack(F.transform("p", lambda x: x["n"].cast("int")), max_words))
    packed = groups.select("doc_id", "__group", "t", F.explode(F.arrays_zip("p", "g")).alias("x"))
    chunks = packed.groupBy("doc_id", "__group", F.col("x.g").alias("__pack")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.p.section_idx", "x.p.slice_no", "x.p.piece"))), lambda x: x["piece"]), "\n").alias("text"),
        F.first("t.text").alias("section_anchor"), F.coalesce(F.first("t.page"), F.lit(1)).cast("int").alias("page"),
    )
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("__group", "__pack"))
    return chunks.select("doc_id", number.alias("chunk_id"), "text", "section_anchor", "page")


def document_texts(df: DataFrame) -> DataFrame:
    """(doc_id, normalized_text): the non-empty section texts in order, joined by line breaks."""
    parts = F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("section_idx", "text"))))
    return df.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("normalized_text"))


def document_metadata(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, source, chunk_count): the count is text; documents without chunks have 0."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id", F.col("filename").alias("source")).join(n, "doc_id", "left").select("doc_id", "source", F.coalesce("n", F.lit(0)).cast("string").alias("chunk_count"))
