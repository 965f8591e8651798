"""Kinds of report files, by name and, for PDF, by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import strip

# Suffixes of the document types.
SUFFIXES = {".xlsx": "xlsx", ".xlsm": "xlsx", ".docx": "docx", ".html": "html", ".htm": "html", ".pdf": "pdf"}


def suffix(path: Column) -> Column:
    """The last suffix of the file name, in lower case; empty without one."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def detect_type(path: Column, strict: bool = True) -> Column:
    """xlsx, docx, html or pdf by suffix; other files raise an error, or are null where ``strict`` is off."""
    s = suffix(path)
    out = F.lit(None).cast("string") if not strict else F.raise_error(F.concat(F.lit("unsupported file: "), F.coalesce(path, F.lit("null")))).cast("string")
    for ext, kind in SUFFIXES.items():
        out = F.when(s == ext, kind).otherwise(out)
    return out


def pdf_types(pages: DataFrame, sample_pages: int = 3, least_chars: int = 50) -> DataFrame:
    """(doc_id, document_type): pdf_text when the first pages hold ``least_chars`` characters on average, else pdf_scan.

    ``pages`` has (doc_id, page, text); several rows of a page count together, null texts as empty.
    """
    per_page = pages.where(F.col("page") <= sample_pages).groupBy("doc_id", "page").agg(F.sum(F.length(strip(F.coalesce("text", F.lit(""))))).alias("n"))
    sampled = per_page.groupBy("doc_id").agg(F.avg("n").alias("mean"))
    docs = pages.select("doc_id").distinct()
    return docs.join(sampled, "doc_id", "left").select("doc_id", F.when(F.col("mean") >= least_chars, "pdf_text").otherwise("pdf_scan").alias("document_type"))
