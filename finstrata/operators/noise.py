"""Removal of noise sections: by place, by block type, by pattern, by repetition over pages.

Each filter sees the survivors of the one before.  Sections need (doc_id, section_idx) and the columns named in the
functions; null places are kept, null texts match no pattern, null block types are no header, paragraph or footer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NOISE_PATTERNS
from ..functions.regex import SPACE
from ..session import cut
from .text import nfkc, normalize_composed, rows_to_text


def drop_by_geometry(df: DataFrame, header: float = 0.05, footer: float = 0.95) -> DataFrame:
    """Sections in the header or footer zone go; one without both places stays."""
    noise = F.col("y_top").isNotNull() & F.col("y_bottom").isNotNull() & ((F.col("y_top") < header) | (F.col("y_bottom") > footer))
    return df.where(~noise)


def drop_headers_footers(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("block_type").isin("header", "footer"), F.lit(False)))


def noise_regex(patterns: tuple[str, ...] = ()) -> str:
    """One case-blind alternation; no patterns mean the default ones."""
    spelt = [p.replace(r"[:\s]", f"[:{SPACE}]").replace(r"\s", f"[{SPACE}]").replace(r"\d", r"\p{Nd}") for p in patterns or NOISE_PATTERNS]
    return "(?iu)" + "|".join(f"(?:{p})" for p in spelt)


def matches_noise(c: Column, patterns: tuple[str, ...] = ()) -> Column:
    return F.coalesce(c.rlike(noise_regex(patterns)), F.lit(False))


def drop_patterns(df: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    return df.where(~matches_noise(F.col("text"), patterns))


def drop_repeating(df: DataFrame, ratio: float = 0.7) -> DataFrame:
    """All copies of a paragraph text that a document holds at least max(2, ratio of its pages, rounded to even) times.

    Counts are made by aggregation and joined back, so a document of any size is never held in one task.
    """
    pages = df.groupBy("doc_id").agg(F.greatest(F.lit(2), F.bround(F.coalesce(F.max("page"), F.lit(1)) * F.lit(float(ratio)))).alias("__least"))
    counts = df.where(F.col("block_type") == "paragraph").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("__t")).agg(F.count("*").alias("__n"))
    repeated = counts.where("__n >= 2").join(pages, "doc_id").where("__n >= __least").select(F.col("doc_id").alias("__d"), "__t", F.lit("paragraph").alias("__b"))
    on = (F.col("doc_id") == F.col("__d")) & (F.coalesce("text", F.lit("")) == F.col("__t")) & (F.col("block_type") == F.col("__b"))
    return df.join(repeated, on, "left_anti")


def remove_noise(df: DataFrame, patterns: tuple[str, ...] = (), ratio: float = 0.7, header: float = 0.05, footer: float = 0.95) -> DataFrame:
    """All four filters in their order.  The survivors of the first three are written once, as the last reads them three times."""
    return drop_repeating(cut(drop_patterns(drop_headers_footers(drop_by_geometry(df, header, footer)), patterns)), ratio)


def normalize_sections(df: DataFrame, composed: bool = False) -> DataFrame:
    """Sections with normalised text and cells; the text of a table with rows is built anew from its cells.

    Null texts become empty.  ``composed`` says that the text is in NFKC already, which keeps the work in the JVM.
    A table's cells go through NFKC as one string, packed with private-use separators that it leaves alone.
    """
    row_sep, cell_sep = "\ue010", "\ue011"
    cells = F.col("cell_rows")
    if not composed:
        packed = F.array_join(F.transform(cells, lambda r: F.array_join(F.coalesce(r, F.array().cast("array<string>")), cell_sep, "")), row_sep)
        df = df.withColumn("__packed", nfkc(packed)).withColumn("__text", nfkc(F.col("text")))
        cells = F.transform(F.split("__packed", row_sep), lambda r: F.split(r, cell_sep))
    else:
        df = df.withColumn("__text", F.col("text"))
    filled = F.size("cell_rows") > 0
    df = df.withColumn("cell_rows", F.when(filled, F.transform(cells, lambda r: F.transform(r, lambda c: normalize_composed(F.coalesce(c, F.lit("")))))).otherwise(F.col("cell_rows")))
    rebuilt = (F.col("block_type") == "table") & (F.size("cell_rows") > 0)
    out = df.withColumn("text", F.when(rebuilt, rows_to_text(F.col("cell_rows"))).otherwise(F.coalesce(normalize_composed(F.col("__text")), F.lit(""))))
    return out.drop("__text", "__packed")
