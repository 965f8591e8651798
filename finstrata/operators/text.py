"""Text normalisation of financial reports, and the small text rules of parsers.

All steps are column expressions but the first, NFKC, which Spark lacks.  The order of the steps is part of the
result.  Null texts stay null and empty ones empty in every function here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, strip

CYRILLIC = "а-яёА-ЯЁ"
# Latin letters taken for Cyrillic ones.
LOOKALIKES = {"a": "а", "c": "с", "e": "е", "k": "к", "o": "о", "p": "р", "x": "х"}


def nfkc(c: Column) -> Column:
    """Compatibility composition (Arrow batches; texts already in the form are passed through)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in s], dtype=object)

    return run(c)


def drop_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("­"), F.lit(""))


def join_line_hyphens(c: Column) -> Column:
    """A hyphen between Cyrillic letters at a line break goes, with the break."""
    return F.regexp_replace(c, f"(?<=[{CYRILLIC}])-[{SPACE}]*\\n[{SPACE}]*(?=[{CYRILLIC}])", "")


def replace_yo(c: Column) -> Column:
    return F.translate(c, "ёЁ", "еЕ")


def unify_dashes(c: Column) -> Column:
    """Four dashes become ``-``; U+2010, which NFKC makes of the non-breaking hyphen, is not among them."""
    return F.translate(c, "—–−‑", "----")


def _marked(c: Column, pattern: str, letters: dict[str, str]) -> Column:
    """One expression finds and marks the letters, plain replacements then change the marked ones (mark: U+E002)."""
    out = F.regexp_replace(c, pattern, "\ue002$1")
    for latin, cyrillic in letters.items():
        out = F.replace(out, F.lit("\ue002" + latin), F.lit(cyrillic))
    return out


def fix_embedded_lookalikes(c: Column) -> Column:
    """A single small Latin look-alike between small Cyrillic letters becomes Cyrillic; runs of Latin letters stay."""
    return _marked(c, "(?<=[а-яё])([%s])(?=[а-яё])" % "".join(LOOKALIKES), LOOKALIKES)


def fix_initial_lookalikes(c: Column) -> Column:
    """Latin c and o at the beginning of a word that goes on in two Cyrillic letters become Cyrillic."""
    return _marked(c, f"{NOT_AFTER_WORD}([coCO])(?=[{CYRILLIC}]{{2}})", {"c": "с", "o": "о", "C": "С", "O": "О"})


def join_digit_groups(c: Column) -> Column:
    """Whitespace between digits goes, line breaks included."""
    return F.regexp_replace(c, f"(?<=\\p{{Nd}})[{SPACE}]+(?=\\p{{Nd}})", "")


def decimal_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\p{Nd}),(?=\p{Nd})", ".")


def iso_dates(c: Column) -> Column:
    """d.m.yyyy, d/m/yyyy and d-m-yyyy become yyyy-mm-dd, without a check of the calendar."""
    # between private-use marks, so that what is written anew is not matched again
    marked = F.regexp_replace(c, f"{NOT_AFTER_WORD}(\\p{{Nd}}{{1,2}})[./-](\\p{{Nd}}{{1,2}})[./-](\\p{{Nd}}{{4}}){NOT_BEFORE_WORD}", "$3-0$2-0$1")
    return F.regexp_replace(marked, "(\\p{Nd}{4})-0?(\\p{Nd}{2})-0?(\\p{Nd}{2})", "$1-$2-$3")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


STEPS = (drop_soft_hyphens, join_line_hyphens, replace_yo, unify_dashes, fix_embedded_lookalikes, fix_initial_lookalikes, join_digit_groups, decimal_commas, iso_dates, collapse_spaces)


def normalize_composed(c: Column) -> Column:
    """The ten steps after NFKC, in order."""
    for step in STEPS:
        c = step(c)
    return c


def normalize(c: Column) -> Column:
    """The whole normalisation."""
    return normalize_composed(nfkc(c))


def rows_to_text(rows: Column) -> Column:
    """The cells of a table joined by `` | ``, rows too; null rows and cells count as empty, null tables as empty text."""
    joined = F.transform(rows, lambda r: F.array_join(F.coalesce(r, F.array().cast("array<string>")), " | ", ""))
    return F.coalesce(F.array_join(joined, " | "), F.lit(""))


def looks_like_title(c: Column) -> Column:
    """1 to 120 characters after stripping, on one line, without sentence punctuation; false for null."""
    s = strip(c)
    return F.coalesce(F.length(s).between(1, 120) & ~s.rlike(r"[\n.!?:,;]"), F.lit(False))


def classify_block(text: Column, y_top: Column, y_bottom: Column, header: float = 0.05, footer: float = 0.95) -> Column:
    """header, footer, title or paragraph, in this order of precedence; unknown places are neither header nor footer."""
    return F.when(y_top < header, "header").when(y_bottom > footer, "footer").when(looks_like_title(text), "title").otherwise("paragraph")


def ocr_language(lang: Column) -> Column:
    """The recogniser's languages: English is added unless it is named already."""
    return F.when(lang.contains("eng"), lang).otherwise(F.concat(lang, F.lit("+eng")))
