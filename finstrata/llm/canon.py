"""One consistent form for text that looks the same but differs in its characters.

Only unstable stretches are touched: code points that fail a quick check (invisible, wide, non-breaking, not composed)
are taken together with the base letter before and the marks after them, normalised, and spliced back between the
unchanged parts.  Look-alike letters of other scripts are then settled word by word.  What looks different stays
different: case, line breaks, superscripts, ``ё`` and dashes of different lengths are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters of three scripts that have the same shape.
_LATIN = "ABCEHIJKMOPSTXYaceijopsxy"
_CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕху"
_GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v"}
_TO_CYRILLIC = dict(zip(_LATIN, _CYRILLIC, strict=True)) | {g: dict(zip(_LATIN, _CYRILLIC, strict=True))[x] for g, x in _GREEK.items() if x in _LATIN}
_TO_LATIN = dict(zip(_CYRILLIC, _LATIN, strict=True)) | _GREEK
_CYR_TABLE, _LAT_TABLE = str.maketrans(_TO_CYRILLIC), str.maketrans(_TO_LATIN)
# Further characters drawn alike.
_SAME = {"‐": "-", "‑": "-", "ʼ": "’", "…": "...", "\r": "\n", "\v": "\n", "\f": "\n", "\x85": "\n", " ": "\n", " ": "\n", "\t": " "}

# Letters that one script alone has; I, J and S count as Latin, as Russian has no such letters.
_NOT_RUSSIAN = "IJSijsІЈЅіјѕΙ"
_OWN_CYRILLIC = re.compile("[%s]+" % "".join(chr(c) for c in range(0x400, 0x530) if chr(c).isalpha() and chr(c) not in _TO_LATIN))
_OWN_LATIN = re.compile("[%s]+" % "".join(c for c in map(chr, range(0x41, 0x530)) if c in _NOT_RUSSIAN or c.isalpha() and ord(c) < 0x250 and c not in _TO_CYRILLIC))
_IN_CYR_TEXT, _IN_LAT_TEXT = re.compile("[A-Za-zͰ-Ͽ]+"), re.compile("[Ѐ-ԯͰ-Ͽ]+")


def _count(pattern: re.Pattern, text: str, most: int = 1 << 60) -> int:
    """The characters of ``text`` in runs of ``pattern``; counting ends once there are ``most``."""
    n = 0
    for m in pattern.finditer(text):
        n += m.end() - m.start()
        if n >= most:
            break
    return n


#: Runs outside the commonest stable characters; only these are checked closely.
_SUSPECT = re.compile("[^ -~\nА-яЁё«»—–₽№]+")
_BLANKS = re.compile(" *\n *|  +")


def _invisible(ch: str) -> bool:
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or cp == 0x34F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x115F <= cp <= 0x1160 or cp == 0x3164 or (unicodedata.category(ch) == "Cc" and ch not in "\n\t\r\v\f\x85")


@lru_cache(maxsize=1)
def _tables() -> tuple[re.Pattern, dict[int, str]]:
    """The pattern of unstable segments, and what their code points become before they are composed."""
    single: dict[int, str] = {ord(k): v for k, v in _SAME.items()}
    unstable: list[int] = list(single)
    marks: list[int] = []
    for cp in range(0x80, 0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp < 0xE0000 or cp >= 0xF0000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if _invisible(ch):
            single[cp] = ""
            unstable.append(cp)
        elif cat == "Zs":
            single[cp] = " "
            unstable.append(cp)
        elif cat in ("Mn", "Mc"):
            marks.append(cp)
        elif cp not in single:
            kind = unicodedata.decomposition(ch).partition(" ")[0]
            if kind in ("<wide>", "<narrow>") or 0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06:
                single[cp] = unicodedata.normalize("NFKC", ch)
                unstable.append(cp)
            elif not unicodedata.is_normalized("NFC", ch) or 0x1100 <= cp <= 0x11FF:
                unstable.append(cp)
    for cp in [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]:
        single[cp] = ""
        unstable.append(cp)

    def ranges(cps: list[int]) -> str:
        out, cps = [], sorted(set(cps))
        i = 0
        while i < len(cps):
            j = i
            while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
                j += 1
            out.append(re.escape(chr(cps[i])) + (f"-{re.escape(chr(cps[j]))}" if j > i else ""))
            i = j + 1
        return "".join(out)

    bad = ranges(unstable + marks)
    return re.compile(f"[{bad}]+"), single


def _settle(text: str) -> str:
    """Words that mix scripts, or that stand in a text of the other script, in one script.

    A word goes by its letters that only one script has, a word without such by the text.  Both depend on looks alone,
    so two texts that look the same settle to the same characters.  Only words with letters foreign to the text are looked at.
    """
    latin = _count(_OWN_LATIN, text) if _IN_CYR_TEXT.search(text) else 0
    cyrillic = bool(_OWN_CYRILLIC.search(text)) and (not latin or _count(_OWN_CYRILLIC, text, latin) >= latin)
    out, at = [], 0
    for m in (_IN_CYR_TEXT if cyrillic else _IN_LAT_TEXT).finditer(text):
        a, b = m.span()
        if b <= at:
            continue
        while a > at and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        w = text[a:b]
        c, n = _count(_OWN_CYRILLIC, w), _count(_OWN_LATIN, w)
        out += (text[at:a], w.translate(_CYR_TABLE if c > n or c == n and cyrillic else _LAT_TABLE))
        at = b
    return "".join(out) + text[at:] if out else text


def canonical(text: str | None) -> str | None:
    """The canonical form of ``text``: the same string for all texts that look the same; null stays null."""
    if not text:
        return text
    if not text.isascii() or not text.isprintable():
        unstable, single = _tables()
        text = text.replace("\r\n", "\n")
        out, at = [], 0
        for m in (u for run in _SUSPECT.finditer(text) for u in unstable.finditer(text, run.start(), run.end())):
            start = max(m.start() - 1, at)  # with the base character before
            out += (text[at:start], unicodedata.normalize("NFC", text[start : m.end()].translate(single)))
            at = m.end()
        if at:
            text = "".join(out) + text[at:]
            if not unicodedata.is_normalized("NFC", text):  # parts brought together by what was removed between them
                text = unicodedata.normalize("NFC", text)
        text = _settle(text)
        for _ in range(3):  # a settled letter may compose with the mark after it
            if unicodedata.is_normalized("NFC", text):
                break
            text = _settle(unicodedata.normalize("NFC", text))
    if "  " in text or " \n" in text or "\n " in text:
        text = _BLANKS.sub(lambda m: "\n" * m[0].count("\n") or " ", text)
    return text.strip(" ")


def canonical_column(col: Column) -> Column:
    """:func:`canonical` of a string column, in Arrow batches."""

    @F.pandas_udf("string")
    def canon(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([canonical(t) for t in s], dtype=object)

    return canon.asNondeterministic()(col)  # else a filter of the result would run it twice


def canonicalize(df: DataFrame, text: str = "text", to: str = "canonical_text") -> DataFrame:
    """``df`` with the canonical form of ``text`` in ``to`` (replaced if there).  Null stays null, empty stays empty."""
    return df.withColumn(to, canonical_column(F.col(text)))


def canonicalize_spans(df: DataFrame, spans: str = "spans", to: str = "canonical_spans") -> DataFrame:
    """``df`` with the ``text`` of every struct of the array ``spans`` in canonical form; nulls stay null.

    All the strings of an array cross to Python as one joined column, so a row costs one transfer.
    """

    @F.pandas_udf("array<string>")
    def canon(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if a is None else [canonical(t) for t in a] for a in s], dtype=object)

    fields = [f.name for f in df.schema[spans].dataType.elementType.fields]
    rebuilt = ", ".join(f"'{f}', " + (f"__canon[i]" if f == "text" else f"s.`{f}`") for f in fields)
    texts = F.transform(F.col(spans), lambda s: s["text"])
    out = df.withColumn("__canon", canon(texts))
    return out.withColumn(to, F.expr(f"transform(`{spans}`, (s, i) -> if(s is null, null, named_struct({rebuilt})))")).drop("__canon")


def _looks(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, look, form): hashes of the canonical form and of the text of every row of at least ``min_words`` words, written once."""
    src = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    canon = canonicalize(src, "__text", "__canon").where(F.size(F.filter(F.split("__canon", r"(?U)\s+"), lambda w: w != "")) >= min_words)
    return cut(canon.select("__key", F.unhex(F.md5("__canon")).alias("look"), F.unhex(F.md5("__text")).alias("form")).distinct())  # 40 bytes a row, read several times


def look_alike_rows(df: DataFrame, key: str = "chunk_key", text: str = "text", min_words: int = 8) -> DataFrame:
    """(<key>, class_id, form_id, n_forms, n_partners): every row whose text has a look-alike, with its class, in place of pairs.

    ``n_forms`` is the number of different texts of the class, ``n_partners`` that of the rows with another text of it.
    Nulls and short texts give nothing; repeated rows count once.
    """
    rows = _looks(df, key, text, min_words)
    forms = rows.groupBy("look", "form").agg(F.countDistinct("__key").alias("n"))
    looks = forms.groupBy("look").agg(F.count("*").alias("n_forms"), F.sum("n").alias("all")).where("n_forms > 1")
    partners = forms.join(looks, "look").select("look", "form", "n_forms", (F.col("all") - F.col("n")).alias("n_partners"))
    return rows.join(partners, ["look", "form"]).select(F.col("__key").alias(key), F.hex("look").alias("class_id"), F.hex("form").alias("form_id"), "n_forms", "n_partners")


def look_alike_pairs(df: DataFrame, key: str = "chunk_key", text: str = "text", min_words: int = 8) -> DataFrame:
    """Distinct pairs (``<key>_a`` < ``<key>_b``) of texts that look the same and differ in some code point.

    Groups by the canonical form's hash keep one row per distinct text; pairs are made between texts and only then
    joined to their rows, so a group of exact copies, however large, pairs with nothing.  Null texts and texts of
    fewer than ``min_words`` words give nothing.
    """
    rows = _looks(df, key, text, min_words)
    forms = rows.groupBy("look", "form").agg(F.lit(1).alias("one"))
    several = forms.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    forms = forms.join(several, "look", "left_semi").select("look", "form")
    pairs = forms.withColumnRenamed("form", "form_a").join(forms.withColumnRenamed("form", "form_b"), "look").where("form_a < form_b").select("look", "form_a", "form_b")
    a = rows.select("look", F.col("form").alias("form_a"), F.col("__key").alias("ka"))
    b = rows.select("look", F.col("form").alias("form_b"), F.col("__key").alias("kb"))
    out = pairs.join(a, ["look", "form_a"]).join(b, ["look", "form_b"])
    return out.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).where(F.col(f"{key}_a") != F.col(f"{key}_b")).distinct()
