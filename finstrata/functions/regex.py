r"""Regular expressions with Unicode meaning, the same in every dialect.

``\w``, ``\b`` and ``\s`` differ between engines, so patterns here spell their classes out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode whitespace, with the separators U+001C to U+001F.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
NOT_AFTER_WORD, NOT_BEFORE_WORD = f"(?<![{WORD}])", f"(?![{WORD}])"


def strip(c: Column) -> Column:
    """``c`` without whitespace at its ends, of any kind."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(c: Column) -> Column:
    """The runs of ``c`` without whitespace; none for an empty text, null for null."""
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once a row however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def python_pattern(pattern: str) -> re.Pattern:
    """A pattern spelt with the classes of this module for CPython, whose own classes are Unicode."""
    p = pattern.replace(f"[^{SPACE}]", r"\S").replace(f"[{SPACE}]", r"\s").replace(f"[{WORD}]", r"\w").replace(NOT_AFTER_WORD, r"(?<!\w)").replace(NOT_BEFORE_WORD, r"(?!\w)")
    return re.compile(p.replace(r"\p{Nd}", r"\d").replace(r"\x{a0}", "\u00a0").replace("(?iu:", "(?i:"))


def positions(c: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<text, start_pos, end_pos>> of the non-overlapping matches, half-open, in code points; null for null.

    One Arrow pass, linear in the text: a fold over column expressions would copy its list at every match.
    """
    compiled = python_pattern(pattern)

    @F.arrow_udf("array<struct<text:string,start_pos:int,end_pos:int>>")
    def found(texts: pa.Array) -> pa.Array:
        hits, starts, ends, offsets = [], [], [], [0]
        for t in texts.to_pylist():
            for m in compiled.finditer(t or ""):
                a, b = m.span()
                hits.append(m[0])
                starts.append(a)
                ends.append(b)
            offsets.append(len(hits))
        parts = pa.StructArray.from_arrays([pa.array(hits, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["text", "start_pos", "end_pos"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts, mask=texts.is_null())

    return found(c)
