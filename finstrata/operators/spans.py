"""Rule-based entity spans: positional patterns in order of priority, packed greedily without overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import METRICS
from ..functions.regex import NOT_AFTER_WORD, SPACE, WORD, positions, python_pattern

METRIC_PHRASES = tuple(sorted((m.replace("_", " ") for m in METRICS), key=len, reverse=True))
_W, _D, _S = f"[{WORD}]", r"\p{Nd}", f"[{SPACE}]"
# The patterns of the entities, in their order of priority after the metrics.
PATTERNS = (
    ("period", f"{_D}{{1,2}}\\.{_D}{{1,2}}\\.{_D}{{2,4}}"),
    ("period", f"(?:19|20){_D}{{2}}{_S}*[—–-]{_S}*(?:19|20){_D}{{2}}"),
    ("period", f"{NOT_AFTER_WORD}{_D}+{_S}*месяц{_W}*"),
    ("period", f"{NOT_AFTER_WORD}(?:{_D}+|[IVX]+){_S}*квартал{_W}*"),
    ("period", f"{NOT_AFTER_WORD}(?:19|20){_D}{{2}}{_S}*год{_W}*"),
    ("unit", f"{NOT_AFTER_WORD}(?:тысяч{_W}*|миллион{_W}*|миллиард{_W}*|тыс|млн|млрд|штук|ед)\\.?|%"),
    ("currency", f"(?iu:руб(?:лей|ля|ль|л)?\\.?|₽|RUB|USD|EUR|долл(?:ар{_W}*)?)"),
    ("amount", f"[+-]?{_D}+(?:[ \\x{{a0}}]{_D}{{3}})+(?:[.,]{_D}+)?|[+-]?{_D}+(?:[.,]{_D}+)?"),
)
SPAN = "array<struct<text:string,label:string,start_pos:int,end_pos:int>>"


_PHRASES = tuple(sorted((m.replace("_", " ") for m in METRICS), key=len, reverse=True))
_W, _D, _S = f"[{WORD}]", r"\p{Nd}", f"[{SPACE}]"
# The patterns of the entities, in their order of priority after the metrics.
PATTERNS = (
    ("period", f"{_D}{{1,2}}\\.{_D}{{1,2}}\\.{_D}{{2,4}}"),
    ("period", f"(?:19|20){_D}{{2}}{_S}*[—–-]{_S}*(?:19|20){_D}{{2}}"),
    ("period", f"{NOT_AFTER_WORD}{_D}+{_S}*месяц{_W}*"),
    ("period", f"{NOT_AFTER_WORD}(?:{_D}+|[IVX]+){_S}*квартал{_W}*"),
    ("period", f"{NOT_AFTER_WORD}(?:19|20){_D}{{2}}{_S}*год{_W}*"),
    ("unit", f"{NOT_AFTER_WORD}(?:тысяч{_W}*|миллион{_W}*|миллиард{_W}*|тыс|млн|млрд|штук|ед)\\.?|%"),
    ("currency", f"(?iu:руб(?:лей|ля|ль|л)?\\.?|₽|RUB|USD|EUR|долл(?:ар{_W}*)?)"),
    ("amount", f"[+-]?{_D}+(?:[ \\x{{a0}}]{_D}{{3}})+(?:[.,]{_D}+)?|[+-]?{_D}+(?:[.,]{_D}+)?"),
)
SPAN = "array<struct<text:string,label:string,start_pos:int,end_pos:int>>"


def _python(pattern: str) -> re.Pattern:
    """A pattern of this module for CPython, whose classes are Unicode but spelt otherwise."""
    p = pattern.replace(f"[{WORD}]", r"\w").replace(NOT_AFTER_WORD, r"(?<!\w)").replace(NOT_BEFORE_WORD, r"(?!\w)").replace(f"[{SPACE}]", r"\s")
    return re.compile(p.replace(r"\p{Nd}", r"\d").replace(r"\x{a0}", "\u00a0").replace("(?iu:", "(?i:"))


_PHRASES = [(p, re.compile(rf"(?<!\w){re.escape(p)}(?!\w)", re.I)) for p in METRIC_PHRASES]
_COMPILED = [(label, python_pattern(p)) for label, p in PATTERNS]


def spans_of(text: str) -> list[tuple[str, str, int, int]]:
    """(text, label, start, end) of one text, sorted by start and length.

    The patterns go by priority, metrics from the longest on; a match that overlaps one taken before is dropped.
    """
    taken = bytearray(len(text))
    out = []

    def scan(label: str, pattern: re.Pattern) -> None:
        found = [m.span() for m in pattern.finditer(text)]
        for a, b in found:
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b - a, label))

    low = text.lower()
    for phrase, pattern in _PHRASES:
        if phrase in low:
            scan("metric", pattern)
    for label, pattern in _COMPILED:
        scan(label, pattern)
    return [(text[a : a + n], label, a, a + n) for a, n, label in sorted(out, key=lambda x: x[:2])]


def annotate(df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """``df`` with the rule-based spans of ``text`` in ``to``; null texts have null spans, empty ones none.

    It reads text as written: in normalised text dates are no longer periods.  One Arrow pass: the eight patterns and
    nineteen phrases with their offsets take far longer as column expressions.
    """

    @F.pandas_udf(SPAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [dict(zip(("text", "label", "start_pos", "end_pos"), x, strict=True)) for x in spans_of(t)] for t in s], dtype=object)

    return df.withColumn(to, run(F.col(text)))


def pattern_spans(df: DataFrame, keys: list[str], label: str, text: str = "text") -> DataFrame:
    """``keys``, span_text, start_pos, end_pos of all matches of one label's patterns, regardless of other labels."""
    out = None
    for name, p in PATTERNS:
        if name == label:
            one = df.select(*keys, F.explode(positions(F.col(text), p)).alias("m")).select(*keys, F.col("m.text").alias("span_text"), "m.start_pos", "m.end_pos")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(label)
    return out
