"""Oversized texts cut into pieces at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece: 64 a word of the usual limit.
MAX_CHARS = 8192
_WORD = re.compile(r"\S+")
_SECTION = re.compile(r"\n[^\S\n]*\n[^\S\n]*\n+|\f|\n(?=#{1,6} )")
_PARAGRAPH = re.compile(r"\n")
_SENTENCE_END = re.compile(r"[.!?…]+[»”\"')\]]*$")


def _levels(text: str, words: list[tuple[int, int]]) -> list[list[int]]:
    """For section, paragraph and sentence: the sorted indices of the words that may begin a piece there."""
    starts = [s for s, _ in words]

    def after(pattern: re.Pattern) -> list[int]:
        found = {bisect_right(starts, m.end() - 1) for m in pattern.finditer(text)}
        return sorted(i for i in found if 0 < i < len(words))

    sentence = [i for i in range(1, len(words)) if _SENTENCE_END.search(text[words[i - 1][0] : words[i - 1][1]]) and not text[words[i][0]].islower()]
    return [after(_SECTION), after(_PARAGRAPH), sentence]


def _cut_long_words(words: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The last level: a word longer than ``most`` characters counts as several."""
    if all(e - s <= most for s, e in words):
        return words
    return [(i, min(i + most, e)) for s, e in words for i in range(s, e, most)]


def _chosen(a: int, b: int, level: int, cuts: list[list[int]], fits: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Stretches of the words a..b that fit, cut by the coarsest separators that do."""
    if fits(a, b):
        return [(a, b)]
    if level == len(cuts):
        out = []
        for i in range(a + 1, b + 1):
            if i == b or not fits(a, i + 1):
                out.append((a, i))
                a = i
        return out
    inner = cuts[level][bisect_right(cuts[level], a) : bisect_right(cuts[level], b - 1)]
    edges = [a, *inner, b]
    return [part for s, e in zip(edges, edges[1:], strict=False) for part in _chosen(s, e, level + 1, cuts, fits)]


def split_text(text: str | None, max_words: int = 128, overlap: int = 6, max_chars: int | None = MAX_CHARS) -> list[tuple[int, int]]:
    """Half-open code-point ranges of the pieces of ``text``, none of more than ``max_words`` words or ``max_chars`` characters.

    A text within both limits is one piece, the whole of it.  Else stretches, found by the hierarchy section, paragraph,
    sentence, word, character, are packed greedily up to the limits; each piece after the first begins with the last
    ``overlap`` words of the one before, which count towards its limits, or with as many of them as leave room for the
    next stretch in ``max_chars``.  A word longer than half of ``max_chars`` is cut and counts as several.  None for
    ``max_chars`` sets no bound on characters.
    """
    if not 0 <= overlap < max_words or max_chars is not None and max_chars < 2:
        raise ValueError("0 <= overlap < max_words and max_chars >= 2 are needed")
    if not text:
        return []
    most = max_chars or len(text)
    words = [m.span() for m in _WORD.finditer(text)]
    if len(words) <= max_words and len(text) <= most:
        return [(0, len(text))]
    if not words:
        return [(i, min(i + most, len(text))) for i in range(0, len(text), most)]
    half = max(1, most // 2) if max_chars else most
    words = _cut_long_words(words, half)
    room = max_words - overlap
    parts = _chosen(0, len(words), 0, _levels(text, words), lambda a, b: b - a <= room and (b - a == 1 or words[b - 1][1] - words[a][0] <= half))
    pieces: list[tuple[int, int]] = []
    first, last = parts[0]
    for s, e in parts[1:]:
        if e - first <= max_words and words[e - 1][1] - words[first][0] <= most:
            last = e
            continue
        pieces.append((first, last))
        begin = max(s - overlap, first)
        while words[e - 1][1] - words[begin][0] > most:
            begin += 1
        first, last = begin, e
    pieces.append((first, last))
    return [(words[a][0], words[b - 1][1]) for a, b in pieces]


def split_oversized(df: DataFrame, text: str = "text", max_words: int = 128, overlap: int = 6, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """One row per piece: the columns of ``df``, with ``text`` the piece, and ``piece_no`` (from 0), ``n_pieces``, ``n_words`` (of the whole text), ``piece_start``, ``piece_end``.

    Rows within the limits of :func:`split_text` keep their text as one piece and never leave the JVM; null and empty texts
    are one piece with null offsets.  Columns of ``df`` with the names of the added ones are replaced.  A word is a run of
    characters other than (Unicode) whitespace.  Repeated rows stay repeated.
    """
    added = ["piece_no", "n_pieces", "n_words", "piece_start", "piece_end"]
    base = df.drop(*added)

    def pieces(t: str) -> list[tuple[str, int, int, int]]:
        found = split_text(t, max_words, overlap, max_chars)
        return [(t[a:b], a, b, len(found)) for a, b in found]

    @F.pandas_udf("array<struct<piece: string, piece_start: int, piece_end: int, n: int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([pieces(t) for t in s], dtype=object)

    # only what is over goes to Python
    t = F.col(text)
    n = F.coalesce(F.regexp_count(t, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0)).cast("int")
    over = F.col("n_words") > max_words
    if max_chars:
        over = over | (F.length(t) > max_chars)
    marked = base.withColumn("n_words", n).withColumn("__over", F.coalesce(over, F.lit(False)))
    whole = marked.where(~F.col("__over")).select(
        *[F.col(f"`{c}`") for c in base.columns], F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), "n_words",
        F.when(F.length(t) > 0, 0).cast("int").alias("piece_start"), F.when(F.length(t) > 0, F.length(t)).cast("int").alias("piece_end"),
    )
    parts = marked.where("__over").withColumn("__parts", cut.asNondeterministic()(t))
    parts = parts.select(*[F.col(f"`{c}`") for c in base.columns if c != text], "n_words", F.posexplode("__parts").alias("piece_no", "__p"))
    parts = parts.select(*[F.col("__p.piece").alias(c) if c == text else F.col(f"`{c}`") for c in base.columns], "piece_no", F.col("__p.n").alias("n_pieces"), "n_words", "__p.piece_start", "__p.piece_end")
    return whole.unionByName(parts)
