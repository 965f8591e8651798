"""Per-document text statistics, and the kind of text they show: prose, list, table or junk.

Tables show as delimiters that stand in the same number, or in the same columns, in neighbouring lines with mostly
figures between them; lists as markers that recur, or as runs of short unpunctuated lines that have indents with a
period or lack the even width of wrapped prose (the autocorrelation of their lengths is low).  How much of a text they
must cover depends on its signs of prose: common words, lines that end in punctuation, words of usual length, few symbols,
lines of even width.  Junk shows in characters that can't be text of any script, in Latin or Cyrillic words without a
vowel, in random runs, repetition and symbols; common words speak against the doubtful ones of these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The commonest words of Russian and English prose.
COMMON_WORDS = frozenset(
    "и в во на не с со что по к ко за из от у о об до при для без над под после перед между как так же а но или то это этот эта эти его ее её их "
    "он она они мы вы я который которая которые также поэтому причём чем через если когда был была были было будет есть "
    "the of and to in a an is was were are be been for on at by with from as that this it its or not which has have had will their than due against given".split()
)
#: A layout holds when it covers at least this share of a text without any sign of prose, and so much more for each sign.
COVERED, PER_SIGN = 0.35, 0.06
#: Signs of prose: shares of common words and of lines that end in punctuation, word lengths, symbols, evenness of line lengths.
COMMON, PUNCTUATED, WORD_LENGTHS, SYMBOLS, EVEN = 0.08, 0.3, (3.0, 12.0), 0.12, 0.85

_NUMERIC_CELL = re.compile(r"[\s$€₽+−–(-]*(?:\d[\d\s   .,'%]*[)%]?|[—–-]+|:?-{3,}:?|н/д|n/a|нет данных|x|)\s*$", re.I)
_FIGURE = re.compile(r"\d")
_MARKER = re.compile(r"\s*(?:[-–—*•◦○●▪■□☐☑✓·‣>+]\s+|\(?\d{1,3}(?:\.\d{1,3})*[.)]?\s+(?=\D)|\(?[a-zа-яё][.)]\s+|[IVXLC]{1,5}[.)]\s+)", re.I)
_LEADER = re.compile(r"(?:\.{4,}|(?:\. ){4,}|_{4,}|…{2,})\s*\d+\s*$")
_ENDS = ".!?…:;»\"”)"
_SENTENCE = re.compile(r"[.!?…][»\"”)]*(?:\s|$)")
_GAP = re.compile(r" {2,}")
# Characters that stand for the bytes 0x80 to 0xBF where UTF-8 was read in a Western code page.
_CONTINUED = "\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: What no script writes: lost characters, control codes, UTF-8 read byte by byte, words of nothing but accented letters.
_GARBLED = re.compile(f"[\x80-\x9f�□]|[Â-ô][{_CONTINUED}]|(?<=\\w)¿|¿(?!\\w)|\\?(?=\\w)|(?<!\\w)[À-ÿ]{{3,}}(?!\\w)")
_RANDOM = re.compile(r"(?<!\S)(?:(?=\S*\d)(?=\S*[A-Za-z])[\w+/=]{6,}|[A-Za-z0-9+=А-яЁё]{41,}|(?=\S{0,59}\d)(?=\S{0,59}[A-Za-z])[\w+/=]{60}\S+)(?!\S)")
#: Texts without these have nothing garbled, or nothing random but words of over 40 characters; found faster than the rest.
_HIGH, _MIXED = re.compile("[\x80-\x9f\xbf-\xff�□?]"), re.compile("[A-Za-z][+/=_]?[0-9]|[0-9][+/=_]?[A-Za-z]")
_NO_VOWEL = re.compile(r"(?<![^\W_])[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщъь]{2,}(?![^\W_])")
_SPLIT = re.compile(r"[^\W_]+")


def _cells(line: str) -> tuple[str, list[str]]:
    """The delimiter of a line that may be a table row, and its cells."""
    for d in ("|", "\t"):
        if d in line:
            return d, line.strip().strip("|").split(d) if d == "|" else line.split(d)
    if "  " in line and len(gaps := _GAP.split(line.strip())) > 2:
        return "  ", gaps
    if line.count(";") >= 2:
        return ";", line.strip().strip(";").split(";")
    if line.count(",") >= 2 and not _SENTENCE.search(line.rstrip(".")):
        return ",", line.split(",")
    return "", []


def _row_edges(line: str) -> frozenset[int]:
    return frozenset(m.start() for m in re.finditer(r"(?<=\S)(?=  |$)", line.rstrip()))


def _table_lines(lines: list[str]) -> list[bool]:
    """Lines with aligned delimiters and mostly figures between them."""
    parsed = [_cells(s) for s in lines]

    def figures(i: int) -> bool:
        d, cells = parsed[i]
        if len(cells) < 2 or any(_SENTENCE.search(c.strip()[:-1]) and len(c.split()) > 4 for c in cells):
            return False
        rest = cells[1:]
        figured = [c for c in rest if _NUMERIC_CELL.match(c)]
        if not any(c.strip() for c in figured):
            return False
        share = len(figured) / len(rest)
        return share >= (0.5 if d in ("|", "\t", "  ") else 0.7)

    out = []
    for i, s in enumerate(lines):
        d, cells = parsed[i]
        if not d:
            out.append(False)
            continue
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(lines) and parsed[j][0] == d]
        if d == "  ":
            same = any(len(_row_edges(s) & _row_edges(lines[j])) * 2 >= len(cells) or len(parsed[j][1]) == len(cells) for j in near)
        else:
            same = any(len(parsed[j][1]) == len(cells) for j in near)
        alone = len(cells) >= 6 and d in ("|", "\t") and bool(_FIGURE.search(s))
        one_row = [c for c in cells if _NUMERIC_CELL.match(c)]
        out.append(figures(i) and (same or len(cells) >= 3) or alone and len(one_row) * 2 >= len(cells))
    return out


def _autocorrelation(xs: list[int]) -> float:
    """Lag-one autocorrelation of the lines' lengths about zero: 1 for lines of one width, less the more they vary.

    The last line of a wrapped paragraph is short, so falls to less than three quarters of the longest end a stretch
    and are not held against it.
    """
    if len(xs) < 3:
        return 1.0
    top = max(xs)
    pairs = [(a, b) for a, b in zip(xs, xs[1:], strict=False) if min(a, b) >= 0.75 * top or a < 0.75 * top]
    power = sum(max(a, b) ** 2 for a, b in pairs)
    return sum(a * b for a, b in pairs) / power if power else 1.0


def _indent_period(lines: list[str]) -> int:
    """The period, up to four lines, with which indents of several depths recur; 0 for none."""
    depth = [len(s.expandtabs(4)) - len(s.expandtabs(4).lstrip()) for s in lines]
    if len(lines) < 6 or len(set(depth)) < 2:
        return 0
    for p in range(1, 5):
        same = sum(a == b for a, b in zip(depth, depth[p:], strict=False))
        if same >= 0.9 * (len(depth) - p):
            return p
    return 0


def _list_lines(lines: list[str], table: list[bool]) -> list[bool]:
    """Lines with recurring markers or indents, dot leaders, and runs of short lines that aren't wrapped prose."""
    marked = [bool(not t and (_MARKER.match(s) or ("..." in s or ". . ." in s or "__" in s or "…" in s) and _LEADER.search(s))) for s, t in zip(lines, table, strict=True)]
    # short lines without a sentence in them
    entry = [len(s) <= 90 and not t and not m and s.count(",") <= 1 and not _SENTENCE.search(s.strip()) for s, t, m in zip(lines, table, marked, strict=True)]
    out = [m and (i > 0 and marked[i - 1] or i + 1 < len(lines) and marked[i + 1]) for i, m in enumerate(marked)]
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and entry[j]:
            j += 1
        run = lines[i:j]
        if len(run) >= 4:
            lengths = [len(s.strip()) for s in run]
            words = [len(s.split()) for s in run]
            wrapped = _autocorrelation(lengths) > 0.85 and max(lengths) > 40
            if (not wrapped or _indent_period(run)) and sum(words) / len(words) <= 8:
                out[i:j] = [True] * len(run)
        i = max(j, i + 1)
    # headings directly over a list belong to it
    for k in range(len(lines) - 1):
        if not out[k] and not table[k] and out[k + 1] and len(lines[k]) <= 80 and not _SENTENCE.search(lines[k]):
            out[k] = True
    return out


def text_statistics(text: str | None) -> dict | None:
    """The statistics of a text; none for null and blank texts."""
    if not text or not text.strip():
        return None
    words = text.split()
    n = len(words)
    solid = sum(map(len, words))
    low = text.lower()
    plain = _SPLIT.findall(low)
    letters = sum(map(len, plain))
    lines = [s for s in text.split("\n") if s.strip()]
    grams = max(1, len(words) - 2)
    distinct = len(set(zip(words, words[1:], words[2:], strict=False))) / grams if n >= 3 else 1.0
    garbled = sum(map(len, _GARBLED.findall(text))) / solid if _HIGH.search(text) else 0.0
    random = sum(map(len, _RANDOM.findall(text))) / solid if _MIXED.search(text) or max(map(len, words)) > 40 else 0.0
    spelt = letters - sum(map(text.count, "0123456789"))
    unspeakable = sum(map(len, _NO_VOWEL.findall(low))) / max(1, spelt)
    table = _table_lines(lines)
    listed = _list_lines(lines, table)
    size = sum(len(s.strip()) for s in lines)
    table_share = sum(len(s.strip()) for s, t in zip(lines, table, strict=True) if t) / size
    list_share = sum(len(s.strip()) for s, t in zip(lines, listed, strict=True) if t) / size
    return {
        "word_count": n, "mean_word_length": solid / n, "symbol_ratio": (solid - letters) / solid,
        "punct_line_share": sum(s.rstrip()[-1] in _ENDS for s in lines) / len(lines),
        "common_word_share": sum(map(COMMON_WORDS.__contains__, plain)) / max(1, len(plain)),
        "distinct_share": distinct, "garbled_ratio": garbled, "random_share": random, "unspeakable_share": unspeakable,
        "table_share": table_share, "list_share": list_share, "line_autocorrelation": _autocorrelation([len(s) for s in lines]), "indent_period": _indent_period(lines),
    }


def prose_signs(s: dict) -> int:
    """How many of the five signs of prose the statistics show."""
    low, high = WORD_LENGTHS
    return sum((s["common_word_share"] >= COMMON, s["punct_line_share"] >= PUNCTUATED, low <= s["mean_word_length"] <= high, s["symbol_ratio"] <= SYMBOLS, s["line_autocorrelation"] >= EVEN))


def text_kind(s: dict | None) -> str | None:
    """prose, list, table or junk, by :func:`text_statistics`; none for blank texts."""
    if s is None:
        return None
    signs = prose_signs(s)
    need = COVERED + PER_SIGN * signs
    laid_out = max(s["table_share"], s["list_share"]) >= need
    worded = s["common_word_share"] >= COMMON
    if s["garbled_ratio"] > 0.08 or s["random_share"] > 0.5 or s["word_count"] >= 12 and s["distinct_share"] < 0.2:
        return "junk"
    if not laid_out and (s["unspeakable_share"] > (0.6 if worded else 0.3) or s["symbol_ratio"] > (0.7 if worded else 0.5)):
        return "junk"
    if laid_out or s["table_share"] + s["list_share"] >= need + 0.15:
        return "table" if s["table_share"] >= s["list_share"] else "list"
    return "prose"


_TYPES = {"word_count": T.LongType(), "indent_period": T.LongType()}
_NAMES = ["word_count", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share", "distinct_share", "garbled_ratio", "random_share", "unspeakable_share", "table_share", "list_share", "line_autocorrelation", "indent_period"]
STATISTICS = T.StructType([*[T.StructField(n, _TYPES.get(n, T.DoubleType())) for n in _NAMES], T.StructField("text_kind", T.StringType())])


def describe_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the statistics of ``text`` and its ``text_kind`` as columns (columns of these names are replaced).

    Null and blank texts get nulls.  Texts are read whole, however long; one pass, no shuffle.
    """

    @F.pandas_udf(STATISTICS)
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                st = text_statistics(t)
                rows.append((None,) * (len(_NAMES) + 1) if st is None else (*(st[k] for k in _NAMES), text_kind(st)))
            out = pd.DataFrame(rows, columns=[*_NAMES, "text_kind"])
            out = out.astype({"word_count": "Int64", "indent_period": "Int64"})
            yield out

    base = df.drop(*STATISTICS.fieldNames())
    src = base.withColumn("__stats", describe.asNondeterministic()(F.col(text)))  # else a filter of the result would run it twice
    return src.select(*[F.col(f"`{c}`") for c in base.columns], "__stats.*")
