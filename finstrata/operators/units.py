"""Quantities recorded in different units: read, convert and compare.

A multi-pattern automaton finds every unit and currency alias of a text in one pass; overlapping hits are resolved by
longest match, and the dimension of the field (money or plain ratio) decides which hits count.  Conversion factors are
then joined from small tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut

# Aliases of scales (kind "money") and of ratio units, with their factors.
SCALE_ALIASES: dict[str, float] = {
    "ед": 1.0, "ед.": 1.0, "единиц": 1.0, "units": 1.0,
    "тыс": 1e3, "тыс.": 1e3, "тысяч": 1e3, "тысяча": 1e3, "тысячи": 1e3, "тысячах": 1e3, "thousand": 1e3, "thousands": 1e3,
    "млн": 1e6, "млн.": 1e6, "миллион": 1e6, "миллиона": 1e6, "миллионов": 1e6, "миллионах": 1e6, "million": 1e6, "millions": 1e6, "mln": 1e6, "mln.": 1e6,
    "млрд": 1e9, "млрд.": 1e9, "миллиард": 1e9, "миллиарда": 1e9, "миллиардов": 1e9, "миллиардах": 1e9, "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9,
    "трлн": 1e12, "трлн.": 1e12, "триллион": 1e12, "триллиона": 1e12, "триллионов": 1e12, "trillion": 1e12, "trn": 1e12,
}
RATIO_ALIASES: dict[str, float] = {
    "%": 1e-2, "процент": 1e-2, "процента": 1e-2, "процентов": 1e-2, "проц": 1e-2, "проц.": 1e-2, "percent": 1e-2,
    "‰": 1e-3, "промилле": 1e-3,
    "б.п.": 1e-4, "б. п.": 1e-4, "бп": 1e-4, "bp": 1e-4, "bps": 1e-4,
    "коэф": 1.0, "коэф.": 1.0, "коэффициент": 1.0, "раз": 1.0, "раза": 1.0, "x": 1.0, "х": 1.0, "доля": 1.0, "доли": 1.0,
}
# Aliases of currencies.
CURRENCY_ALIASES: dict[str, tuple[str, ...]] = {
    "RUB": ("rub", "rur", "руб", "руб.", "рубль", "рубля", "рублей", "рублях", "р.", "₽"),
    "USD": ("usd", "$", "us$", "долл", "долл.", "долл. сша", "доллар", "доллара", "долларов", "долларах", "долларов сша"),
    "EUR": ("eur", "€", "евро"),
    "CNY": ("cny", "юань", "юаня", "юаней", "юанях", "¥"),
    "KZT": ("kzt", "тенге", "₸"),
    "BYN": ("byn", "бел. руб", "бел. руб.", "бел.руб.", "белорусских рублей", "белорусский рубль", "белорусского рубля"),
}
#: Metrics that are plain ratios, in the data's own wording.
RATIO_METRICS = ("рентабельность", "долг к ebitda")
#: Two amounts match when they differ by at most this share of the larger.
TOLERANCE = 0.002

_GROUP = "     '’"
_NUMBER = re.compile(r"\d+(?:[%s]\d{3}(?!\d))*(?:[.,]\d+)*" % re.escape(_GROUP))
_RESULT = T.StructType([
    T.StructField("number", T.DoubleType()), T.StructField("unit_alias", T.StringType()),
    T.StructField("currency_code", T.StringType()), T.StructField("dimension", T.StringType()),
])


@lru_cache(maxsize=1)
def _automaton():
    """Aho-Corasick automaton of all aliases; the payload is (length, kind, key)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, str]]] = {}
    for alias in SCALE_ALIASES:
        entries.setdefault(alias, []).append(("scale", alias))
    for alias in RATIO_ALIASES:
        entries.setdefault(alias, []).append(("ratio", alias))
    for code, aliases in CURRENCY_ALIASES.items():
        for alias in aliases:
            entries.setdefault(alias, []).append(("currency", code))
    for alias, kinds in entries.items():
        a.add_word(alias, (len(alias), tuple(kinds)))
    a.make_automaton()
    return a


def _letter(ch: str) -> bool:
    return ch.isalpha() or ch == "_"


def find_aliases(text: str) -> list[tuple[int, int, str, str]]:
    """All aliases of ``text`` as (start, end, kind, key); overlaps go to the longest, then the leftmost.

    An alias that begins or ends with a letter must not touch another letter there.
    """
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower to two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = []
    for end, (n, kinds) in _automaton().iter(low):
        s, e = end - n + 1, end + 1
        if _letter(low[s]) and s and _letter(low[s - 1]):
            continue
        if _letter(low[e - 1]) and e < len(low) and _letter(low[e]):
            continue
        hits.append((s, e, kinds))
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    taken: list[tuple[int, int, str, str]] = []
    for s, e, kinds in hits:
        if all(e <= a or s >= b for a, b, _, _ in taken):
            taken.extend((s, e, kind, key) for kind, key in kinds)
    return sorted(taken)


def number_of(core: str) -> float | None:
    """The value of an unsigned number in any of the usual notations.

    Blanks and apostrophes group.  When both ``,`` and ``.`` occur the last one is the decimal mark; one kind that
    occurs more than once groups; one that occurs once is the decimal mark.
    """
    s = "".join(c for c in core if c not in _GROUP)
    commas, dots = s.count(","), s.count(".")
    if commas and dots:
        mark = "," if s.rfind(",") > s.rfind(".") else "."
        s = s.replace("." if mark == "," else ",", "")
        if s.count(mark) > 1:
            return None
        s = s.replace(mark, ".")
    elif commas > 1 or dots > 1:
        parts = re.split("[.,]", s)
        if not all(len(p) == 3 for p in parts[1:]):
            return None
        s = "".join(parts)
    else:
        s = s.replace(",", ".")
    try:
        return float(s)
    except ValueError:
        return None


def read_number(text: str | None) -> tuple[float | None, str]:
    """(signed number, its digits as written) of the first number of ``text``; (None, "") if it has none."""
    if not text or not (m := _NUMBER.search(text)):
        return None, ""
    n = number_of(m[0])
    if n is None:
        return None, ""
    before = text[: m.start()].rstrip(" \u00a0\u202f$€₽₸¥").lower()
    negative = before.endswith(("-", "−", "–", "минус", "minus")) or (before.endswith("(") and ")" in text[m.end() :])
    return (-n if negative else n), m[0]


def _pick(hits: Sequence[tuple[int, int, str, str]], kind: str) -> str | None:
    return next((key for _, _, k, key in hits if k == kind), None)


def _of_figure(context: str, digits: str) -> list[tuple[int, int, str, str]]:
    """The aliases in ``context`` that speak of the figure written ``digits``.

    An alias belongs to the number it follows (only blanks, brackets or other aliases between) or that follows it
    directly, as currency signs may; an alias next to no number before the figure is a heading and speaks of it too.
    """
    hits = find_aliases(context)
    if not hits:
        return []
    numbers = [(m.start(), m.end()) for m in _NUMBER.finditer(context)]
    own = next(((s, e) for s, e in numbers if digits and context[s:e] == digits), None)
    out, heading = [], []
    for h in hits:
        s, e = h[0], h[1]
        prev = max((n for n in numbers if n[1] <= s), default=None, key=lambda n: n[1])
        if prev and _bridges(context, prev[1], s, hits):
            if prev == own:
                out.append(h)
            continue
        nxt = min((n for n in numbers if n[0] >= e), default=None)
        if nxt and h[2] == "currency" and context[e : nxt[0]].strip() == "" and not context[s:e][-1].isalpha() and context[s:e][-1] != ".":
            if nxt == own:
                out.append(h)
            continue
        if own is None or s < own[0]:
            heading.append(h)
    return out + heading


def _bridges(text: str, a: int, b: int, hits: Sequence[tuple[int, int, str, str]]) -> bool:
    """Whether only blanks, a closing bracket and aliases stand between ``a`` and ``b``."""
    gap = list(text[a:b])
    for s, e, _, _ in hits:
        for i in range(max(s, a), min(e, b)):
            gap[i - a] = " "
    return "".join(gap).strip(" \u00a0\u202f)") == ""


def read_quantity(value: str | None, unit: str | None, currency: str | None, context: str | None, metric: str | None, ratio_metrics: Sequence[str] = RATIO_METRICS):
    """(number, unit alias, currency code, dimension) of one slot; the number is None when unreadable.

    The columns go first, then the value, then what the context says of this figure; a slot that names no scale is
    in single units, one that names no currency in roubles.
    """
    dimension = "ratio" if (metric or "").strip().lower() in ratio_metrics else "money"
    number, digits = read_number(value)
    if number is None:
        return None, None, None, dimension
    kind = "ratio" if dimension == "ratio" else "scale"
    in_unit, in_currency = find_aliases(unit or ""), find_aliases(currency or "")
    alias = _pick(in_unit, kind) or _pick(in_currency, kind)
    code = None if kind == "ratio" else (_pick(in_currency, "currency") or _pick(in_unit, "currency"))
    for text in ("value", "context"):
        if alias and (code or kind == "ratio"):
            break
        hits = find_aliases(value) if text == "value" else _of_figure(context or "", digits)
        alias = alias or _pick(hits, kind)
        code = code or (None if kind == "ratio" else _pick(hits, "currency"))
    return number, alias, code, dimension


def quantity_column(value: Column, unit: Column, currency: Column, context: Column, metric: Column, ratio_metrics: Sequence[str] = RATIO_METRICS) -> Column:
    """STRUCT<number, unit_alias, currency_code, dimension> of each row, by :func:`read_quantity`."""
    ratios = tuple(m.lower() for m in ratio_metrics)

    @F.pandas_udf(_RESULT)
    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for v, u, c, x, m in batches:
            rows = [read_quantity(*(None if t is None or t != t else t for t in r), ratio_metrics=ratios) for r in zip(v, u, c, x, m, strict=True)]
            yield pd.DataFrame(rows, columns=["number", "unit_alias", "currency_code", "dimension"])

    return read.asNondeterministic()(value, unit, currency, context, metric)  # else a filter of the result would run it twice


def factor_table(spark) -> DataFrame:
    """(q_alias, q_dimension, q_factor): the conversion factors of all scale and ratio aliases."""
    rows = [(a, "money", f) for a, f in SCALE_ALIASES.items()] + [(a, "ratio", f) for a, f in RATIO_ALIASES.items()]
    return spark.createDataFrame(rows, "q_alias string, q_dimension string, q_factor double")


def to_common_units(df: DataFrame, fx: DataFrame, *, value="value", unit="unit", currency="currency", context="context", metric="metric", ratio_metrics: Sequence[str] = RATIO_METRICS) -> DataFrame:
    """``df`` with ``amount`` (roubles, or a plain ratio), ``amount_unit`` ('RUB', 'ratio') and the parts it came from.

    ``df`` keeps all its own columns; any of the added names that it already has is replaced.  A value without a
    readable number, or a currency without a rate, gives a null ``amount``.  Empty tables give empty results and
    repeated rows stay repeated.
    """
    spark = df.sparkSession
    added = ["amount", "amount_unit", "quantity"]
    src = df.drop(*added)
    q = src.withColumn("quantity", quantity_column(*(F.col(c).cast("string") for c in (value, unit, currency, context, metric)), ratio_metrics=ratio_metrics))
    q = q.withColumn("__alias", F.col("quantity.unit_alias")).withColumn("__dim", F.col("quantity.dimension"))
    q = q.withColumn("__code", F.when(F.col("__dim") == "money", F.coalesce(F.col("quantity.currency_code"), F.lit("RUB"))))
    factors = factor_table(spark).withColumnsRenamed({c: f"__{c}" for c in ("q_alias", "q_dimension", "q_factor")})
    rates = fx.groupBy(F.col("currency_code").alias("__q_code")).agg(F.max("rub_per_unit").alias("__q_rate"))
    out = q.join(F.broadcast(factors), (F.col("__alias") == F.col("__q_alias")) & (F.col("__dim") == F.col("__q_dimension")), "left")
    out = out.join(broadcast_if_small(rates), F.col("__code") == F.col("__q_code"), "left")
    scaled = F.col("quantity.number") * F.coalesce(F.col("__q_factor"), F.lit(1.0))
    return out.select(
        *[F.col(f"`{c}`") for c in src.columns],
        F.when(F.col("__dim") == "ratio", scaled).otherwise(scaled * F.col("__q_rate")).alias("amount"),
        F.when(F.col("__dim") == "ratio", "ratio").otherwise("RUB").alias("amount_unit"),
        "quantity",
    )


def matching_amounts(df: DataFrame, keys: Sequence[str], id_col: str, amount: str = "amount", tolerance: float = TOLERANCE) -> DataFrame:
    """Distinct pairs (``<id>_a`` < ``<id>_b``) with equal ``keys`` whose amounts differ by at most ``tolerance`` of the larger.

    A band join: amounts fall into logarithmic bins as wide as the tolerance, a row meets only its own bin and the one
    above, and keys and bin together are the join key, so no group is held or paired as a whole.  Null keys, ids or
    amounts match nothing; zero matches zero only.
    """
    width = -math.log1p(-tolerance) * (1 + 1e-9)
    a = F.col(amount)
    base = df.where(a.isNotNull() & ~F.isnan(a) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.abs(a).alias("__m"), F.signum(a).cast("int").alias("__sign"),
        F.when(a == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(a)) / width)).cast("long").alias("__bin"),
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
    )
    base = cut(base.distinct())  # narrow, and read twice below
    on = [*[f"__k{i}" for i in range(len(keys))], "__sign", "__bin"]
    low = base.withColumnsRenamed({"__id": "__id1", "__m": "__m1"}).withColumn("__bin", F.explode(F.array(F.col("__bin"), F.col("__bin") + 1)))
    high = base.withColumnsRenamed({"__id": "__id2", "__m": "__m2"})
    later = (F.col("__m2") > F.col("__m1")) | ((F.col("__m2") == F.col("__m1")) & (F.col("__id2") > F.col("__id1")))
    near = F.col("__m2") - F.col("__m1") <= F.col("__m2") * (tolerance * (1 + 1e-9))
    pairs = low.join(high, on).where(later & near & (F.col("__id1") != F.col("__id2")))
    return pairs.select(F.least("__id1", "__id2").alias(f"{id_col}_a"), F.greatest("__id1", "__id2").alias(f"{id_col}_b")).distinct()
