"""Metric slots: every metric span with the nearest amount, period, currency and unit of its chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context on each side.
RADIUS = 80


def gap(a: Column, b: Column) -> Column:
    """The distance of two spans; 0 when they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a["start_pos"], b["start_pos"]) - F.least(a["end_pos"], b["end_pos"]))


def nearest(spans: Column, anchor: Column, label: str) -> Column:
    """The span of ``label`` nearest to ``anchor``, the earliest in the list on ties; null when there is none."""
    ranked = F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s, i: F.struct(gap(s, anchor).alias("gap"), i.alias("i"), s.alias("s")))
    return F.array_min(ranked)["s"]


def resolve_slots(df: DataFrame, keys: list[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """``keys``, anchor_idx, metric, period, currency, unit, value, context.

    Spans are compared within their chunk only, so nothing is shuffled.  Chunks without metric spans give no rows; null
    entries of the list are skipped but keep their place.
    """
    src = df.select(*keys, F.col(text).alias("__t"), F.filter(spans, lambda s: s.isNotNull()).alias("__s"), F.posexplode(spans).alias("anchor_idx", "a")).where(F.col("a.label") == "metric")
    found = src.select(*keys, "anchor_idx", "__t", "a", *[nearest(F.col("__s"), F.col("a"), x).alias(x) for x in ("amount", "period", "currency", "unit")])
    lo = F.least(F.col("a.start_pos"), F.coalesce("amount.start_pos", "a.start_pos"))
    hi = F.greatest(F.col("a.end_pos"), F.coalesce("amount.end_pos", "a.end_pos"))
    left = F.greatest(F.lit(0), lo - RADIUS)
    context = F.substring(F.col("__t"), left + 1, hi + RADIUS - left)
    return found.select(*keys, "anchor_idx", F.col("a.text").alias("metric"), F.col("period.text").alias("period"), F.col("currency.text").alias("currency"), F.col("unit.text").alias("unit"), F.col("amount.text").alias("value"), context.alias("context"))
