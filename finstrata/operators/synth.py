"""Synthetic annotated reports.

Every record has its own random stream, seeded by the seed and its number, so records are made in parallel and are the
same whatever the partitioning.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import METRICS, RISKS

# The templates' units with currencies, ranges, periods, headings and confusions.
UNITS = (("тыс.", "руб."), ("млн", "руб."), ("млрд", "руб."), ("млн", "₽"), (None, "руб."), ("%", None))
AMOUNTS = {"low": (1e6, 5e10), "medium": (1e4, 1e10), "high": (1e3, 5e9)}
NEGATIVE = {"low": 0.0, "medium": 0.25, "high": 0.65}
PERCENTS = {"low": (10.0, 60.0), "medium": (0.0, 40.0), "high": (-30.0, 15.0)}
SIGNALS = {
    "low": "Рост ключевых показателей за 2023 год.",
    "medium": "Показатели компании стабильны за отчётный период.",
    "high": "Отмечено снижение финансовых результатов и рост долговой нагрузки.",
}
PERIODS = ("2023 год", "2023", "9 месяцев 2023 года", "I квартал 2023 года", "2022—2023")
DATES = ("31.12.2023", "01.01.2023")
KINDS = (("Отчёт о финансовых результатах", "офр"), ("Бухгалтерский баланс", "баланс"), ("Пояснения к отчётности", "пояснения"))
PREFERRED = {"low": ("выручка", "ebitda", "чистая прибыль"), "medium": ("выручка", "ebitda", "чистая прибыль"), "high": ("долг к ebitda", "чистая прибыль", "операционный денежный поток")}
CONFUSED = {"о": "o", "а": "a", "е": "e", "с": "c", "к": "k", "р": "p", "0": "O", "1": "l", "3": "З"}
#: A record ends at this many chunks even if it has too few entities.
MOST_CHUNKS = 200


@dataclass(frozen=True)
class Options:
    """How many records, how many entities each at least, how much noise, and the seed."""

    count: int = 500
    min_entities: int = 20
    max_entities: int = 80
    noise_level: float = 0.02
    seed: int = 42

    def __post_init__(self) -> None:
        if self.count < 1 or self.min_entities < 1 or not 0 <= self.noise_level <= 1:
            raise ValueError("count and min_entities must be positive, noise_level between 0 and 1")
        if self.max_entities < self.min_entities:
            raise ValueError("max_entities must not be less than min_entities")


def amount_text(value: Column, decimals: Column) -> Column:
    """A number with blanks between thousands, a comma before decimals, and its sign."""
    shown = F.when(decimals, F.translate(F.format_number(F.abs(value), 2), ",.", " ,")).otherwise(F.translate(F.format_number(F.bround(F.abs(value), 0), 0), ",", " "))
    return F.concat(F.when(value < 0, "-").otherwise(""), shown)


def _amount(value: float, decimals: bool) -> str:
    shown = f"{abs(value):,.2f}".translate({44: " ", 46: ","}) if decimals else f"{round(abs(value)):,}".replace(",", " ")
    return ("-" if value < 0 else "") + shown


def ocr_noise(text: str, rng: random.Random, level: float) -> str:
    """Single characters for look-alikes, so that offsets stay valid."""
    return "".join(CONFUSED[c] if c in CONFUSED and rng.random() < level else c for c in text)


def joined(parts: list[tuple[str, str | None]]) -> tuple[str, list[dict]]:
    """The concatenated text, and the spans of its labelled parts."""
    text, spans = "", []
    for part, label in parts:
        if part and label:
            spans.append({"text": part, "label": label, "start": len(text), "end": len(text) + len(part)})
        text += part
    return text, spans


def statement(rng: random.Random, risk: str) -> tuple[str, list[dict]]:
    names = [m.replace("_", " ") for m in METRICS]
    metric = next((m for m in PREFERRED[risk] if rng.random() < 0.8), None) or rng.choice(names)
    unit, currency = rng.choice(UNITS)
    if unit == "%":
        amount = f"{rng.uniform(*PERCENTS[risk]):.1f}".replace(".", ",")
    else:
        sign = -1 if rng.random() < NEGATIVE[risk] else 1
        amount = _amount(sign * rng.uniform(*AMOUNTS[risk]), rng.random() < 0.35)
    tail = [(" ", None), (unit, "unit")] * bool(unit) + [(" ", None), (currency, "currency")] * bool(currency) + [(".", None)]
    draw = rng.random()
    if draw < 0.12:
        return joined([("Значение ", None), (metric, "metric"), (": нет данных.", None)])
    if draw < 0.35:
        head = [("Значение ", None), (metric, "metric"), (" за ", None), (rng.choice(PERIODS), "period"), (": ", None)]
    elif draw < 0.7:
        head = [("По итогам ", None), (rng.choice(PERIODS), "period"), (" ", None), (metric, "metric"), (" — ", None)]
    else:
        head = [("По состоянию на ", None), (rng.choice(DATES), "period"), (" ", None), (metric, "metric"), (": ", None)]
    return joined([*head, (amount, "amount"), *tail])


def record(options: Options, number: int) -> dict:
    """One record: a heading, then statements and risk signals until it has enough entities."""
    rng = random.Random(f"{options.seed}/{number}")
    risk, (heading, kind) = rng.choice(RISKS), rng.choice(KINDS)
    chunks, entities = [{"chunk_id": 0, "text": heading, "spans": []}], 0
    while entities < options.min_entities and len(chunks) < MOST_CHUNKS:
        text, spans = statement(rng, risk)
        if rng.random() < 0.2:
            text = ocr_noise(text, rng, options.noise_level)
            spans = [s | {"text": text[s["start"] : s["end"]]} for s in spans]
        chunks.append({"chunk_id": len(chunks), "text": text, "spans": spans})
        entities += len(spans)
        if rng.random() < 0.4:
            chunks.append({"chunk_id": len(chunks), "text": SIGNALS[risk], "spans": []})
    return {"source": f"synthetic/{kind}/{number:04d}", "chunks": chunks, "risk": risk}


def generate(spark: SparkSession, options: Options = Options(), partitions: int | None = None) -> DataFrame:  # noqa: B008
    """``options.count`` records as (source, chunks, risk)."""
    from ..schemas import RECORD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([record(options, int(i)) for i in b["id"]])

    return spark.range(0, options.count, 1, partitions).mapInPandas(run, RECORD)


def order_statements(orders: DataFrame) -> DataFrame:
    """(order key, text, spans) made of orders by fixed rules, so that SQL can make the same: three templates in turn."""
    k = F.col("o_orderkey")
    metric = F.element_at(F.array(*[F.lit(m.replace("_", " ")) for m in METRICS]), (k % len(METRICS) + 1).cast("int"))
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit(" год"))
    unit = F.element_at(F.array(*[F.lit(x) for x in ("тыс.", "млн", "млрд")]), (k % 3 + 1).cast("int"))
    amount = amount_text(F.floor(F.col("o_totalprice")).cast("double"), F.lit(False))
    variant = (k % 4).cast("int")
    lead = F.when(variant == 0, "Значение ").when(variant == 1, "По итогам ").otherwise("По состоянию на ")
    first, second = F.when(variant == 0, metric).otherwise(period), F.when(variant == 0, period).otherwise(metric)
    mid = F.when(variant == 0, " за ").otherwise(" ")
    before = F.when(variant == 1, " — ").otherwise(": ")
    d = orders.select(k.alias("o_orderkey"), variant.alias("v"), lead.alias("p0"), first.alias("p1"), mid.alias("p2"), second.alias("p3"), before.alias("p4"), amount.alias("p5"), F.lit(" ").alias("p6"), unit.alias("p7"), F.lit(" ").alias("p8"), F.lit("руб.").alias("p9"))
    starts = [F.lit(0)]
    for i in range(9):
        starts.append(starts[-1] + F.length(f"p{i}"))
    labels = {1: F.when(F.col("v") == 0, "metric").otherwise("period"), 3: F.when(F.col("v") == 0, "period").otherwise("metric"), 5: F.lit("amount"), 7: F.lit("unit"), 9: F.lit("currency")}
    spans = F.array(*[F.struct(F.col(f"p{i}").alias("text"), x.alias("label"), starts[i].cast("int").alias("start_pos"), (starts[i] + F.length(f"p{i}")).cast("int").alias("end_pos")) for i, x in labels.items()])
    return d.select("o_orderkey", F.concat(*[f"p{i}" for i in range(10)], F.lit(".")).alias("text"), spans.alias("spans"))
