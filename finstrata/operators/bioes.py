"""Between character spans and word labels: BIOES labels, and two decoders."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS, OUTSIDE, RISKS
from ..schemas import SPANS
from .lemma import word_spans


PREDICTED = "array<struct<text: string, label: string, confidence: double>>"


def labels_of(starts: list[int], ends: list[int], spans: list[dict | None] | None) -> list[str]:
    """A BIOES label for each word, given by its bounds in order: a span covers the words whose middle lies in it, the last one counts."""
    twice = [a + b for a, b in zip(starts, ends, strict=True)]
    out = [OUTSIDE] * len(twice)
    for s in spans or ():
        if s is None or s["start_pos"] is None or s["end_pos"] is None:
            continue
        first, last = bisect_left(twice, 2 * s["start_pos"]), bisect_left(twice, 2 * s["end_pos"]) - 1
        for i in range(first, last + 1):
            edge = "S" if first == last else "B" if i == first else "E" if i == last else "I"
            out[i] = edge if s["label"] is None else f"{edge}-{s['label']}"
    return out


def bioes_labels(words: Column, spans: Column) -> Column:
    """ARRAY<STRING>: a label for each word; of several spans over a word the last counts, uncovered words are O.

    Null spans and null entries cover nothing.  One Arrow pass that goes to each span's words by bisection.
    """

    @F.arrow_udf("array<string>")
    def labelled(starts: pa.Array, ends: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if a is None else labels_of(a, b, s) for a, b, s in zip(starts.to_pylist(), ends.to_pylist(), spans.to_pylist(), strict=True)], pa.list_(pa.string()))

    return labelled(words["start_pos"], words["end_pos"], spans)


def label_words(df: DataFrame, keys: list[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """``keys``, word_idx (from 0), word, start_pos, end_pos, label."""
    src = df.select(*keys, F.col(spans).cast(SPANS).alias("__spans"), word_spans(F.col(text)).alias("__words"))
    zipped = F.arrays_zip(F.col("__words").alias("w"), bioes_labels(F.col("__words"), F.col("__spans")).alias("label"))
    labelled = src.select(*keys, F.posexplode(zipped).alias("word_idx", "x"))
    return labelled.select(*keys, "word_idx", F.col("x.w.text").alias("word"), F.col("x.w.start_pos").alias("start_pos"), F.col("x.w.end_pos").alias("end_pos"), F.col("x.label").alias("label"))


def spans_of_labels(labels: list[str]) -> list[tuple[int, int, str]]:
    """(first word, end word, entity) of word labels.

    Any label opens a span where none is open; B and S close one and open another; E closes with the opener's entity;
    I of another entity closes and opens; O closes; the end closes.
    """
    out: list[tuple[int, int, str]] = []
    at, entity = -1, ""
    for i, tag in enumerate(labels):
        edge, _, kind = tag.partition("-")
        if at < 0:
            if tag != OUTSIDE:
                at, entity = i, kind
            continue
        if tag == OUTSIDE or edge == "E":
            out.append((at, i + (edge == "E"), entity))
            at = -1
        elif edge in ("B", "S") or edge == "I" and kind != entity:
            out.append((at, i, entity))
            at, entity = i, kind
    return out + ([(at, len(labels), entity)] if at >= 0 else [])


def spans_of_predictions(labels: list[str]) -> list[tuple[int, int, str]]:
    """(first word, end word, entity) of predicted labels: S stands alone, an orphan E is a word, I and E go on whatever their entity."""
    out: list[tuple[int, int, str]] = []
    at, entity = -1, ""
    for i, tag in enumerate(labels):
        edge, _, kind = tag.partition("-")
        if at >= 0 and edge in (OUTSIDE, "S", "B"):
            out.append((at, i, entity))
            at = -1
        if edge == "S":
            out.append((i, i + 1, kind))
        elif edge in ("B", "I", "E") and at < 0:
            at, entity = i, kind
        if edge == "E":
            out.append((at, i + 1, entity))
            at = -1
    return out + ([(at, len(labels), entity)] if at >= 0 else [])


def map_lists(df: DataFrame, keys: list[str], inputs: list[Column], made: str, kind: str, one: Callable) -> DataFrame:
    """``keys`` and ``made``, by ``one`` of each row's ``inputs``; a state machine over lists, run in Arrow batches."""
    src = df.select(*keys, *[c.alias(f"__{i}") for i, c in enumerate(inputs)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keys)]) + f", `{made}` {kind}"

    n = len(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = [b[f"__{i}"] for i in range(n)]
            out = [[] if any(x is None for x in r) else one(*r) for r in zip(*columns, strict=True)]
            yield b[keys].assign(**{made: pd.Series(out, dtype=object, index=b.index)})

    return src.mapInPandas(run, schema)


def decode_bioes(df: DataFrame, keys: list[str], words: str = "words", labels: str = "labels") -> DataFrame:
    """``keys`` and ``spans`` (text, label, start_pos, end_pos) of label lists over word lists; a span's text is its words joined by blanks.

    Null words or labels have no spans.
    """

    def one(w, s, e, t) -> list[dict]:
        return [{"text": " ".join(w[a:b]), "label": k, "start_pos": s[a], "end_pos": e[b - 1]} for a, b, k in spans_of_labels(list(t))]

    w = F.col(words)
    return map_lists(df, keys, [w["text"], w["start_pos"], w["end_pos"], F.col(labels)], "spans", SPANS, one)


def decode_predictions(df: DataFrame, keys: list[str], words: str = "words", labels: str = "labels", probs: str = "probs") -> DataFrame:
    """``keys`` and ``spans`` (text, label, confidence) of predicted labels; confidence is the first word's probability."""

    def one(w, t, p) -> list[dict]:
        return [{"text": " ".join(w[a:b]), "label": k, "confidence": p[a]} for a, b, k in spans_of_predictions(list(t))]

    return map_lists(df, keys, [F.col(words)["text"], F.col(labels), F.col(probs)], "spans", PREDICTED, one)


def continuation_label(label: Column) -> Column:
    """The label of a word's further pieces: B, E and S become I."""
    return F.regexp_replace(label, "^[BES]-", "I-")


def label_id(label: Column) -> Column:
    """The number of a BIOES label; null for others."""
    p = F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
    return F.when(p > 0, (p - 1).cast("int"))


def risk_id(risk: Column) -> Column:
    """low 0, medium 1, high 2; null for others."""
    p = F.array_position(F.array(*[F.lit(x) for x in RISKS]), risk)
    return F.when(p > 0, (p - 1).cast("int"))


def id_risk(number: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in RISKS]), number + 1)
