"""Annotation records as JSON lines, labelling tasks, and exports of a labelling tool."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ENTITIES, RISKS
from ..operators.spans import annotate
from ..schemas import EXPORT_ANNOTATIONS, EXPORT_RESULTS, EXPORT_TASK, RECORD, RECORD_CHUNKS, RECORD_FIELDS, RECORD_SPANS, SPANS


def record_problem(record: Column) -> Column:
    """What is wrong with a record: an unknown label or risk, a missing text, or a span whose text isn't the chunk's text at its bounds; null for sound ones."""
    def span(c: Column, s: Column) -> Column:
        return F.coalesce(F.substring(c["text"], s["start"] + 1, s["end"] - s["start"]) == s["text"], F.lit(False))

    chunks = F.coalesce(record["chunks"], F.array().cast(RECORD_CHUNKS))
    spans = lambda c: F.coalesce(c["spans"], F.array().cast(RECORD_SPANS))
    known = F.forall(chunks, lambda c: F.forall(spans(c), lambda s: F.coalesce(s["label"].isin(*ENTITIES), F.lit(False))))
    aligned = F.forall(chunks, lambda c: F.forall(spans(c), lambda s: span(c, s)))
    return (
        F.when(record["source"].isNull(), "no source").when(record["risk"].isNotNull() & ~record["risk"].isin(*RISKS), "unknown risk")
        .when(F.exists(chunks, lambda c: c["text"].isNull()), "no text").when(~known, "unknown label").when(~aligned, "span not at its bounds")
    )


def read_records(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a broken line raises an error, and so does a record with a :func:`record_problem` unless ``validate`` is off."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r"))
    if validate:
        problem = record_problem(F.col("r"))
        parsed = parsed.select(F.when(problem.isNull(), F.col("r")).otherwise(F.raise_error(F.concat(problem, F.lit(": "), F.to_json("r"))).cast(f"struct<{RECORD_FIELDS}>")).alias("r"))
    return parsed.select("r.*")


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def valid_spans(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``spans_valid``: every span's text is the slice of the chunk's text at its bounds (true for no spans)."""
    ok = F.forall(F.coalesce(F.col(spans), F.array().cast(df.schema[spans].dataType)), lambda s: F.coalesce(F.substring(F.col(text), s["start_pos"] + 1, s["end_pos"] - s["start_pos"]) == s["text"], F.lit(False)))
    return df.withColumn("spans_valid", F.coalesce(ok, F.lit(False)))


def labelling_tasks(df: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006 - not changed
    """``keys`` and ``task``, the JSON of one labelling task per chunk with its rule-based predictions.

    ``df`` has source, chunk_id, text; null texts have no predictions.
    """
    results = F.transform(F.coalesce("__spans", F.array().cast(SPANS)), lambda s: F.struct(
        F.lit("entities").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"),
        F.struct(s["start_pos"].alias("start"), s["end_pos"].alias("end"), s["text"].alias("text"), F.array(s["label"]).alias("labels")).alias("value"),
    ))
    task = F.struct(F.struct("text", "source", "chunk_id").alias("data"), F.array(F.struct(F.lit("baseline").alias("model_version"), results.alias("result"))).alias("predictions"))
    return annotate(df, "text", "__spans").select(*keys, F.to_json(task, {"ignoreNullFields": "false"}).alias("task"))


def export_chunks(tasks: DataFrame) -> DataFrame:
    """(source, chunk_id, task_idx, text, spans): one row per exported task (task_idx, data, annotations); nothing is gathered.

    Results without labels are skipped, the first label counts, all annotators' results are merged; an absent source is
    'unknown', an absent chunk_id 0, an absent text empty.
    """
    results = F.flatten(F.transform(F.coalesce("annotations", F.array().cast(EXPORT_ANNOTATIONS)), lambda a: F.coalesce(a["result"], F.array().cast(EXPORT_RESULTS))))
    values = F.filter(F.transform(results, lambda r: r["value"]), lambda v: F.size(v["labels"]) > 0)
    spans = F.transform(values, lambda v: F.struct(F.coalesce(v["text"], F.lit("")).alias("text"), v["labels"][0].alias("label"), F.coalesce(v["start"], F.lit(0)).alias("start"), F.coalesce(v["end"], F.lit(0)).alias("end")))
    return tasks.select(F.coalesce("data.source", F.lit("unknown")).alias("source"), F.coalesce(F.col("data.chunk_id").cast("int"), F.lit(0)).alias("chunk_id"), "task_idx", F.coalesce("data.text", F.lit("")).alias("text"), spans.alias("spans"))


def parse_export(tasks: DataFrame) -> DataFrame:
    """(source, chunks, risk, first_task): :func:`export_chunks` as records, chunks sorted by chunk_id, then by task; risk is lost.

    A record is one row, so sources must fit in a row each; use :func:`export_chunks` where many tasks lack a source.
    Order sources by ``first_task`` for that of the export.
    """
    chunk = F.struct("chunk_id", "task_idx", "text", "spans")
    grouped = export_chunks(tasks).groupBy("source").agg(F.array_sort(F.collect_list(chunk)).alias("c"), F.min("task_idx").alias("first_task"))
    return grouped.select("source", F.transform("c", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), c["spans"].alias("spans"))).alias("chunks"), F.lit(None).cast("string").alias("risk"), "first_task")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of an export file (one JSON array), numbered in their order."""
    whole = spark.read.text(path, wholetext=True)
    tasks = whole.select(F.posexplode(F.from_json("value", f"array<{EXPORT_TASK}>")).alias("task_idx", "t"))
    return tasks.select("task_idx", "t.*")


def write_report(df: DataFrame, path: str) -> None:
    """The first row of a small report as readable JSON."""
    row = df.limit(1).toPandas().to_dict("records")
    Path(path).write_text(json.dumps(row[0] if row else {}, ensure_ascii=False, indent=2, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x)) + "\n", encoding="utf-8")
