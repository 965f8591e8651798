"""Queries of the general data problems (units, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import flatten_records
from ..operators.units import matching_amounts, to_common_units
from ..session import table


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_common_units(table(spark, sf_dir, "metric_slots"), table(spark, sf_dir, "fx_rates"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of slots that state the same figure."""
    return matching_amounts(_amounts(spark, sf_dir), ["report_id", "metric", "period"], "slot_id")


def p2_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot with its amount in the common unit."""
    return _amounts(spark, sf_dir).select("slot_id", "amount", "amount_unit").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span object of every readable record."""
    bridge = flatten_records(table(spark, sf_dir, "annotation_lines"), wanted=["span_bridge"]).span_bridge
    return bridge.select("line_id", F.col("chunk_pos").cast("int").alias("chunk_pos"), F.col("span_pos").cast("int").alias("span_pos"))


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span table: occurrences with their parents' keys, joined to the objects stored once."""
    t = flatten_records(table(spark, sf_dir, "annotation_lines"), wanted=["span_bridge", "span_objects"])
    return t.span_bridge.join(t.span_objects, "span_node").select("line_id", "chunk_pos", "span_pos", "text", "label", "start_pos", "end_pos")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table."""
    t = flatten_records(table(spark, sf_dir, "annotation_lines"), wanted=["records"])
    return t.records.select("line_id", "source", "risk")


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table: occurrences with their parents' keys, joined to the objects stored once."""
    t = flatten_records(table(spark, sf_dir, "annotation_lines"), wanted=["chunk_bridge", "chunk_objects"])
    return t.chunk_bridge.join(t.chunk_objects, "chunk_node").select("line_id", "chunk_pos", "chunk_id", "text")


QUERIES = {"p2_found": p2_found, "p2_amounts": p2_amounts, "p3_found": p3_found, "p3_spans": p3_spans, "p3_records": p3_records, "p3_chunks": p3_chunks}

# Objects and lists may be given as JSON strings, an object in place of a list; a record may be wrapped.
_LIST = """CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'OBJECT' THEN json_array({x}) WHEN 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN
    CASE json_type(({x} ->> '$')::JSON) WHEN 'ARRAY' THEN ({x} ->> '$')::JSON WHEN 'OBJECT' THEN json_array(({x} ->> '$')::JSON) END END END"""
_SPANS = f"""WITH v AS MATERIALIZED (SELECT DISTINCT line_id, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM annotation_lines WHERE contains(raw_line, '{{')),
    r AS (SELECT line_id, CASE WHEN json_type(j -> '$.record') = 'OBJECT' AND json_type(j -> '$.chunks') IS NULL THEN j -> '$.record' ELSE j END AS r FROM v WHERE json_type(j) = 'OBJECT'),
    w AS MATERIALIZED (SELECT line_id, {_LIST.format(x="(r -> '$.chunks')")} AS l FROM r),
    c AS (SELECT line_id, unnest(range(json_array_length(l)::BIGINT)) AS chunk_pos, l FROM w WHERE json_array_length(l) > 0),
    d AS (SELECT line_id, chunk_pos, json_extract(l, '$[' || chunk_pos || '].spans') AS s FROM c WHERE json_type(json_extract(l, '$[' || chunk_pos || ']')) = 'OBJECT'),
    e AS MATERIALIZED (SELECT line_id, chunk_pos, {_LIST.format(x="s")} AS l FROM d),
    f AS (SELECT line_id, chunk_pos, unnest(range(json_array_length(l)::BIGINT)) AS span_pos, l FROM e WHERE json_array_length(l) > 0),
    g AS (SELECT line_id, chunk_pos::INT AS chunk_pos, span_pos::INT AS span_pos, json_extract(l, '$[' || span_pos || ']') AS s FROM f)"""

ORACLES = {
    "p3_records": f"{_SPANS} SELECT line_id, r ->> '$.source' AS source, r ->> '$.risk' AS risk FROM r",
    "p3_chunks": f"""{_SPANS} SELECT line_id, chunk_pos::INT AS chunk_pos, try_cast(c ->> '$.chunk_id' AS INT) AS chunk_id, c ->> '$.text' AS text
        FROM (SELECT line_id, chunk_pos, json_extract(l, '$[' || chunk_pos || ']') AS c FROM c) WHERE json_type(c) = 'OBJECT'""",
    "p3_found": f"{_SPANS} SELECT line_id, chunk_pos, span_pos FROM g WHERE json_type(s) = 'OBJECT'",
    "p3_spans": f"""{_SPANS} SELECT line_id, chunk_pos, span_pos, s ->> '$.text' AS text, s ->> '$.label' AS label, try_cast(s ->> '$.start' AS INT) AS start_pos,
        try_cast(s ->> '$.end' AS INT) AS end_pos FROM g WHERE json_type(s) = 'OBJECT'""",
}
