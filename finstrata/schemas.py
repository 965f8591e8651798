"""Schemas of the engine's tables, as DDL; JSON is never inferred."""

from __future__ import annotations

RECORD_SPANS = "array<struct<text: string, label: string, start: int, end: int>>"
RECORD_CHUNKS = f"array<struct<chunk_id: int, text: string, spans: {RECORD_SPANS}>>"
RECORD = f"source string, chunks {RECORD_CHUNKS}, risk string"
RECORD_FIELDS = f"source: string, chunks: {RECORD_CHUNKS}, risk: string"
SECTIONS = "array<struct<section_idx: int, page: int, block_type: string, text: string, cell_rows: array<array<string>>, y_top: double, y_bottom: double>>"
DOCUMENT = {"filename": "string", "document_type": "string", "sections": SECTIONS, "raw_text": "string", "metadata": "map<string, string>"}
EXPORT_RESULTS = "array<struct<value: struct<text: string, labels: array<string>, start: int, end: int>>>"
EXPORT_ANNOTATIONS = f"array<struct<result: {EXPORT_RESULTS}>>"
EXPORT_TASK = f"struct<data: struct<source: string, chunk_id: string, text: string>, annotations: {EXPORT_ANNOTATIONS}>"
SPANS = "array<struct<text: string, label: string, start_pos: int, end_pos: int>>"
