"""The stages in one plan: normalise, remove noise, chunk, tokenise; and chunks to slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.chunk import chunk_sections
from ..operators.lemma import tokens
from ..operators.noise import normalize_sections, remove_noise
from ..operators.resolve import resolve_slots
from ..operators.spans import annotate


def clean_sections(sections: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Normalised sections without noise."""
    return remove_noise(normalize_sections(sections), (), settings.repeat_ratio, settings.header_zone, settings.footer_zone)


def preprocess(sections: DataFrame, settings: Settings = Settings(), overrides: bool = False) -> DataFrame:  # noqa: B008
    """(doc_id, chunk_id, text, section_anchor, page, tokens) of documents given by their sections."""
    chunks = chunk_sections(clean_sections(sections, settings), settings.chunk_words, settings.chunk_overlap)
    return chunks.withColumn("tokens", tokens(F.col("text"), overrides))


def extract_slots(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Metric slots of chunks, by the rule-based spans of their text."""
    return resolve_slots(annotate(chunks, text, "__spans"), keys, text, "__spans")
