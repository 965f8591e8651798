"""Tokens with lemmas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEMMAS
from ..functions.regex import SPACE, positions, words


def tokens(text: Column, overrides: bool = False) -> Column:
    """ARRAY<STRUCT<text, lemma>>: whitespace tokens and their lower case, or their lemma of the financial dictionary.

    Punctuation stays on the tokens.  The dictionary has a fixed size and is a literal map.
    """
    pairs = [F.lit(x) for item in LEMMAS.items() for x in item]
    table = F.create_map(*pairs)

    def token(w: Column) -> Column:
        low = F.lower(w)
        return F.struct(w.alias("text"), (F.coalesce(F.try_element_at(table, low), low) if overrides else low).alias("lemma"))

    return F.transform(words(text), token)


def word_spans(text: Column) -> Column:
    """ARRAY<STRUCT<text, start_pos, end_pos>> of the words of ``text``."""
    return positions(text, f"[^{SPACE}]+")


def explode_tokens(df: DataFrame, keys: list[str], text: str = "text", overrides: bool = False) -> DataFrame:
    """``keys``, word_idx (from 0), token, lemma."""
    return df.select(*keys, F.posexplode(tokens(F.col(text), overrides)).alias("word_idx", "t")).select(*keys, "word_idx", F.col("t.text").alias("token"), F.col("t.lemma").alias("lemma"))


@lru_cache(maxsize=1)
def linguistic_model() -> Callable[[str], list[tuple[str, str]]] | None:
    """(token, lemma) pairs by the Russian pipeline of an optional package, loaded once per worker; None where it is missing."""
    try:
        import spacy

        nlp = spacy.load("ru_core_news_md")
    except (ImportError, OSError):
        return None
    return lambda text: [(t.text, t.lemma_) for t in nlp(text) if not t.is_space]


def model_available(make: Callable[[], Callable | None] = linguistic_model) -> bool:
    """Whether ``make`` gives a model here."""
    return make() is not None


def linguistic_tokens(text: Column, make: Callable[[], Callable[[str], list[tuple[str, str]]] | None] = linguistic_model) -> Column:
    """ARRAY<STRUCT<text, lemma>> by the model that ``make`` gives on each worker, the financial dictionary going first.

    Where there is no model, tokens are split at whitespace and their lemma is their lower case.  Null for null.
    """

    @F.pandas_udf("array<struct<text: string, lemma: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            if model is None:
                yield pd.Series([None if t is None else [{"text": w, "lemma": w.lower()} for w in t.split()] for t in s], dtype=object)
            else:
                yield pd.Series([None if t is None else [{"text": w, "lemma": LEMMAS.get(w.lower(), m)} for w, m in model(t)] for t in s], dtype=object)

    return run(text)
