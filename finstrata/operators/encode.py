"""Training examples of a token classifier and a text classifier: word pieces with aligned labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORED_ID, LABELS
from .bioes import label_words, risk_id


def pieces_of(word: str, vocab: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Greedy longest-match word pieces of one word; the whole word is unknown where none fits."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        end = len(word)
        while end > at and ("##" if at else "") + word[at:end] not in vocab:
            end -= 1
        if end == at:
            return [unknown]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def basic_words(text: str, lower: bool = True) -> list[tuple[str, int]]:
    """(word, place) of a text: split at blanks and around punctuation."""
    out, start = [], None
    for i, ch in enumerate(text):
        punct = unicodedata.category(ch).startswith("P") or ch in "$+<=>^`|~"
        if ch.isspace() or punct:
            if start is not None:
                out.append((text[start:i], start))
                start = None
            if punct:
                out.append((ch, i))
        elif start is None:
            start = i
    if start is not None:
        out.append((text[start:], start))
    return [(w.lower() if lower else w, i) for w, i in out]


def encode_words(text: str, starts: list[int], ends: list[int], labels: list[str], vocab: dict[str, int], max_length: int) -> tuple[list[int], list[int], list[int]]:
    """(ids, mask, label ids) of one text, cut and padded to ``max_length``; labels are aligned by character offsets."""
    number = {x: i for i, x in enumerate(LABELS)}
    ids, tags = [], []
    last, word = -1, 0
    for w, at in basic_words(text):
        while word < len(ends) and ends[word] <= at:
            word += 1
        label = labels[word] if word < len(labels) and starts[word] <= at else "O"
        for p in pieces_of(w, vocab):
            first = word != last
            tag = label if first or label[:1] not in "BES" else "I" + label[1:]
            ids.append(vocab.get(p, vocab["[UNK]"]))
            tags.append(number[tag])
            last = word
    ids = [vocab["[CLS]"], *ids[: max_length - 2], vocab["[SEP]"]]
    tags = [IGNORED_ID, *tags[: max_length - 2], IGNORED_ID]
    pad = max_length - len(ids)
    return ids + [vocab["[PAD]"]] * pad, [1] * len(ids) + [0] * pad, tags + [IGNORED_ID] * pad


def ner_examples(df: DataFrame, keys: list[str], vocab: dict[str, int], max_length: int = 128, text: str = "text", spans: str = "spans") -> DataFrame:
    """``keys``, input_ids, attention_mask, labels of every chunk (null texts as empty).

    ``vocab`` maps pieces to ids and has [PAD], [UNK], [CLS], [SEP]; its size is the vocabulary's, not the data's.
    """
    from .bioes import bioes_labels
    from .lemma import word_spans

    span_type = "array<struct<text:string,label:string,start_pos:int,end_pos:int>>"
    src = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__t"), F.col(spans).cast(span_type).alias("__s"))
    src = src.withColumn("__w", word_spans(F.col("__t"))).withColumn("__l", bioes_labels(F.col("__w"), F.col("__s")))

    kept = src.select(*keys, F.col("__t"), F.col("__w")["start_pos"].alias("__a"), F.col("__w")["end_pos"].alias("__b"), F.col("__l"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keys)]) + ", input_ids array<int>, attention_mask array<int>, labels array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [encode_words(*r, vocab, max_length) for r in zip(b["__t"], b["__a"], b["__b"], b["__l"], strict=True)]
            made = pd.DataFrame(rows, columns=["input_ids", "attention_mask", "labels"], index=b.index)
            yield pd.concat([b[keys], made], axis=1)

    return kept.mapInPandas(run, schema)


def ner_words(df: DataFrame, keys: list[str]) -> DataFrame:
    """The word-level examples: words with their labels and label ids."""
    from .bioes import label_id

    return label_words(df, keys).withColumn("label_id", label_id(F.col("label")))


def risk_examples(chunks: DataFrame, key: str = "source") -> DataFrame:
    """(key, text, risk, risk_id) of every record with a risk: its chunks' texts in order, joined by line breaks.

    ``chunks`` has key, chunk_id, text, risk.  Null texts are left out.  What is gathered is one record's text.
    """
    from pyspark.sql import Column

    parts: Column = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("chunk_id", "text"))))
    g = chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.max("risk").alias("risk"))
    return g.where(F.col("risk").isNotNull()).withColumn("risk_id", risk_id(F.col("risk")))

