"""Text in, entities and risk out: both classifiers in one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import LABELS, RISKS
from .functions.regex import once, words
from .operators import metrics
from .operators.bioes import PREDICTED, map_lists, spans_of_predictions
from .operators.lemma import word_spans
from .softmax import SoftmaxModel


def text_features(text: Column, max_words: int = 256) -> Column:
    """ARRAY<STRING>: the words and word pairs of the first ``max_words`` words of a text (the model's input length)."""
    def made(ws: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat(F.lit("p="), F.get(ws, i), F.lit(" "), F.get(ws, i + 1)))
        return F.concat(F.transform(ws, lambda w: F.concat(F.lit("w="), w)), F.when(F.size(ws) > 1, pairs).otherwise(F.array().cast("array<string>")))

    return once(F.slice(words(F.lower(text)), 1, max_words), made)


def word_feature_lists(found: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: for each of the words of a text (as ``word_spans`` gives them) itself, its shape, end and neighbours."""
    def feats(ws: Column, i: Column) -> Column:
        low = F.lower(F.get(ws, i)["text"])
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.get(ws, i)["text"], r"\p{Nd}", "9"), r"\p{Lu}", "A"), r"\p{Ll}+", "a")
        before, after = F.lower(F.get(ws, i - 1)["text"]), F.lower(F.get(ws, i + 1)["text"])
        return F.array(
            F.concat(F.lit("w="), low), F.concat(F.lit("s="), shape), F.concat(F.lit("e="), F.right(low, F.lit(3))),
            F.concat(F.lit("b="), F.coalesce(before, F.lit("^"))), F.concat(F.lit("n="), F.coalesce(after, F.lit("$"))),
        )

    return once(found, lambda ws: F.transform(ws, lambda _, i: feats(ws, i)))


class ReportAnalyzer:
    """Entities and risk of texts by two models; ``quantize`` gives their weights one byte each."""

    def __init__(self, ner: SoftmaxModel, risk: SoftmaxModel, quantize: bool = False, max_words: int = 256):
        self.ner, self.risk = (m.quantized() if quantize else m for m in (ner, risk))
        self.max_words = max_words

    def entities(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """``keys`` and ``spans`` (text, label, confidence), by the words' likeliest labels; null texts have none."""
        model = self.ner

        def spans(texts, features) -> list[dict]:
            probs = [model.probabilities(list(f)) for f in features]
            tags = [LABELS[int(p.argmax())] for p in probs]
            return [{"text": " ".join(texts[a:b]), "label": kind, "confidence": float(probs[a].max())} for a, b, kind in spans_of_predictions(tags)]

        w = df.select(*keys, word_spans(F.col(text)).alias("__words"))
        return map_lists(w, keys, [F.col("__words")["text"], word_feature_lists(F.col("__words"))], "spans", PREDICTED, spans)

    def risks(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``risk_pred`` and ``probabilities``, a map of the classes; null for null texts."""
        out = self.risk.predict(df, text_features(F.col(text), self.max_words), "__p")
        names = F.array(*[F.lit(x) for x in RISKS])
        return out.withColumn("risk_pred", F.get(names, metrics.argmax(F.col("__p")))).withColumn("probabilities", F.when(F.col("__p").isNotNull(), F.map_from_arrays(names, F.col("__p")))).drop("__p")

    def analyze(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """``keys``, ``spans``, ``risk_pred`` and ``probabilities`` of every text; ``keys`` must be unique."""
        return self.entities(df, keys, text).join(self.risks(df.select(*keys, text), text).drop(text), keys)
