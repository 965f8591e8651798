"""Classifiers trained here: risk of records and labels of words.

They are linear models over hashed features, with the same inputs, outputs and metrics as pretrained sequence models
would have; they do not claim those models' quality.  ``predict_with`` runs any other model as a batch function that
is loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .constants import IGNORED_ID, LABELS, RISKS
from .operators import metrics
from .operators.bioes import id_risk


@dataclass
class Outcome:
    """The best model by its validation score, its number, and the scores of all that were tried."""

    best_score: float = float("-inf")
    best_epoch: int = 0
    best_model: PipelineModel | None = None
    history: list[dict] = field(default_factory=list)


def train_with_patience(fit: Callable[[int], PipelineModel], score: Callable[[PipelineModel], float], epochs: int = 6, patience: int = 2) -> Outcome:
    """Fit 1, 2, ... until ``patience`` fits in a row bring no strict improvement; the best model is kept itself."""
    out, idle = Outcome(), 0
    for epoch in range(1, epochs + 1):
        model = fit(epoch)
        s = score(model)
        out.history.append({"epoch": epoch, "score": s})
        if s > out.best_score:
            out.best_score, out.best_epoch, out.best_model, idle = s, epoch, model, 0
        else:
            idle += 1
            if idle >= patience:
                break
    return out


def risk_pipeline(iterations: int = 20, features: int = 1 << 14) -> Pipeline:
    words = RegexTokenizer(inputCol="text", outputCol="__w", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    pairs = NGram(n=2, inputCol="__w", outputCol="__p")
    return Pipeline(stages=[
        words, pairs, HashingTF(inputCol="__w", outputCol="__fw", numFeatures=features), HashingTF(inputCol="__p", outputCol="__fp", numFeatures=features),
        _assembler(["__fw", "__fp"]), LogisticRegression(featuresCol="__f", labelCol="label", maxIter=iterations, regParam=1e-3, family="multinomial"),
    ])


def _assembler(columns: list[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="__f")


def train_risk(examples: DataFrame, epochs: int = 3, patience: int = 2, validation: DataFrame | None = None) -> Outcome:
    """A risk classifier of (text, risk_id); further epochs have more iterations, macro F1 on ``validation`` decides."""
    train = examples.withColumn("label", F.col("risk_id").cast("double"))
    held = validation if validation is not None else examples
    return train_with_patience(lambda e: risk_pipeline(10 * e).fit(train), lambda m: _macro(predict_risk(m, held), len(RISKS)), epochs, patience)


def predict_risk(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with probs, pred_id, risk_pred."""
    out = model.transform(df).withColumn("probs", vector_to_array("probability"))
    out = out.withColumn("pred_id", metrics.argmax(F.col("probs"))).withColumn("risk_pred", id_risk(F.col("pred_id")))
    return out.select(*df.columns, "probs", "pred_id", "risk_pred")


def _macro(df: DataFrame, k: int) -> float:
    return float(metrics.macro_f1(df, k, "risk_id" if "risk_id" in df.columns else "label_id").first()["macro_f1"])


def word_features(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` (keys, word_idx, word) with ``feats``: the word, its shape, ends, and neighbours."""
    w = W.partitionBy(*keys).orderBy("word_idx")
    low = F.lower("word")
    shape = F.regexp_replace(F.regexp_replace("word", r"\p{Nd}", "9"), r"\p{Lu}", "A")
    d = words.withColumn("__l", low).withColumn("__b", F.lag(low).over(w)).withColumn("__n", F.lead(low).over(w))
    feats = F.array(
        F.concat(F.lit("w="), "__l"), F.concat(F.lit("s="), F.regexp_replace(shape, r"\p{Ll}+", "a")), F.concat(F.lit("e="), F.expr("right(__l, 3)")),
        F.concat(F.lit("b="), F.coalesce("__b", F.lit("^"))), F.concat(F.lit("n="), F.coalesce("__n", F.lit("$"))),
    )
    return d.withColumn("feats", feats).drop("__l", "__b", "__n")


def train_ner(words: DataFrame, keys: list[str], iterations: int = 20, features: int = 1 << 15) -> PipelineModel:
    """A word classifier of (keys, word_idx, word, label_id), classes weighted by inverse frequency."""
    weights = metrics.class_weights(words.withColumn("label_id", F.coalesce("label_id", F.lit(IGNORED_ID))), len(LABELS))
    rows = word_features(words.where(F.col("label_id").isNotNull()), keys).join(F.broadcast(weights.withColumnRenamed("class_id", "label_id")), "label_id")
    rows = rows.withColumn("label", F.col("label_id").cast("double"))
    return Pipeline(stages=[
        HashingTF(inputCol="feats", outputCol="__f", numFeatures=features),
        LogisticRegression(featuresCol="__f", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1e-4, family="multinomial"),
    ]).fit(rows)


def predict_ner(model: PipelineModel, words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` with pred (the label) and prob."""
    out = model.transform(word_features(words, keys)).withColumn("__p", vector_to_array("probability"))
    names = F.array(*[F.lit(x) for x in LABELS])
    return out.select(*words.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"), F.array_max("__p").alias("prob"))


def evaluate_ner(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """The entity report of predicted words."""
    return metrics.entity_report(predicted.withColumnRenamed("label", "gold"), keys)


def predict_with(make: Callable[[], Callable], inputs: list[Column], return_type: str, batch_size: int = 32) -> Column:
    """The predictions of any model: ``make`` loads it once per worker and gives a function of numpy batches."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make, return_type=return_type, batch_size=batch_size)(*inputs)
