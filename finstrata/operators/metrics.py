"""Quality of predictions: confusion, macro F1, Brier score, calibration, entity scores; and class weights.

Inputs are tables of one row per example; rows with null classes are left out.  Empty tables give zeros, as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import IGNORED_ID
from ..session import cut


def _classes(df: DataFrame, k: int, name: str) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias(name))


def confusion_matrix(df: DataFrame, k: int, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """(true_id, pred_id, n) for all k x k pairs, absent ones with 0.  The grid is k x k, whatever the data."""
    return _full_grid(df.groupBy(F.col(true).alias("true_id"), F.col(pred).alias("pred_id")).agg(F.count("*").alias("n")), k)


def _full_grid(counts: DataFrame, k: int) -> DataFrame:
    grid = counts.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("true_id"), (F.col("id") % k).cast("int").alias("pred_id"))
    return grid.join(counts, ["true_id", "pred_id"], "left").select("true_id", "pred_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_scores(confusion: DataFrame) -> DataFrame:
    """(class_id, precision, recall, f1) of every class; a division by zero gives 0."""
    tp = F.sum(F.when((F.col("true_id") == F.col("c")) & (F.col("pred_id") == F.col("c")), F.col("n")).otherwise(0))
    pairs = confusion.select("true_id", "pred_id", "n", F.explode(F.array_distinct(F.array("true_id", "pred_id"))).alias("c"))
    per = pairs.groupBy(F.col("c").alias("class_id")).agg(tp.alias("tp"), F.sum(F.when(F.col("pred_id") == F.col("c"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("true_id") == F.col("c"), F.col("n")).otherwise(0)).alias("t"))
    scored = per.select("class_id", _ratio(F.col("tp"), F.col("p")).alias("precision"), _ratio(F.col("tp"), F.col("t")).alias("recall"))
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(df: DataFrame, k: int, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """(macro_precision, macro_recall, macro_f1), the means over all k classes."""
    s = class_scores(confusion_matrix(df, k, true, pred))
    return s.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def _squares(true: Column, probs: Column) -> Column:
    """The squared distance of ``probs`` to the unit vector of the true class."""
    parts = F.transform(probs, lambda p, i: F.pow(p - (i == true).cast("double"), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def brier_score(df: DataFrame, true: str = "true_id", probs: str = "probs") -> DataFrame:
    """(brier): the mean over examples of the squared distances to the true class's unit vector; 0 for no examples."""
    return df.agg(F.coalesce(F.avg(_squares(F.col(true), F.col(probs))), F.lit(0.0)).alias("brier"))


def argmax(probs: Column) -> Column:
    """The place of the largest probability, the first on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def calibration_error(df: DataFrame, bins: int = 10, true: str = "true_id", probs: str = "probs") -> DataFrame:
    """(ece): over equal-width confidence bins, the weighted distances of accuracy and mean confidence; 0 for no examples."""
    conf = F.array_max(probs).cast("double")
    binned = df.select(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"), conf.alias("c"), (argmax(F.col(probs)) == F.col(true)).cast("double").alias("hit"))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("c").alias("conf"))
    return per.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def risk_metrics(df: DataFrame, k: int = 3, bins: int = 10, true: str = "true_id", probs: str = "probs") -> DataFrame:
    """One row: n, accuracy, macro scores, brier, ece, and the confusion matrix as a list of rows.

    One pass sums the examples up by true class, predicted class and confidence bin; all figures come from these sums.
    """
    p = F.col(probs)
    conf = F.array_max(p).cast("double")
    rows = df.select(F.col(true).cast("int").alias("true_id"), argmax(p).alias("pred_id"), F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"), conf.alias("c"), _squares(F.col(true), p).alias("b"))
    sums = cut(rows.groupBy("true_id", "pred_id", "bin").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("b").alias("b")))
    hits = F.sum(F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0))
    out = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(hits / F.sum("n"), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum("b") / F.sum("n"), F.lit(0.0)).alias("brier"))
    per_bin = sums.groupBy("bin").agg(F.sum("n").alias("n"), F.abs(hits - F.sum("c")).alias("off"))
    ece = per_bin.agg(F.coalesce(F.sum("off") / F.sum("n"), F.lit(0.0)).alias("ece"))
    counts = sums.groupBy("true_id", "pred_id").agg(F.sum("n").alias("n"))
    grid = _full_grid(counts, k)
    scores = class_scores(grid).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    lines = grid.groupBy("true_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pred_id", "n"))), lambda x: x["n"]).alias("r"))
    table = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("true_id", "r"))), lambda x: x["r"]).alias("confusion"))
    for part in (ece, scores, table):
        out = out.join(part)  # each is one row
    return out.select("n", "accuracy", "macro_precision", "macro_recall", "macro_f1", "brier", "ece", "confusion")


def _entity_starts(label: str, name: str, w) -> dict[str, Column]:
    """Columns ``<name>_t``, ``<name>_y`` (edge and kind) and ``<name>_n``, the number of the entity, over a sequence's window."""
    tag, kind = F.substring(F.col(label), 1, 1), F.regexp_replace(F.col(label), "^[^-]*-?", "")
    before, before_kind = F.coalesce(F.lag(tag).over(w), F.lit("O")), F.coalesce(F.lag(kind).over(w), F.lit(""))
    begins = tag.isin("B", "S") | (before.isin("E", "S", "O") & tag.isin("I", "E")) | ((tag != "O") & (before_kind != kind))
    return {f"{name}_t": tag, f"{name}_y": kind, f"{name}_b": begins.cast("int")}


def entities(df: DataFrame, seq: list[str], idx: str, labels: dict[str, str]) -> DataFrame:
    """``seq``, which, entity, first, last: the entities of the label columns ``labels`` (name to column), by the lenient chunk rules.

    A change of kind begins and ends entities, as do B, S and E and the border of O; BIOES and BIO alike.  All label
    columns share one window over the sequences, whose partitioning the grouping then keeps.
    """
    d = df.select(*seq, F.col(idx).alias("__i"), *[F.col(c).alias(f"__{k}") for k, c in labels.items()])
    w = W.partitionBy(*seq).orderBy("__i")
    for k in labels:
        d = d.withColumns(_entity_starts(f"__{k}", f"__{k}", w))
    d = d.withColumns({f"__{k}_n": F.sum(f"__{k}_b").over(w) for k in labels})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(f"__{k}_t").alias("t"), F.col(f"__{k}_y").alias("y"), F.col(f"__{k}_n").alias("n")) for k in labels]))
    rows = d.select(*seq, "__i", each.alias("e")).where("e.t <> 'O'").select(*seq, "__i", "e.which", "e.y", "e.n")
    return rows.groupBy(*seq, "which", "n").agg(F.min_by("y", "__i").alias("entity"), F.min("__i").alias("first"), F.max("__i").alias("last")).drop("n")


def entity_report(df: DataFrame, seq: list[str], idx: str = "word_idx", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(entity, precision, recall, f1, support) per entity and as micro avg, macro avg, weighted avg.

    Rows with a null gold label are ignored positions and left out first.  Entities match by sequence, kind and bounds.
    """
    kept = df.where(F.col(gold).isNotNull())
    found = entities(kept, seq, idx, {"gold": gold, "pred": pred})
    both = found.groupBy(*seq, "entity", "first", "last").agg(F.max((F.col("which") == "gold").cast("int")).alias("g"), F.max((F.col("which") == "pred").cast("int")).alias("p"))
    per = both.groupBy("entity").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("support"))
    per = cut(per)  # one row per kind of entity, read four times below
    pr, rc = _ratio(F.col("tp"), F.col("np")), _ratio(F.col("tp"), F.col("support"))
    scored = per.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ["entity", "precision", "recall", "f1", "support"]
    total = per.agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("support").alias("support"))
    micro = total.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("entity", F.lit("micro avg"))
    macro = scored.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols[1:4]], F.sum("support").alias("support")).withColumn("entity", F.lit("macro avg"))
    weighted = scored.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols[1:4]], F.sum("support").alias("support")).withColumn("entity", F.lit("weighted avg"))
    return scored.select(cols).unionByName(micro.select(cols)).unionByName(macro.select(cols)).unionByName(weighted.select(cols))


def class_weights(df: DataFrame, k: int, label: str = "label_id", ignored: int = IGNORED_ID) -> DataFrame:
    """(class_id, weight): inverse frequencies with mean 1 over the classes present; absent ones weigh 1."""
    counts = df.where(F.col(label) != ignored).groupBy(F.col(label).alias("class_id")).agg(F.count("*").alias("n"))
    inverse = counts.select("class_id", (1.0 / F.col("n")).alias("inv"))
    total = inverse.agg(F.count("*").alias("present"), F.sum("inv").alias("total"))
    scaled = inverse.join(F.broadcast(total)).select("class_id", (F.col("inv") * F.col("present") / F.col("total")).alias("w"))
    return _classes(df, k, "class_id").join(scaled, "class_id", "left").select("class_id", F.coalesce("w", F.lit(1.0)).alias("weight"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))
