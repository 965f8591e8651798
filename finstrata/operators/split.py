"""Training and validation parts of exact sizes, and what depends on training steps and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def train_size(n: int, ratio: float = 0.85) -> int:
    """max(1, whole part of n times the training share), but at least one record is left for validation."""
    cut = max(1, int(n * ratio))
    return max(0, n - 1) if cut >= n else cut


def split_records(df: DataFrame, keys: list[str], ratio: float = 0.85, seed: int = 7) -> DataFrame:
    """``df`` with ``part`` ('train' or 'validation'); ``ratio`` is the training share.

    Rows are ordered by a seeded hash of ``keys`` (with the keys themselves on ties), so the parts are the same for
    equal seeds on any cluster, and exact in size.  The boundary is found by counting hash buckets, so no task ever
    sorts more than one bucket.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    d = df.withColumn("__h", h).withColumn("__b", F.shiftrightunsigned("__h", 52).cast("int"))
    sizes = d.groupBy("__b").agg(F.count("*").alias("__c"))
    total = sizes.agg(F.sum("__c").alias("__total"))
    before = sizes.withColumn("__before", F.sum("__c").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)))  # at most 4096 rows
    before = before.join(total).select("__b", F.coalesce("__before", F.lit(0)).alias("__before"), "__total")
    cut = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(ratio)))
    cut = F.when(cut >= F.col("__total"), F.greatest(F.lit(0), F.col("__total") - 1)).otherwise(cut)
    rank = F.row_number().over(W.partitionBy("__b").orderBy("__h", *keys)) + F.col("__before")
    out = d.join(F.broadcast(before), "__b").withColumn("part", F.when(rank <= cut, "train").otherwise("validation"))
    return out.drop("__h", "__b", "__before", "__total")


def warmup_rate(step: Column, warmup: int, total: int) -> Column:
    """The learning-rate factor: (step + 1) / warmup at first, then down to 0 in a straight line."""
    falling = F.greatest(F.lit(0.0), 1.0 - (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when((step < warmup) & F.lit(warmup > 0), (step + 1) / F.lit(float(max(1, warmup)))).otherwise(falling)


def best_epochs(scores: DataFrame, run: list[str], epoch: str = "epoch", score: str = "score", patience: int = 2) -> DataFrame:
    """``run``, best_epoch, best_score, epochs_run: training stops after ``patience`` epochs without strict improvement."""
    w = W.partitionBy(*run).orderBy(epoch)
    best_before = F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = scores.withColumn("__up", best_before.isNull() | (F.col(score) > best_before)).withColumn("__run", F.sum(F.col("__up").cast("int")).over(w))
    d = d.withColumn("__idle", F.row_number().over(W.partitionBy(*run, "__run").orderBy(epoch)) - 1)
    stop = F.min(F.when(F.col("__idle") >= patience, F.col(epoch))).over(W.partitionBy(*run))
    seen = d.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col(epoch) <= F.col("__stop")))
    return seen.groupBy(*run).agg(F.max_by(F.col(epoch), F.when(F.col("__up"), F.col(score))).alias("best_epoch"), F.max(score).alias("best_score"), F.count("*").alias("epochs_run"))
