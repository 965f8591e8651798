"""A linear softmax classifier over hashed text features, trained step by step on a bounded sample of labelled rows.

It has the training loop of sequence models: AdamW, a learning rate that warms up and then falls in a straight line,
gradients accumulated over several batches (the last, shorter group makes a step too), and early stopping that keeps the
best state.  Prediction is one Arrow pass over any number of rows.  ``ml.train_risk`` trains on unbounded data instead.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Settings
from .ml import Outcome

#: At most so many labelled rows are taken to the driver for training.
SAMPLE_ROWS = 100_000


def _places(features: Sequence[str], size: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(f.encode()) % size for f in features), np.int64, len(features))


@dataclass(frozen=True)
class SoftmaxModel:
    """``weights`` (hash size x classes, of floats or int8) times ``scales`` (one a class), and ``bias``."""

    weights: np.ndarray
    bias: np.ndarray
    scales: np.ndarray

    def logits(self, features: Sequence[str]) -> np.ndarray:
        """The class scores of one example; without features the bias."""
        if not len(features):
            return self.bias.astype(np.float64)
        rows = self.weights[_places(features, len(self.weights))].sum(axis=0, dtype=np.float64)
        return rows * self.scales / math.sqrt(len(features)) + self.bias

    def probabilities(self, features: Sequence[str]) -> np.ndarray:
        z = self.logits(features)
        e = np.exp(z - z.max())
        return e / e.sum()

    def quantized(self) -> SoftmaxModel:
        """The same model with weights of one byte."""
        scales = np.maximum(np.abs(self.weights).max(axis=0) / 127, 1e-12) * self.scales
        return SoftmaxModel(np.rint(self.weights * self.scales / scales).astype(np.int8), self.bias, scales)

    def predict(self, df: DataFrame, features: Column, to: str = "probs") -> DataFrame:
        """``df`` with ``to``, the class probabilities of each row's array of features; null for null."""
        src = df.drop(to).withColumn("__features", features)
        schema = T.StructType([*src.schema.fields[:-1], T.StructField(to, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                *kept, lists = b.columns
                probs = [None if x is None else self.probabilities(x).tolist() for x in lists.to_pylist()]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(probs, pa.list_(pa.float64()))], names=schema.names)

        return src.mapInArrow(run, schema)

    def save(self, path: str) -> None:
        np.savez_compressed(path, weights=self.weights, bias=self.bias, scales=self.scales)

    @staticmethod
    def load(path: str) -> SoftmaxModel:
        with np.load(path) as z:
            return SoftmaxModel(z["weights"], z["bias"], z["scales"])


def learning_rate(step: int, warmup: int, total: int) -> float:
    """The factor of the learning rate, as :func:`finstrata.operators.split.warmup_rate` has it."""
    if step < warmup:
        return (step + 1) / warmup
    return max(0.0, 1.0 - (step - warmup) / max(1, total - warmup))


class _AdamW:
    def __init__(self, shapes: list[tuple], rate: float, decay: float = 0.01):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def step(self, values: list[np.ndarray], grads: list[np.ndarray], factor: float) -> None:
        self.t += 1
        for x, g, m, v in zip(values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * factor * (m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) + self.decay * x)


def train(
    features: list[Sequence[str]], labels: Sequence[int], k: int, score: Callable[[SoftmaxModel], float], settings: Settings = Settings(),  # noqa: B008
    class_weights: Sequence[float] | None = None, size: int = 1 << 14, seed: int = 7,
) -> Outcome:
    """The best model by ``score``, with epoch, train_loss and score of every epoch run.

    ``epochs``, ``batch_size``, ``accumulation``, ``learning_rate``, ``warmup_ratio`` and ``patience`` come from ``settings``.
    A loss is weighted by its example's class; without examples nothing is learnt and the loss is 0.
    """
    y = np.asarray(labels, dtype=np.int64)
    places = [_places(f, size) for f in features]
    importance = np.ones(k) if class_weights is None else np.asarray(class_weights, dtype=np.float64)
    w, b = np.zeros((size, k)), np.zeros(k)
    batches = math.ceil(len(y) / settings.batch_size)
    total = math.ceil(batches / settings.accumulation) * settings.epochs
    warmup = int(total * settings.warmup_ratio)
    optimizer, rng = _AdamW([w.shape, b.shape], settings.learning_rate), np.random.default_rng(seed)
    out, idle, steps = Outcome(), 0, 0
    for epoch in range(1, settings.epochs + 1):
        order, losses = rng.permutation(len(y)), []
        grads = [np.zeros_like(w), np.zeros_like(b)]
        for n in range(batches):
            batch = order[n * settings.batch_size : (n + 1) * settings.batch_size]
            weight = importance[y[batch]].sum() or 1.0
            loss = 0.0
            for i in batch:
                at, share = places[i], 1 / math.sqrt(max(1, len(places[i])))
                z = w[at].sum(axis=0) * share + b
                p = np.exp(z - z.max())
                p /= p.sum()
                part = importance[y[i]] / weight
                loss -= part * math.log(max(p[y[i]], 1e-300))
                g = p * part / settings.accumulation
                g[y[i]] -= part / settings.accumulation
                np.add.at(grads[0], at, g * share)
                grads[1] += g
            losses.append(loss)
            if (n + 1) % settings.accumulation == 0 or n + 1 == batches:
                optimizer.step([w, b], grads, learning_rate(steps, warmup, total))
                steps += 1
                for g in grads:
                    g[:] = 0
        model = SoftmaxModel(w.astype(np.float32), b.copy(), np.ones(k))
        s = float(score(model))
        out.history.append({"epoch": epoch, "train_loss": sum(losses) / len(losses) if losses else 0.0, "score": s})
        if s > out.best_score:
            out.best_score, out.best_epoch, out.best_model, idle = s, epoch, model, 0
        else:
            idle += 1
            if idle >= settings.patience:
                break
    return out


def sample(df: DataFrame, features: str, label: str, rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[list, list]:
    """(features, labels) of at most ``rows`` labelled rows, the same ones for a seed."""
    kept = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(features, label)
    taken = kept.orderBy(F.xxhash64(F.lit(seed), features, label)).limit(rows).collect()
    return [r[0] for r in taken], [r[1] for r in taken]
