"""Softmax classifier fitted by mini-batches with Adam (G7, G12), on the cluster or many small ones at once."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.draws import shuffle_key
from ..session import checkpoint_dir, forget_later

#: Fixed values of the optimiser: decay of both moments, and the guard of the division.
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


class Settings(NamedTuple):
    """``batches`` per epoch: the training rows are dealt into so many."""

    n_classes: int
    batches: int = 10
    epochs: int = fv.PROBE_EPOCHS
    learning_rate: float = fv.PROBE_LEARNING_RATE
    weight_decay: float = fv.PROBE_WEIGHT_DECAY
    seed: int = fv.PROBE_SEED


class SoftmaxModel(NamedTuple):
    """``weights`` (classes x dim) and ``bias`` of a fit, and a row per epoch of ``history``: epoch from 1,
    mean batch loss, and the loss and accuracy on the validation rows (None without any)."""

    weights: np.ndarray
    bias: np.ndarray
    history: list[tuple[int, float, float | None, float | None]]


class Adam:
    """Weights and bias in one array (classes x (dim + 1)) and their moments."""

    def __init__(self, dim: int, s: Settings):
        bound = 1 / np.sqrt(max(dim, 1))
        self.theta = np.random.default_rng(s.seed).uniform(-bound, bound, (s.n_classes, dim + 1))
        self.m, self.v, self.t, self.s = np.zeros_like(self.theta), np.zeros_like(self.theta), 0, s

    def step(self, gradient: np.ndarray) -> None:
        g = gradient + self.s.weight_decay * self.theta
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        m, v = self.m / (1 - BETA1 ** self.t), self.v / (1 - BETA2 ** self.t)
        self.theta = self.theta - self.s.learning_rate * m / (np.sqrt(v) + ADAM_EPS)


def probabilities(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = x @ theta[:, :-1].T + theta[:, -1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sums(theta: np.ndarray, x: np.ndarray, y: np.ndarray, gradient: bool) -> tuple[np.ndarray | None, float, int]:
    """Over the rows: the summed gradient (classes x (dim + 1)), the summed loss, the right answers."""
    p = probabilities(theta, x)
    at = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[at, y], 1e-300)).sum())
    right = int((p.argmax(axis=1) == y).sum())
    if not gradient:
        return None, loss, right
    p[at, y] -= 1
    return np.c_[p.T @ x, p.sum(axis=0)], loss, right


def batch_order(s: Settings, epoch: int) -> list[int]:
    """The order in which an epoch goes through the batches."""
    return sorted(range(s.batches), key=lambda b: hashlib.md5(f"{s.seed}:{epoch}:{b}".encode()).hexdigest())


def _totals(rows: DataFrame, theta: np.ndarray, gradient: bool) -> tuple[np.ndarray | None, float, int, int]:
    """``sums`` over a table ``act, label``: one row of sums per task, added up in one aggregate."""
    size = theta.size if gradient else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size + 3), 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                g, loss, right = sums(theta, x, b.column(1).to_numpy(zero_copy_only=False), gradient)
                total += np.r_[g.ravel() if gradient else [], loss, right, b.num_rows]
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

    parts = rows.select("act", "label").mapInArrow(run, "s array<double>")
    # grouped by a constant, as the summarizer fails on no rows at all
    got = parts.groupBy(F.lit(1)).agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).first()
    if got is None:
        return None, 0.0, 0, 0
    total = np.array(got["s"])
    return total[:size].reshape(theta.shape) if gradient else None, float(total[-3]), int(total[-2]), int(total[-1])


def fit_minibatch(train: DataFrame, validation: DataFrame | None, s: Settings, key: str = "id", act: str = "act",
                  label: str = "label") -> SoftmaxModel:
    """Softmax regression by Adam over mini-batches, with its training history.

    Rows are dealt into ``s.batches`` batches by a seeded hash of ``key``, written once, a folder per batch
    in the shared storage; every epoch visits the batches in a seeded order of its own, and a step reads
    one batch and adds up its gradient in one aggregate. The driver holds classes x dim numbers. So an epoch
    reads the rows once whatever their number, and neither the partitioning nor a lost executor changes
    what a batch holds. The batch size is the rows over ``s.batches``; empty batches are passed over. Rows
    with a null vector, label or key are left out; without any training row the fit fails. After each
    epoch one aggregate over ``validation`` gives its mean loss and accuracy.
    """
    spark = train.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(act).cast("array<double>").alias("act"),
                         F.col(label).cast("int").alias("label")).dropna()

    path = os.path.join(checkpoint_dir(spark), f"fit-{s.seed}-{os.urandom(8).hex()}")
    forget_later(path)
    bucket = F.conv(F.substring(shuffle_key(s.seed, F.col("id")), 1, 8), 16, 10).cast("bigint") % s.batches
    dealt = rows(train).withColumn("batch", bucket.cast("int"))
    dealt.write.partitionBy("batch").parquet(os.path.join(path, "train"))
    stored = spark.read.schema(dealt.schema).parquet(os.path.join(path, "train"))
    first = stored.agg(F.max(F.size("act")).alias("dim"), F.max("label").alias("top"), F.min("label").alias("low")).first()
    if first["dim"] is None:
        raise ValueError("no training rows")
    if not 0 <= first["low"] <= first["top"] < s.n_classes:
        raise ValueError(f"labels must be 0 to {s.n_classes - 1}")
    held = None
    if validation is not None:
        rows(validation).write.parquet(os.path.join(path, "validation"))
        held = spark.read.parquet(os.path.join(path, "validation"))
    adam, history = Adam(first["dim"], s), []
    for epoch in range(1, s.epochs + 1):
        losses = []
        for b in batch_order(s, epoch):
            gradient, loss, _, n = _totals(stored.where(F.col("batch") == b), adam.theta, True)
            if n:
                adam.step(gradient / n)
                losses.append(loss / n)
        _, loss, right, n = _totals(held, adam.theta, False) if held is not None else (None, 0.0, 0, 0)
        history.append((epoch, float(np.mean(losses)), loss / n if n else None, right / n if n else None))
    return SoftmaxModel(adam.theta[:, :-1], adam.theta[:, -1], history)


def history_table(spark: SparkSession, model: SoftmaxModel) -> DataFrame:
    """``epoch, train_loss, val_loss, val_accuracy`` of a fit, a row per epoch."""
    return spark.createDataFrame(model.history, "epoch int, train_loss double, val_loss double, val_accuracy double")


def fit_rows(ids: list, x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """The same fit over rows in memory: classes x (dim + 1)."""
    batch = np.array([int(hashlib.md5(f"{s.seed}:{i}".encode()).hexdigest()[:8], 16) % s.batches for i in ids])
    adam = Adam(x.shape[1], s)
    for epoch in range(1, s.epochs + 1):
        for b in batch_order(s, epoch):
            mine = batch == b
            if mine.any():
                gradient, _, _ = sums(adam.theta, x[mine], y[mine], True)
                adam.step(gradient / mine.sum())
    return adam.theta


def auc(score: np.ndarray, positive: np.ndarray) -> float | None:
    """Area under the ROC curve by rank sums, ties counting one half; None without both classes."""
    n_pos, n_neg = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_neg:
        return None
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((rank[positive].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg))


def metrics(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float | None]:
    """Accuracy, unweighted mean F1 and (mean one-vs-rest) AUC of scored rows."""
    p = probabilities(theta, x)
    guess = p.argmax(axis=1)
    f1 = []
    for c in range(len(theta)):
        hit = int(((guess == c) & (y == c)).sum())
        either = int((guess == c).sum() + (y == c).sum())
        f1.append(2 * hit / either if either else 0.0)
    areas = [auc(p[:, c], y == c) for c in (range(len(theta)) if len(theta) > 2 else [1])]
    known = [a for a in areas if a is not None]
    return float((guess == y).mean()), float(np.mean(f1)), float(np.mean(known)) if known else None
