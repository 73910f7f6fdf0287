"""The softmax head trained by mini-batches: AdamW with warm-up, linear decay and dropout.

A batch is the rows whose seeded hash names it, so batches and dropout masks are the same however the rows lie. The
rows of an epoch are shuffled once into partitions by batch, and a step is a job over the few partitions of its batch. Every
task leaves the summed gradient of its rows, and the optimiser's few matrices stay on the driver. The batch size counts the rows of all tasks together: large tables want large batches, as a step is
a job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentigrid.config import HeadTraining
from sentigrid.functions import scores as sc
from sentigrid.operators.naive_bayes import encode_label

# --- fixed values: the optimiser -----------------------------------------------------------
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8
# --- end of fixed values ---------------------------------------------------------------------

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass
class LinearHead:
    """Weights (dimension + 1 rows, the last one the bias; a column per class) on top of given vectors."""

    classes: list[str]
    weights: np.ndarray

    def scores(self, vector: Column) -> Column:
        """The class scores of an array<float> in class order, in the JVM."""
        def dot(column: np.ndarray) -> Column:
            constants = F.array(*[F.lit(float(w)) for w in column[:-1]])
            return F.aggregate(F.zip_with(vector, constants, lambda x, w: x.cast("double") * w), F.lit(float(column[-1])),
                               lambda total, x: total + x)

        return F.array(*[dot(c) for c in self.weights.T])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds probabilities (in class order) and prediction to rows with an `embedding`."""
        scored = df.withColumn("_scores", self.scores(F.col("embedding")))
        return (scored.withColumn("probabilities", sc.softmax(F.col("_scores")))
                .withColumn("prediction", sc.argmax_class(F.col("probabilities"), self.classes)).drop("_scores"))

    def probability(self, label: str) -> Column:
        return F.get(F.col("probabilities"), self.classes.index(label))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.classes, self.weights.shape[0], self.weights.ravel().tolist())
        spark.createDataFrame([row], "classes array<string>, inputs int, weights array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearHead":
        row = spark.read.parquet(path).first()
        return cls(list(row.classes), np.array(row.weights).reshape(row.inputs, -1))


def batch_number(doc_id: Column, config: HeadTraining, epoch: int, batches: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(config.seed), F.lit("batch"), F.lit(epoch), doc_id), F.lit(batches)).cast("int")


def mask_key(doc_id: Column, config: HeadTraining, epoch: int) -> Column:
    return F.xxhash64(F.lit(config.seed), F.lit("mask"), F.lit(epoch), doc_id)


def dropout_mask(keys: np.ndarray, dim: int, rate: float) -> np.ndarray:
    """Per row and input 0 or 1 / (1 - rate): a hash of the row's key and the input decides."""
    mixed = keys.astype(np.uint64)[:, None] + _MIX[0] * np.arange(1, dim + 1, dtype=np.uint64)
    for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * factor
    uniform = (mixed ^ (mixed >> np.uint64(31))).astype(np.float64) / 2.0 ** 64
    return (uniform >= rate) / (1.0 - rate)


def gradient(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Summed gradient and loss of the cross-entropy."""
    inputs = np.hstack([rows, np.ones((len(rows), 1))])
    scores = inputs @ weights
    scores -= scores.max(axis=1, keepdims=True)
    shares = np.exp(scores)
    shares /= shares.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(shares[np.arange(len(rows)), target], 1e-300)).sum()
    shares[np.arange(len(rows)), target] -= 1
    return inputs.T @ shares, float(loss)


class AdamW:
    """Adam with decoupled weight decay, linear warm-up and linear decay to zero."""

    def __init__(self, shape: tuple[int, int], config: HeadTraining, steps: int):
        self.config, self.steps, self.step = config, steps, 0
        self.mean, self.square = np.zeros(shape), np.zeros(shape)

    def rate(self) -> float:
        done, warm = self.step, self.config.warmup
        if done < warm:
            return self.config.learning_rate * done / warm
        return self.config.learning_rate * max(0.0, (self.steps - done) / max(1, self.steps - warm))

    def update(self, weights: np.ndarray, slope: np.ndarray) -> np.ndarray:
        rate = self.rate()
        self.step += 1
        self.mean = BETA_1 * self.mean + (1 - BETA_1) * slope
        self.square = BETA_2 * self.square + (1 - BETA_2) * slope * slope
        mean = self.mean / (1 - BETA_1 ** self.step)
        square = self.square / (1 - BETA_2 ** self.step)
        return weights * (1 - rate * self.config.weight_decay) - rate * mean / (np.sqrt(square) + EPSILON)


def _blocks(keyed: DataFrame, batches: int, tasks: int) -> RDD:
    """The rows (key, target, embedding) dealt out by batch: batch b is the partitions from b * tasks on, `tasks` of them.

    They are shuffled once, at the first step; every step then reads its own partitions and no others.
    """
    rows = keyed.select("batch", "key", "target", "embedding").rdd
    return rows.map(lambda r: (r[0] * tasks + r[1] % tasks, (r[1], r[2], r[3]))).partitionBy(batches * tasks, lambda block: block)


def _batch_gradient(blocks: RDD, own: range, weights: np.ndarray, rate: float) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and number of the rows of a batch's partitions; one small matrix a partition reaches the driver."""
    def run(rows):
        found = [row for _, row in rows]
        if found:
            keys, target, vectors = zip(*found)
            dense = np.array(vectors, dtype=np.float64)
            dense = dense * dropout_mask(np.array(keys, dtype=np.int64).view(np.uint64), dense.shape[1], rate)
            yield *gradient(weights, dense, np.array(target)), len(found)

    total, loss, n = np.zeros_like(weights), 0.0, 0
    for slope, more, size in blocks.context.runJob(blocks, run, list(own)):
        total, loss, n = total + slope, loss + more, n + size
    return total, loss, n


def fit_minibatch_head(df: DataFrame, classes: list[str], config: HeadTraining, losses) -> tuple[LinearHead, list[tuple]]:
    """Train on rows with doc_id, embedding, label and split ('train' and 'val').

    Gives the head and the history rows (step, train_loss, val_loss, val_accuracy): the mean loss of the epoch's batches as they
    were trained, and `losses(head, rows)` of the validation part. Weights start at zero.
    """
    target = encode_label(F.col("label").cast("string"), classes)
    train = df.filter(F.col("split") == "train").select("doc_id", target.alias("target"), "embedding")
    n = train.count()
    dim = train.select(F.size("embedding")).first()[0]
    batches = max(1, math.ceil(n / config.batch_size))
    tasks = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, config.batch_size // 64))
    weights, history = np.zeros((dim + 1, len(classes))), []
    optimiser = AdamW(weights.shape, config, config.epochs * batches)
    head = LinearHead(classes, weights)
    for epoch in range(1, config.epochs + 1):
        keyed = train.withColumns({"batch": batch_number(F.col("doc_id"), config, epoch, batches),
                                   "key": mask_key(F.col("doc_id"), config, epoch)})
        blocks = _blocks(keyed, batches, tasks)
        seen = []
        for number in range(batches):
            own = range(number * tasks, (number + 1) * tasks)
            slope, loss, size = _batch_gradient(blocks, own, weights, config.dropout)
            if size:  # a batch no row hashes to is no step
                weights = optimiser.update(weights, slope / size)
                seen.append(loss / size)
        head = LinearHead(classes, weights)
        val = {r.split: r for r in losses(head, df.filter(F.col("split") == "val")).collect()}.get("val")
        history.append((float(epoch), float(np.mean(seen)), val.loss if val else None, val.accuracy if val else None))
    return head, history
