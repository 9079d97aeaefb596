"""Training a small network with Adam, gradients as a distributed sum.

Each step is one pass over a batch of rows, chosen by a hash of the key: tasks return the sum of
their rows' gradients, one row per task whatever the data, and the driver takes the step. Hidden layers are
linear and ReLU; the output is a logit. The loss may weight positives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.nn.layers import Dense, Mlp
from tessera.nn.score import score_arrays
from tessera.operators import metrics


def he_init(widths: list[int], seed: int = 42) -> Mlp:
    rng = np.random.default_rng(seed)
    layers = []
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        layers.append(Dense(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b), relu=i < len(widths) - 2))
    return Mlp(layers)


def dropout_mask(keys: np.ndarray, width: int, share: float, salt: int) -> np.ndarray:
    """0 or 1 / (1 - share) for each row and unit, from a hash of key, unit and salt: the same wherever a row is."""
    x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x += np.uint64(salt * 0x2545F4914F6CDD1D % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)) >= np.uint64(int(share * (1 << 53)))) / (1 - share)


def gradients(
    model: Mlp, x: np.ndarray, y: np.ndarray, positive_weight: float = 1.0, keys: np.ndarray | None = None, dropout: float = 0.0, salt: int = 0
) -> tuple[float, list[np.ndarray]]:
    """Summed loss and its gradients by layer: weights, bias, weights, ... Hidden units drop out by ``keys``."""
    acts, masks = [x], []
    for i, layer in enumerate(model.layers):
        out = layer.forward(acts[-1])
        masks.append(dropout_mask(keys, out.shape[1], dropout, salt * 64 + i) if dropout and layer.relu else None)
        acts.append(out if masks[-1] is None else out * masks[-1])
    z = acts[-1][:, 0]
    w = np.where(y == 1, positive_weight, 1.0)
    loss = float((w * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum())
    delta = (w * (1 / (1 + np.exp(-z)) - y))[:, None]
    out: list[np.ndarray] = []
    for i in range(len(model.layers) - 1, -1, -1):
        layer = model.layers[i]
        if layer.relu:
            delta = delta * (acts[i + 1] > 0) * (1.0 if masks[i] is None else masks[i])
        out = [acts[i].T @ delta, delta.sum(axis=0), *out]
        delta = delta @ layer.weights.T
    return loss, out


class Adam:
    def __init__(self, lr: float = 1e-3, decay: float = 0.0):
        self.lr, self.decay, self.t, self.m, self.v = lr, decay, 0, None, None

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        if self.m is None:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            g = g + self.decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.lr * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Arrays of one length as a matrix, from Arrow's flat values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _summed(df: DataFrame, model: Mlp, positive_weight: float, dropout: float = 0.0, salt: int = 0) -> tuple[float, int, list[np.ndarray]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, grads = 0.0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keys = matrix(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            loss, g = gradients(model, x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), positive_weight, keys, dropout, salt)
            total, n, grads = total + loss, n + len(x), g if grads is None else [a + b for a, b in zip(grads, g, strict=True)]
        if n:
            flat = np.concatenate([g.ravel() for g in grads])
            yield pa.RecordBatch.from_arrays(
                [pa.array([total]), pa.array([n], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["loss", "n", "g"]
            )

    rows = df.mapInArrow(run, "loss double, n long, g array<double>").collect()  # a row per task, as long as the model
    shapes = [s for la in model.layers for s in (la.weights.shape, la.bias.shape)]
    flat = np.sum([r["g"] for r in rows], axis=0) if rows else np.zeros(sum(int(np.prod(s)) for s in shapes))
    cuts = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
    return sum(r["loss"] for r in rows), sum(r["n"] for r in rows), [flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False)]


def _epochs(
    df: DataFrame, features: str, label: str, key: str, widths: list[int], epochs: int, batches: int, lr: float, decay: float,
    positive_weight: float, dropout: float, seed: int, normalize: bool = False,
) -> Iterator[tuple[Mlp, float]]:
    """The network, which goes on changing, and its mean loss after each epoch; with ``normalize``, folded."""
    from tessera.nn.normalized import Normalized

    model, adam = Normalized.he_init(widths, seed) if normalize else he_init(widths, seed), Adam(lr, decay)
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("k")).persist()
    try:
        for epoch in range(epochs):
            total, count = 0.0, 0
            for b in range(batches):
                part = rows.where(F.pmod("k", F.lit(batches)) == b)
                if normalize:
                    loss, n, grads = model.step(part, positive_weight, dropout, epoch * batches + b)
                    if n:
                        adam.step(model.parameters(), grads)
                    total, count = total + loss, count + n
                    continue
                loss, n, grads = _summed(part, model, positive_weight, dropout, epoch * batches + b)
                if n:
                    adam.step([p for la in model.layers for p in (la.weights, la.bias)], [g / n for g in grads])
                total, count = total + loss, count + n
            yield model.folded() if normalize else model, total / max(1, count)
    finally:
        rows.unpersist()


def fit(
    df: DataFrame, features: str, label: str, key: str, widths: list[int], epochs: int = 5, batches: int = 4, lr: float = 1e-2,
    decay: float = 1e-4, positive_weight: float = 1.0, dropout: float = 0.0, seed: int = 42,
) -> tuple[Mlp, list[float]]:
    """The trained network and the mean loss of each epoch; ``batches`` hash batches an epoch."""
    model, history = he_init(widths, seed), []
    for model, loss in _epochs(df, features, label, key, widths, epochs, batches, lr, decay, positive_weight, dropout, seed):
        history.append(loss)
    return model, history


def fit_local(
    df: DataFrame, features: str, label: str, key: str, widths: list[int], epochs: int = 5, batch: int = 16, workers: int = 1, lr: float = 5e-3,
    decay: float = 1e-3, positive_weight: float = 1.0, dropout: float = 0.0, seed: int = 42,
) -> tuple[Mlp, list[float]]:
    """Training in small batches: local steps inside tasks, averaged after each epoch.

    One Spark job for each 16 rows can't scale, so rows are dealt by a hash of the key to ``workers`` tasks, each of which goes through its rows in the
    epoch's hash order, ``batch`` at a time, from the common parameters and Adam moments. Then parameters and moments are averaged,
    weighted by rows, and the next epoch starts from these. One worker is plain training in batches; more take as many
    steps each as they have batches, so an epoch of w workers is w times fewer steps in a row. A worker holds its share of the rows, so ``workers`` grows with the table.
    """
    model, state, history = he_init(widths, seed), None, []
    params = [p for la in model.layers for p in (la.weights, la.bias)]
    cuts = np.cumsum([0, *[p.size for p in params]])
    size, steps = int(cuts[-1]), 0
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("k"))
    for epoch in range(epochs):
        start = (model.to_json(), state, steps)

        def run(batches: Iterator[pa.RecordBatch], start: tuple = start, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            own, held, t = Mlp.from_json(start[0]), start[1], start[2]
            adam = Adam(lr, decay)
            mine = [p for la in own.layers for p in (la.weights, la.bias)]
            if held is not None:
                adam.t, adam.m, adam.v = t, *([v[a:b].reshape(p.shape).copy() for a, b, p in zip(cuts, cuts[1:], mine, strict=False)] for v in held)
            parts = [(matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
            if not parts:
                return
            x, y, k = (np.concatenate(v) for v in zip(*parts, strict=True))
            loss, n = 0.0, len(x)
            for lo in range(0, n, batch):
                part = slice(lo, lo + batch)
                value, grads = gradients(own, x[part], y[part], positive_weight, k[part], dropout, epoch)
                adam.step(mine, [g / len(x[part]) for g in grads])
                loss += value
            out = np.concatenate([[n, loss, n * (adam.t - t)], *[n * v.ravel() for group in (mine, adam.m, adam.v) for v in group]])
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["m"])

        order = F.xxhash64(F.lit(epoch), F.col("k"))
        dealt = rows.repartition(workers, F.pmod(F.col("k"), F.lit(workers))).sortWithinPartitions(order, "k")
        sums = dealt.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        total = np.zeros(3 + 3 * size)
        for r in sums.collect():  # three times the parameters
            total[r["i"]] = r["v"]
        if not total[0]:
            break
        mean = total[3:] / total[0]
        for a, b, p in zip(cuts, cuts[1:], params, strict=False):
            p[...] = mean[a:b].reshape(p.shape)
        state = (mean[size : 2 * size], mean[2 * size :])
        steps += max(1, round(total[2] / total[0]))
        history.append(float(total[1] / total[0]))
    return model, history


@dataclass
class Selected:
    """The best network on validation rows, the threshold found there, and (epoch, loss, validation AUC) of every epoch."""

    model: Mlp
    threshold: float
    history: list[tuple[int, float, float]]

    def to_json(self) -> str:
        return json.dumps({"layers": json.loads(self.model.to_json()), "threshold": self.threshold})

    @staticmethod
    def from_json(text: str) -> Selected:
        held = json.loads(text)
        return Selected(Mlp.from_json(json.dumps(held["layers"])), held["threshold"], [])


def probabilities(df: DataFrame, features: str, label: str, key: str, model: Mlp) -> DataFrame:
    """id, y, p."""
    z = score_arrays(df, key, features, model.forward).select(F.col(key).alias("id"), F.get("z", F.lit(0)).alias("z"))
    y = df.select(F.col(key).alias("id"), F.col(label).cast("long").alias("y"))
    return z.join(y, "id").select("id", "y", F.round(1 / (1 + F.exp(-F.col("z"))), 12).alias("p"))


def fit_selected(
    train: DataFrame, validation: DataFrame, features: str, label: str, key: str, widths: list[int], epochs: int = 40, patience: int = 6,
    batches: int = 4, lr: float = 1e-3, decay: float = 1e-4, dropout: float = 0.3, seed: int = 42, normalize: bool = False,
) -> Selected:
    """Training by protocol: positives weighted by their rarity, weights kept at each strict gain of the validation AUC, an
    end after ``patience`` epochs without one, and the threshold with the best F1 on validation. Test rows have no part in it."""
    rare = train.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    best, since, kept, history = None, 0, None, []
    for model, loss in _epochs(train, features, label, key, widths, epochs, batches, lr, decay, rare[0] / max(1, rare[1]), dropout, seed, normalize):
        value = metrics.auc(probabilities(validation, features, label, key, model)).first()["auc"]
        if value is None:
            raise ValueError("validation rows of both classes are needed")
        history.append((len(history), loss, value))
        since += 1
        if best is None or value > best:
            best, since, kept = value, 0, model.to_json()
        if since >= patience:
            break
    if kept is None:
        raise ValueError("no epoch was trained")
    model = Mlp.from_json(kept)
    return Selected(model, metrics.best_threshold(probabilities(validation, features, label, key, model)).first()["threshold"], history)
