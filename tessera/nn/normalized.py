"""Networks with batch normalization, trained on moments of the whole batch however its rows are dealt out.

A hidden layer is ``relu(gamma * (x W - mean) / sqrt(var + eps) + beta)`` with dropout. Mean and variance are those of all rows of the batch, so a
step is a row of passes over it: one forward pass per hidden layer sums that layer's moments over all tasks, then the
backward passes, from the output down, sum each layer's gradients, and with them the two sums per unit that the gradient of the normalization below needs.
Tasks recompute the layers from the rows; only sums as long as a layer leave them, added by position before anything is collected.
Running moments are kept for scoring, where the normalization is folded into the linear layer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.nn.layers import Dense, Mlp, fold_batch_norm
from tessera.nn.train import dropout_mask, matrix

EPS = 1e-5


def added(df: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows (x, y, k) of ``of``'s arrays of one ``width``: per batch, then per task, then by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["m"])

    sums = df.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in sums.collect():  # as many rows as numbers in a layer
        out[r["i"]] = r["v"]
    return out


@dataclass
class Normalized:
    """Hidden layers without bias but with normalization, and a linear output of one logit."""

    weights: list[np.ndarray]
    gamma: list[np.ndarray]
    beta: list[np.ndarray]
    last: Dense
    mean: list[np.ndarray] = field(default_factory=list)
    var: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def he_init(widths: list[int], seed: int = 42) -> Normalized:
        rng, pairs = np.random.default_rng(seed), list(zip(widths, widths[1:], strict=False))
        hidden = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in pairs[:-1]]
        ones, zeros = [np.ones(w.shape[1]) for w in hidden], [np.zeros(w.shape[1]) for w in hidden]
        a, b = pairs[-1]
        last = Dense(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b), relu=False)
        return Normalized(hidden, ones, zeros, last, [z.copy() for z in zeros], [o.copy() for o in ones])

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in zip(self.weights, self.gamma, self.beta, strict=True) for p in layer] + [self.last.weights, self.last.bias]

    def folded(self) -> Mlp:
        """The network on its running moments, as plain layers."""
        hidden = [fold_batch_norm(w, g, b, m, v, EPS) for w, g, b, m, v in zip(self.weights, self.gamma, self.beta, self.mean, self.var, strict=True)]
        return Mlp([*hidden, Dense(self.last.weights.copy(), self.last.bias.copy(), relu=False)])

    def _forward(self, x: np.ndarray, keys: np.ndarray, moments: list[tuple[np.ndarray, np.ndarray]], dropout: float, salt: int) -> list[tuple]:
        """Per layer with known moments: its input, the normalized values, the activations' slope, and its output."""
        out = []
        for i, (mean, var) in enumerate(moments):
            hat = (x @ self.weights[i] - mean) / np.sqrt(var + EPS)
            h = self.gamma[i] * hat + self.beta[i]
            slope = (h > 0) * (dropout_mask(keys, h.shape[1], dropout, salt * 64 + i) if dropout else 1.0)
            out.append((x, hat, slope, h * slope))
            x = out[-1][3]
        return out

    def step(
        self, df: DataFrame, positive_weight: float = 1.0, dropout: float = 0.0, salt: int = 0, momentum: float = 0.1
    ) -> tuple[float, int, list[np.ndarray]]:
        """Summed loss, rows, and the gradients of the mean loss in the order of ``parameters``; the running moments move along."""
        depth, moments = len(self.weights), []
        n = 0.0
        for i in range(depth):
            # sums about the running mean, so that far means cost no digits
            at, width = self.mean[i], len(self.gamma[i])

            def sums(x, y, k, i=i, at=at, known=tuple(moments)):
                z = (self._forward(x, k, list(known), dropout, salt)[-1][3] if known else x) @ self.weights[i] - at
                return np.concatenate([[len(x)], z.sum(axis=0), (z * z).sum(axis=0)])

            total = added(df, sums, 1 + 2 * width)
            n = total[0]
            if not n:
                return 0.0, 0, [np.zeros_like(p) for p in self.parameters()]
            off = total[1 : 1 + width] / n
            moments.append((at + off, np.maximum(total[1 + width :] / n - off * off, 0.0)))
        loss, grads = self._backward(df, moments, n, positive_weight, dropout, salt)
        for i, (mean, var) in enumerate(moments):
            self.mean[i] = (1 - momentum) * self.mean[i] + momentum * mean
            self.var[i] = (1 - momentum) * self.var[i] + momentum * var * (n / max(1.0, n - 1))
        return loss, int(n), grads

    def _backward(self, df: DataFrame, moments: list, n: float, positive_weight: float, dropout: float, salt: int) -> tuple[float, list[np.ndarray]]:
        depth = len(self.weights)
        known: list[tuple[np.ndarray, np.ndarray]] = []  # of the layers above, from the top: sums of the slopes, and of those times the normalized values

        def slopes(x, y, k, down: int, known: tuple) -> tuple[float, list[tuple], np.ndarray, np.ndarray]:
            """Loss, layers, the logit's slope, and the slope of the normalized output of layer ``down``."""
            layers = self._forward(x, k, moments, dropout, salt)
            top = layers[-1][3] if layers else x
            z = (top @ self.last.weights + self.last.bias)[:, 0]
            w = np.where(y == 1, positive_weight, 1.0)
            loss = float((w * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum())
            out = (w * (1 / (1 + np.exp(-z)) - y) / n)[:, None]
            d = out @ self.last.weights.T
            for i in range(depth - 1, down - 1, -1):
                d = d * layers[i][2]
                if i > down:
                    d = self._below(i, d, layers[i][1], moments[i][1], n, known[depth - 1 - i]) @ self.weights[i].T
            return loss, layers, out, d

        def output(x, y, k):
            loss, layers, out, d = slopes(x, y, k, depth - 1, ())
            top = layers[-1][3] if layers else x
            unit = [d.sum(axis=0), (d * layers[-1][1]).sum(axis=0)] if layers else []
            return np.concatenate([[loss], (top.T @ out).ravel(), out.sum(axis=0), *unit])

        widths = [len(g) for g in self.gamma]
        size = self.last.weights.size
        total = added(df, output, 1 + size + 1 + (2 * widths[-1] if depth else 0))
        loss, grads = total[0], [total[1 : 1 + size].reshape(self.last.weights.shape), total[1 + size : 2 + size]]
        if depth:
            known.append((total[2 + size : 2 + size + widths[-1]], total[2 + size + widths[-1] :]))
        for i in range(depth - 1, -1, -1):

            def layer(x, y, k, i=i, known=tuple(known)):
                _, layers, _, d = slopes(x, y, k, i, known)
                dz = self._below(i, d, layers[i][1], moments[i][1], n, known[depth - 1 - i])
                parts = [(layers[i][0].T @ dz).ravel()]
                if i:
                    down = (dz @ self.weights[i].T) * layers[i - 1][2]
                    parts += [down.sum(axis=0), (down * layers[i - 1][1]).sum(axis=0)]
                return np.concatenate(parts)

            size = self.weights[i].size
            total = added(df, layer, size + (2 * widths[i - 1] if i else 0))
            beta, gamma = known[depth - 1 - i]
            grads = [total[:size].reshape(self.weights[i].shape), gamma, beta, *grads]
            if i:
                known.append((total[size : size + widths[i - 1]], total[size + widths[i - 1] :]))
        return float(loss), grads

    def _below(self, i: int, d: np.ndarray, hat: np.ndarray, var: np.ndarray, n: float, sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The slope of a layer's linear values from that of its normalized output."""
        return self.gamma[i] / np.sqrt(var + EPS) * (d - sums[0] / n - hat * sums[1] / n)
