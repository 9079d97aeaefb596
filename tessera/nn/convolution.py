"""Convolutional networks for classification, scored and trained in Arrow batches.

A block is a same-size convolution with bias, ReLU, and 2 x 2 maximum pooling; after the blocks come a linear layer and softmax cross-entropy. Images are arrays
of height x width x channels, channels last. A convolution is one matrix product over windows laid out as rows; its gradient is the transposed product, summed
back over the windows, and pooling sends a gradient to the first of the greatest pixels. Tasks return the sums of their rows' gradients, which are
added by position before the driver, which holds the parameters, takes the step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.nn.normalized import added
from tessera.nn.train import Adam, matrix


def windows(x: np.ndarray, k: int) -> np.ndarray:
    """(n, h, w, k * k * c): for each pixel the window around it, zero outside the image."""
    p = k // 2
    padded = np.pad(x, ((0, 0), (p, p), (p, p), (0, 0)))
    seen = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(1, 2))  # n, h, w, c, k, k
    return seen.transpose(0, 1, 2, 4, 5, 3).reshape(*x.shape[:3], -1)


def scattered(d: np.ndarray, shape: tuple[int, ...], k: int) -> np.ndarray:
    """The gradient of the images from that of their windows."""
    n, h, w, c = shape
    p = k // 2
    out = np.zeros((n, h + 2 * p, w + 2 * p, c))
    d = d.reshape(n, h, w, k, k, c)
    for i in range(k):
        for j in range(k):
            out[:, i : i + h, j : j + w] += d[:, :, :, i, j]
    return out[:, p : p + h, p : p + w]


def pooled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of 2 x 2 cells (a last odd row or column is left out) and the place, 0 to 3, of the first of the greatest."""
    n, h, w, c = x.shape
    cells = x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, h // 2, w // 2, c, 4)
    at = cells.argmax(axis=4)
    return np.take_along_axis(cells, at[..., None], axis=4)[..., 0], at


def unpooled(d: np.ndarray, at: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    n, h, w, c = shape
    cells = np.zeros((*d.shape, 4))
    np.put_along_axis(cells, at[..., None], d[..., None], axis=4)
    out = np.zeros(shape)
    out[:, : h // 2 * 2, : w // 2 * 2] = cells.reshape(n, h // 2, w // 2, c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, h // 2 * 2, w // 2 * 2, c)
    return out


@dataclass
class Convolutional:
    """``shape``: height, width, channels of an image; blocks of (weights (k * k * inputs, outputs), bias); the linear layer's weights and bias."""

    shape: tuple[int, int, int]
    blocks: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    bias: np.ndarray
    kernel: int = 3

    @staticmethod
    def he_init(shape: tuple[int, int, int], channels: list[int], classes: int, kernel: int = 3, seed: int = 42) -> Convolutional:
        rng, (h, w, c), blocks = np.random.default_rng(seed), shape, []
        for out in channels:
            blocks.append((rng.normal(0, np.sqrt(2 / (kernel * kernel * c)), (kernel * kernel * c, out)), np.zeros(out)))
            h, w, c = h // 2, w // 2, out
        if not h or not w:
            raise ValueError("more blocks than the image can be halved")
        return Convolutional(tuple(shape), blocks, rng.normal(0, np.sqrt(1 / (h * w * c)), (h * w * c, classes)), np.zeros(classes), kernel)

    def parameters(self) -> list[np.ndarray]:
        return [p for b in self.blocks for p in b] + [self.weights, self.bias]

    def features(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The images (n, pixels) after the first ``depth`` blocks (all, if None), as rows."""
        x = x.reshape(-1, *self.shape)
        for w, b in self.blocks[:depth]:
            x = pooled(np.maximum(windows(x, self.kernel) @ w + b, 0))[0]
        return x.reshape(len(x), -1)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights + self.bias

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Summed cross-entropy and its gradients in the order of ``parameters``."""
        x, held = x.reshape(-1, *self.shape), []
        for w, b in self.blocks:
            seen = windows(x, self.kernel)
            z = seen @ w + b
            out, at = pooled(np.maximum(z, 0))
            held.append((x.shape, seen, z, at))
            x = out
        flat = x.reshape(len(x), -1)
        z = flat @ self.weights + self.bias
        z = z - z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1))
        one = np.arange(len(y)), y.astype(int)
        loss = float((total - z[one]).sum())
        d = np.exp(z - total[:, None])
        d[one] -= 1
        grads = [flat.T @ d, d.sum(axis=0)]
        d = (d @ self.weights.T).reshape(x.shape)
        for (w, _), (shape, seen, z, at) in zip(reversed(self.blocks), reversed(held), strict=True):
            d = unpooled(d, at, z.shape) * (z > 0)
            flat = d.reshape(-1, d.shape[3])
            grads = [seen.reshape(len(flat), -1).T @ flat, flat.sum(axis=0), *grads]
            d = scattered(flat @ w.T, shape, self.kernel)
        return loss, grads

    def to_json(self) -> str:
        blocks = [[w.tolist(), b.tolist()] for w, b in self.blocks]
        return json.dumps({"shape": self.shape, "kernel": self.kernel, "blocks": blocks, "weights": self.weights.tolist(), "bias": self.bias.tolist()})

    @staticmethod
    def from_json(text: str) -> Convolutional:
        v = json.loads(text)
        return Convolutional(tuple(v["shape"]), [(np.array(w), np.array(b)) for w, b in v["blocks"]], np.array(v["weights"]), np.array(v["bias"]), v["kernel"])


def step(df: DataFrame, model: Convolutional) -> tuple[float, int, list[np.ndarray]]:
    """Summed loss, rows, and the gradients of the mean loss over rows (x, y: the class, k)."""
    shapes = [p.shape for p in model.parameters()]
    sizes = np.cumsum([2, *[int(np.prod(s)) for s in shapes]])

    def sums(x, y, k):
        loss, grads = model.gradients(x, y)
        return np.concatenate([[loss, len(x)], *[g.ravel() for g in grads]])

    total = added(df, sums, int(sizes[-1]))
    n = max(1.0, total[1])
    return float(total[0]), int(total[1]), [total[a:b].reshape(s) / n for a, b, s in zip(sizes, sizes[1:], shapes, strict=False)]


def fit(df: DataFrame, model: Convolutional, epochs: int = 5, batches: int = 2, lr: float = 1e-2, decay: float = 1e-4) -> list[float]:
    """Trains ``model`` on rows (x, y, k) in hash batches by k; the mean loss of each epoch."""
    adam, history = Adam(lr, decay), []
    for _ in range(epochs):
        loss, count = 0.0, 0
        for b in range(batches):
            part, n, grads = step(df.where(F.pmod(F.xxhash64("k"), F.lit(batches)) == b), model)
            if n:
                adam.step(model.parameters(), grads)
            loss, count = loss + part, count + n
        history.append(loss / max(1, count))
    return history


def outputs(df: DataFrame, key: str, pixels: str, model: Convolutional, depth: int | None = None) -> DataFrame:
    """``key`` and ``z``: the logits, or with ``depth`` the values after so many blocks; images with another number of pixels, or null ones, get null."""
    size = int(np.prod(model.shape))
    of = model.forward if depth is None else (lambda x: model.features(x, depth))
    x = F.col(pixels).cast("array<double>")
    whole = (F.size(x) == size) & ~F.exists(x, lambda v: v.isNull())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z: list = [None] * batch.num_rows
            good = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            if len(good):
                for i, v in zip(good.tolist(), of(matrix(batch.column(1).drop_null())), strict=True):
                    z[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.list_(pa.float64()))], names=["key", "z"])

    return df.select(F.col(key).alias("key"), F.when(whole, x).alias("x")).mapInArrow(run, f"key {kind}, z array<double>").withColumnRenamed("key", key)
