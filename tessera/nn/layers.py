"""Layers in NumPy and as column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Products in the expression of one output.
MAX_NODES = 5_000


@dataclass
class Dense:
    """``relu(scale * (x W) + shift)`` with folded batch normalization, or without activation."""

    weights: np.ndarray  # inputs x outputs
    bias: np.ndarray
    relu: bool = True

    def forward(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        return np.maximum(z, 0) if self.relu else z


def fold_batch_norm(weights: np.ndarray, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray, var: np.ndarray, eps: float = 1e-5) -> Dense:
    """A bias-free linear layer and the normalization after it as one layer."""
    scale = gamma / np.sqrt(var + eps)
    return Dense(weights * scale, beta - mean * scale)


@dataclass
class Mlp:
    layers: list[Dense] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def columns(self, inputs: list[Column]) -> list[Column]:
        """The output of the last layer as arithmetic on columns; for narrow networks, stays in generated code.

        A unit repeats the expressions of the units below it, so a network of more than ``MAX_NODES`` products is refused: score it in batches.
        """
        nodes = 1
        for layer in self.layers:
            nodes = (nodes + 1) * layer.weights.shape[0]
        if nodes > MAX_NODES:
            raise ValueError(f"{nodes} products are too many for one expression; use score_arrays")
        values = inputs
        for layer in self.layers:
            out = []
            for j in range(layer.weights.shape[1]):
                z = F.lit(float(layer.bias[j]))
                for i, v in enumerate(values):
                    z = z + v * float(layer.weights[i, j])
                out.append(F.greatest(z, F.lit(0.0)) if layer.relu else z)
            values = out
        return values

    def to_json(self) -> str:
        return json.dumps([{"weights": la.weights.tolist(), "bias": la.bias.tolist(), "relu": la.relu} for la in self.layers])

    @staticmethod
    def from_json(text: str) -> Mlp:
        return Mlp([Dense(np.array(x["weights"]), np.array(x["bias"]), x["relu"]) for x in json.loads(text)])


def parameter_count(widths: list[int], batch_norm: bool = True) -> int:
    """Of a network with hidden layers without bias but with normalization (or with bias), and a biased output."""
    n = 0
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        last = i == len(widths) - 2
        n += a * b + (b if last or not batch_norm else 2 * b)
    return n


def convolution_parameters(channels: list[int], kernel: int = 3) -> int:
    """Of bias-free convolutions, each followed by a normalization."""
    return sum(a * b * kernel * kernel + 2 * b for a, b in zip(channels, channels[1:], strict=False))


def conv2d(x: np.ndarray, kernels: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Same-size convolution of a batch (n, c, h, w) with (out, c, k, k)."""
    k = kernels.shape[-1]
    p = k // 2
    padded = np.pad(x, ((0, 0), (0, 0), (p, p), (p, p)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(2, 3))
    return np.einsum("nchwij,ocij->nohw", windows, kernels) + bias[None, :, None, None]


def max_pool2(x: np.ndarray) -> np.ndarray:
    n, c, h, w = x.shape
    return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).max(axis=(3, 5))


@dataclass
class ConvNet:
    """Blocks of convolution, ReLU and pooling, then dense layers."""

    blocks: list[tuple[np.ndarray, np.ndarray]]
    head: Mlp

    def forward(self, x: np.ndarray) -> np.ndarray:
        for kernels, bias in self.blocks:
            x = max_pool2(np.maximum(conv2d(x, kernels, bias), 0))
        return self.head.forward(x.reshape(len(x), -1))


def fixed_weights(rows: int, columns: int, seed: int = 1) -> np.ndarray:
    """Weights by a rule: ((7 i + 3 j + seed) mod 11 - 5) / 10."""
    i, j = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
    return ((7 * i + 3 * j + seed) % 11 - 5) / 10.0
