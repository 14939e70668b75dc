"""Multinomial logistic regression on sparse features, trained by follow-the-regularised-leader with elastic net."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Ftrl:
    """FTRL-proximal: per-coordinate learning rates, L1 makes weights exactly zero, L2 shrinks the rest.

    Features are rows of weights; a sample is a pair (indices, values). Feature 0 may serve as the bias.
    """

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def step(self, rows: np.ndarray, values: np.ndarray, target: np.ndarray, weight: float = 1.0) -> float:
        """One sample with the target distribution ``target``; returns its log loss before the step."""
        w = self.weights(rows)
        p = softmax(values @ w)
        g = values[:, None] * ((p - target) * weight)[None, :]
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown
        return float(-(target * np.log(np.maximum(p, 1e-12))).sum())

    def batch(self, idx: np.ndarray, values: np.ndarray, starts: np.ndarray, error: Callable[[np.ndarray], np.ndarray], mask: np.ndarray | None = None) -> None:
        """One step on several samples in compressed rows: sample k holds ``idx[starts[k]:starts[k + 1]]`` (at least one
        feature). ``error`` turns the samples' logits into the gradients of their loss; ``mask`` (features x classes)
        is false where a weight stays zero."""
        used, at = np.unique(idx, return_inverse=True)
        w = self.weights(used)
        e = error(np.add.reduceat(w[at] * values[:, None], starts, axis=0))
        spread = values[:, None] * np.repeat(e, np.diff(np.append(starts, len(idx))), axis=0)
        g = np.stack([np.bincount(at, spread[:, k], minlength=len(used)) for k in range(self.classes)], axis=1)
        if mask is not None:
            g *= mask[used]
        n = self.n[used]
        grown = n + g * g
        self.z[used] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[used] = grown


class Rows:
    """Samples as compressed rows, from which batches are taken."""

    def __init__(self, samples: list[np.ndarray], values: list[np.ndarray] | None = None) -> None:
        self.ends = np.cumsum([len(s) for s in samples]) if samples else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(samples)]
        self.idx = np.concatenate(samples).astype(np.int64) if samples else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.ones(len(self.idx))

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(idx, values, starts) of the samples ``picked``."""
        lengths = self.ends[picked] - self.starts[picked]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        at = np.arange(lengths.sum()) - np.repeat(starts, lengths) + np.repeat(self.starts[picked], lengths)
        return self.idx[at], self.values[at], starts

    def dot(self, w: np.ndarray, picked: np.ndarray, most: int = 4096) -> np.ndarray:
        """Logits of the samples ``picked``."""
        out = np.zeros((len(picked), w.shape[1]))
        for lo in range(0, len(picked), most):
            idx, values, starts = self.take(picked[lo : lo + most])
            out[lo : lo + most] = np.add.reduceat(w[idx] * values[:, None], starts, axis=0)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor for the logits that makes their softmax likeliest on held-out labels (golden-section search)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits * np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
