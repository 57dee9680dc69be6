"""Hashed features of a text in numpy: byte n-grams, words, and logistic regression over them."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers for hashing.
M1, M2 = np.uint32(2654435761), np.uint32(2246822519)


def ngrams(data: np.ndarray, sizes: tuple[int, ...], bits: int, at_once: int = 1 << 20) -> np.ndarray:
    """Counts of the byte n-grams of data (uint8), hashed into 2**bits; any length, in blocks."""
    out = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for a in range(0, len(data), at_once):
        wide = data[a : a + at_once + max(sizes) - 1].astype(np.uint32)
        for n in sizes:
            k = min(at_once, len(wide) - n + 1)
            if k <= 0:
                continue
            h = wide[:k].copy()
            for i in range(1, n):
                h = h * np.uint32(257) + wide[i : i + k] + np.uint32(n)
            out += np.bincount(((h ^ (h >> np.uint32(15))) * M1) >> shift, minlength=1 << bits)
    return out


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each white-space separated word, in order."""
    dark = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edge = np.flatnonzero(dark[1:] != dark[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    word = np.cumsum(dark[1:-1] & ~dark[:-2]) - 1
    power = np.cumprod(np.full(64, 1099511628211, np.uint64))
    inside = place - starts[np.maximum(word, 0)]
    terms = (data.astype(np.uint64) + np.uint64(1)) * power[inside & 63] * (np.uint64(2) * (inside >> 6).astype(np.uint64) + np.uint64(1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(dark[1:-1], terms, np.uint64(0)), dtype=np.uint64)])
    return total[ends] - total[starts]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 250, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights [d, outputs] and biases of logistic regressions on the same rows (Adam on the whole batch, so a rerun gives the same)."""
    n, d = x.shape
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros((d + 1, y.shape[1]), np.float32), np.zeros((d + 1, y.shape[1]), np.float32)
    each = (np.ones((n, 1), np.float32) if weight is None else weight.reshape(-1, 1).astype(np.float32)) / max(1, n)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * each
        g = np.concatenate([x.T @ error + l2 * w, error.sum(0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b
