"""A hashed linear scorer: word, word-pair and character n-gram frequencies, logistic regression.

The model is a fixed-size table of weights (`DIMS` floats), so shipping it to tasks is
bounded whatever the corpus holds.  It is fitted in one task on a bounded, documented
number of labelled rows (`fit`), and applied to every text in Arrow batches (`score`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quire.llm import _flat

#: Hash buckets: a quarter for words, a quarter for word pairs, half for runs of four bytes.
DIMS = 1 << 16
WORDS, PAIRS, CHARS = DIMS // 4, DIMS // 4, DIMS // 2
#: A feature's value is its share within its family times this, so that weights are of order one.
SCALE = 8.0
#: Rows that the fit works on at a time.
FIT_ROWS = 256


def occurrences(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, hasher: _flat.Hasher) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: bucket of every occurrence, and the bounds of each text's occurrences."""
    hashes = hasher(starts, ends)
    pairs, _, pair_bounds = _flat.grams(hashes, bounds, 2)
    top = np.uint64(64 - 14)
    out = [((hashes >> top).astype(np.int64), bounds), ((pairs >> top).astype(np.int64) + WORDS, pair_bounds)]
    n = len(data) - 3
    if n <= 0:
        return [*out, (np.zeros(0, np.int64), np.zeros(len(off), np.int64))]
    four = np.zeros(n, np.uint32)
    for k in range(4):
        four |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    chars = ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64) + WORDS + PAIRS
    # Windows that run into the next text are left out of each text's run by its upper bound.
    keep = np.arange(n) + 4 <= np.repeat(off[1:], np.diff(off))[:n]
    return [*out, (chars[keep], np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[np.minimum(off, n)])]


@dataclass(frozen=True)
class Model:
    """Weights, bias, and the slope and shift that turn scores into calibrated log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, families: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = None
        for buckets, bounds in families:
            sums = _flat.per_text(self.weights[buckets].astype(np.float64), bounds)
            part = SCALE * sums / np.maximum(np.diff(bounds), 1)
            total = part if total is None else total + part
        return total + self.bias

    def probability(self, families: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.slope * self.score(families) + self.shift)

    def pack(self) -> bytes:
        return np.array([self.bias, self.slope, self.shift], np.float64).tobytes() + self.weights.astype(np.float32).tobytes()

    @staticmethod
    def unpack(raw: bytes) -> Model:
        bias, slope, shift = np.frombuffer(raw[:24], np.float64)
        return Model(np.frombuffer(raw[24:], np.float32), float(bias), float(slope), float(shift))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sparse(families: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[bytes, bytes]]:
    """For each text its distinct buckets and their values, as int32 and float32 bytes."""
    out = []
    for k in range(len(families[0][1]) - 1):
        index, value = [], []
        for buckets, bounds in families:
            own, count = np.unique(buckets[bounds[k] : bounds[k + 1]], return_counts=True)
            index.append(own)
            value.append(SCALE * count / max(1, count.sum()))
        out.append((np.concatenate(index).astype(np.int32).tobytes(), np.concatenate(value).astype(np.float32).tobytes()))
    return out


def fit(rows: list[tuple[bytes, bytes]], target: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Full-batch logistic regression with a step size per weight, then Platt calibration.

    Every fourth row is held out of the fit and used for the calibration.  `target` may be
    soft (between 0 and 1).  Without both classes the model is constant: the base rate.
    """
    held = np.arange(len(rows)) % 4 == 3
    rate0 = float(np.clip(target.mean() if len(target) else 0.5, 1e-3, 1 - 1e-3))
    weights, bias = np.zeros(DIMS), float(np.log(rate0 / (1 - rate0)))
    if len(rows) < 8 or target.max() - target.min() < 0.5:
        return Model(weights.astype(np.float32), bias)

    def stacked(which: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows at a time, so that what a step computes stays small beside the rows."""
        at, parts = np.flatnonzero(which), []
        for lo in range(0, len(at), FIT_ROWS):
            own = at[lo : lo + FIT_ROWS]
            index = [np.frombuffer(rows[i][0], np.int32) for i in own]
            value = [np.frombuffer(rows[i][1], np.float32) for i in own]
            parts.append((slice(lo, lo + len(own)), np.concatenate(index), np.concatenate(value), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in index])))
        return parts

    def scores(parts: list, n: int) -> np.ndarray:
        z = np.empty(n)
        for place, cols, vals, owner in parts:
            z[place] = np.bincount(owner, weights[cols] * vals, minlength=place.stop - place.start) + bias
        return z

    parts = stacked(~held)
    y = target[~held].astype(np.float64)
    seen, seen_bias = np.zeros(DIMS), 0.0
    for _ in range(rounds):
        residual = (sigmoid(scores(parts, len(y))) - y) / len(y)
        grad = ridge * weights
        for place, cols, vals, owner in parts:
            grad += np.bincount(cols, residual[place][owner] * vals, minlength=DIMS)
        grad_bias = residual.sum()
        seen += grad * grad
        seen_bias += grad_bias * grad_bias
        weights -= rate * grad / (np.sqrt(seen) + 1e-8)
        bias -= rate * grad_bias / (np.sqrt(seen_bias) + 1e-8)
    y = target[held].astype(np.float64)
    z = scores(stacked(held), len(y))
    slope, shift = platt(z, y)
    return Model(weights.astype(np.float32), bias, slope, shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for the two numbers of Platt's sigmoid, with his smoothed targets."""
    good, bad = float(y.sum()), float((1 - y).sum())
    if good < 1 or bad < 1:
        return 1.0, 0.0
    aim = y * (good + 1) / (good + 2) + (1 - y) / (bad + 2)
    scale = max(1.0, float(np.abs(z).max()))
    x = np.stack([z / scale, np.ones_like(z)], 1)
    w = np.array([scale, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        grad = x.T @ (p - aim) + 1e-3 * np.array([w[0], w[1]]) * 0.1
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (1.0, 0.0)
