"""Logistic regression in numpy over sparse rows; for bounded training samples.

Every pass over the rows goes in blocks, so that a fit on the driver needs little memory beside the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK = 1 << 16  # entries of the rows that one step of a pass takes, or one row of more


class Sparse(NamedTuple):
    """Rows as in CSR form; column numbers below ``width``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        """Rows and their entries, ``BLOCK`` entries at most unless a row has more."""
        low, rows = 0, len(self.start) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(self.start, self.start[low] + BLOCK, side="right")) - 1)
            yield slice(low, high), slice(int(self.start[low]), int(self.start[high]))
            low = high

    def take(self, rows: np.ndarray) -> Sparse:
        lengths = np.diff(self.start)[rows]
        begin = np.concatenate([[0], np.cumsum(lengths)])
        out = Sparse(begin, np.empty(begin[-1], self.column.dtype), np.empty(begin[-1], self.value.dtype), self.width)
        for some, to in out.blocks():
            flat = np.repeat(self.start[rows[some]] - begin[some], lengths[some]) + np.arange(to.start, to.stop)
            out.column[to], out.value[to] = self.column[flat], self.value[flat]
        return out

    def scaled(self, factor: np.ndarray) -> Sparse:
        """The rows with each column's values times its factor."""
        value = np.empty_like(self.value)
        for _, part in self.blocks():
            value[part] = self.value[part] * factor[self.column[part]]
        return self._replace(value=value)

    def dot(self, weight: np.ndarray) -> np.ndarray:
        out, before = np.empty(len(self.start) - 1), 0.0
        for some, part in self.blocks():
            total = np.cumsum(np.append(before, self.value[part] * weight[self.column[part]]), dtype=float)
            at = self.start[some.start : some.stop + 1] - part.start
            out[some] = total[at[1:]] - total[at[:-1]]
            before = total[-1]
        return out

    def back(self, residual: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for some, part in self.blocks():
            lengths = np.diff(self.start[some.start : some.stop + 1])
            np.add.at(out, self.column[part], np.repeat(residual[some], lengths) * self.value[part])
        return out

    def holders(self, rows: np.ndarray) -> np.ndarray:
        """Number of entries of each column in the marked rows."""
        out = np.zeros(self.width)
        for some, part in self.blocks():
            inside = np.repeat(rows[some], np.diff(self.start[some.start : some.stop + 1]))
            out += np.bincount(self.column[part][inside], minlength=self.width)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Linear(NamedTuple):
    weight: np.ndarray  # of the sparse columns
    extra: np.ndarray  # of the dense columns
    bias: float

    def predict(self, rows: Sparse, dense: np.ndarray) -> np.ndarray:
        return sigmoid(rows.dot(self.weight) + dense @ self.extra + self.bias)


def log_ratios(rows: Sparse, target: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log of how much likelier a row of the class has each column than another row."""
    rates = []
    for label in (1.0, 0.0):
        rates.append((rows.holders(target == label) + smooth) / ((target == label).sum() + 2 * smooth))
    return np.log(rates[0] / rates[1])


def fit(rows: Sparse, dense: np.ndarray, target: np.ndarray, decay: float = 1e-4, steps: int = 80,
        rate: float = 0.1) -> Linear:
    """Full-batch Adam on the mean log loss with L2 decay, over columns scaled by their log ratios (which are part of the weights
    returned), so that columns that tell nothing about the class stay near 0. A target of one class gives that class always."""
    ratio = log_ratios(rows, target)
    model = descend(rows.scaled(ratio), dense, target, decay, steps, rate)
    return model._replace(weight=model.weight * ratio)


def descend(rows: Sparse, dense: np.ndarray, target: np.ndarray, decay: float, steps: int, rate: float) -> Linear:
    size = rows.width + dense.shape[1] + 1
    theta = np.zeros(size)
    positives = float(target.sum())
    if not 0 < positives < len(target):
        theta[-1] = 20.0 if positives else -20.0
        return Linear(theta[: rows.width], theta[rows.width : -1], theta[-1])
    theta[-1] = np.log(positives / (len(target) - positives))
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        model = Linear(theta[: rows.width], theta[rows.width : -1], theta[-1])
        residual = (model.predict(rows, dense) - target) / len(target)
        slope = np.concatenate([rows.back(residual), dense.T @ residual, [residual.sum()]])
        slope[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Linear(theta[: rows.width], theta[rows.width : -1], theta[-1])
