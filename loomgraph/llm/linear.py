"""Small dense models fitted on bounded samples: logistic regression and probability calibration."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept, which is not penalised much.
    One class only, or no rows: an intercept alone."""
    x = np.hstack([np.asarray(x, np.float64), np.ones((len(x), 1))])
    return fit_blocks(lambda at: x[at], x.shape[1], y, weight, l2, rounds, len(x))


def fit_blocks(rows: Callable[[slice], np.ndarray], width: int, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25, size: int = 2048) -> np.ndarray:
    """As fit_logistic, of `width` columns that rows() makes for `size` rows at a time, the last of them ones; all rows
    count in every step, but only one block of them is held."""
    y = np.asarray(y, np.float64)
    w = np.zeros(width)
    c = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    if not len(y):
        return w
    if y.min() == y.max():
        w[-1] = math.log((c @ y + 0.5) / (c @ (1 - y) + 0.5))
        return w
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        g, h = np.zeros(width), np.zeros((width, width))
        for low in range(0, len(y), size):
            at = slice(low, low + size)
            x = rows(at)
            p = sigmoid(x @ w)
            g += x.T @ (c[at] * (p - y[at]))
            h += (x * (c[at] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        g += ridge * w
        h[np.diag_indices_from(h)] += ridge
        step = np.linalg.solve(h, g)
        big = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(big, 1e-9))
        if big < 1e-5:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(np.asarray(x, np.float64) @ w[:-1] + w[-1])


def calibrate(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on the log-odds of p."""
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    a, b = fit_logistic(z[:, None], y, l2=1e-2)
    return float(max(a, 0.0)), float(b)


def chi2_cut(p: float) -> float:
    """x with P(chi-square of one degree of freedom > x) = p."""
    low, high = 0.0, 2000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return high
