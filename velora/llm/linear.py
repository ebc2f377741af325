"""Small linear models that are fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, weight: np.ndarray, size: int, *, l2: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weighted L2-regularised logistic regression by Adam over all rows; (coefficients, intercept).

    The features are given as (row, column, value) entries. The result depends
    on the data only: no randomness, zero start.
    """
    theta, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = weight / weight.sum() if len(weight) else weight
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, values * theta[columns], len(target))
        g = weight * (sigmoid(z) - target)
        grad = np.bincount(columns, values * g[rows], size) + l2 * theta
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        theta = theta - step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return theta, float(b)
