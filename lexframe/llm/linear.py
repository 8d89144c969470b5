"""Small fits on a bounded, labelled sample, in numpy on the driver."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with hinge loss: Hsieh et al., 2008. labels are +1 and -1.

    ``rows`` and ``values`` are the indices and values of each example. Each class weighs the same in all.
    """
    rng = np.random.default_rng(seed)
    weights, alpha = np.zeros(size + 1), np.zeros(len(rows))
    share = {y: len(labels) / (2 * max(1, int((labels == y).sum()))) for y in (-1, 1)}
    bound = np.array([cost * share[int(y)] for y in labels])
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i], values[i], labels[i]
            gradient = y * (weights[at] @ x + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            if (step := (new - alpha[i]) * y) != 0.0:
                weights[at] += step * x
                weights[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, the last one the intercept, of a ridge logistic regression by damped Newton steps."""
    x = np.column_stack([features, np.ones(len(labels))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(labels)) / 100)
    penalty[-1] = 1e-6

    def loss(b):
        z = x @ b
        return float(np.logaddexp(0, z).sum() - labels @ z + 0.5 * (penalty * b * b).sum())

    for _ in range(steps):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * beta)
        rate, now = 1.0, loss(beta)
        while rate > 1e-4 and loss(beta + rate * step) > now:
            rate /= 2
        beta = beta + rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return beta


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
