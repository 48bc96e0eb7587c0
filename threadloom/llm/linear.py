"""Small logistic fits in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def newton_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one for the constant, that minimise log loss and a ridge, by damped Newton steps; weight: how often each row counts."""
    weight = np.ones(len(x)) if weight is None else weight
    many = weight.sum()
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return weight @ (np.logaddexp(0, z) - y * z) + ridge * many * (w[:-1] @ w[:-1]) / 2

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        pull = ridge * many * np.append(w[:-1], 0)
        grad = x.T @ (weight * (p - y)) + pull
        hess = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(np.append(np.full(len(w) - 1, ridge * many), 1e-6))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w, gain, now = w - size * step, now - after, after
        if gain < 1e-9 * (1 + abs(now)):
            break
    return w


def sparse_logistic(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, ridge: float = 1e-4, rounds: int = 80) -> np.ndarray:
    """Like newton_logistic for sparse rows: L-BFGS with ten pairs. The last weight is the constant."""
    n = np.array([len(r) for r in rows])
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    val = np.concatenate(values) if rows else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), n)

    def both(w):
        z = np.bincount(row, val * w[at], minlength=len(y)) + w[-1]
        p = sigmoid(z)
        r = (p - y) / max(1, len(y))
        grad = np.append(np.bincount(at, val * r[row], minlength=size), r.sum())
        grad[:-1] += ridge * w[:-1]
        return (np.logaddexp(0, z) - y * z).mean() + ridge * (w[:-1] @ w[:-1]) / 2, grad

    w = np.zeros(size + 1)
    f, g = both(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, d in reversed(pairs):
            a = (s @ q) / (s @ d)
            q -= a * d
            kept.append(a)
        if pairs:
            s, d = pairs[-1]
            q *= (s @ d) / (d @ d)
        for (s, d), a in zip(pairs, reversed(kept), strict=True):
            q += (a - (d @ q) / (s @ d)) * s
        step = 1.0
        while step > 1e-8:
            f2, g2 = both(w - step * q)
            if f2 <= f - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, d = -step * q, g2 - g
        if s @ d > 1e-12:
            pairs = [*pairs, (s, d)][-10:]
        w, gain, f, g = w - step * q, f - f2, f2, g2
        if gain < 1e-7:
            break
    return w
