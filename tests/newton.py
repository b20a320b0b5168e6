"""Plain count regression for the tests."""

from __future__ import annotations

import math

import numpy as np


def fitted(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, alpha: float = 0.0, ridge: float = 0.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, standard errors and means by scoring, with a variance of mean + alpha * mean^2; the first coefficient isn't penalised."""
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        mu = np.exp(np.clip(x @ b + offset, -80, 80))
        w = mu / (1 + alpha * mu)
        inverse = np.linalg.inv(x.T @ (x * w[:, None]) + penalty)
        step = inverse @ (x.T @ ((y - mu) / (1 + alpha * mu)) - penalty @ b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-13:
            break
    return b, np.sqrt(np.diag(inverse)), np.exp(x @ b + offset)


def matched_alpha(y: np.ndarray, mu: np.ndarray, df: int) -> float:
    """The alpha at which squared Pearson residuals sum to df, by bisection; by moments where they don't exceed it at 0."""
    def over(a: float) -> bool:
        return ((y - mu) ** 2 / (mu + a * mu * mu)).sum() > df

    if not over(0.0):
        return max(0.0, ((y - mu) ** 2 - mu).sum() / (mu * mu).sum())
    low, high = 0.0, 1.0
    while over(high):
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) else (low, middle)
    return low


def likelihood(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Log-likelihood of a negative binomial with log mean v0 + v1 x and log size v2."""
    mu, r = np.exp(v[0] + v[1] * x), math.exp(v[2])
    return math.fsum(math.lgamma(a + r) - math.lgamma(r) - math.lgamma(a + 1) - r * math.log1p(m / r) + (a * math.log(m / (r + m)) if a else 0.0) for a, m in zip(y.tolist(), mu.tolist()))


def most_likely(start: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The maximum near ``start`` by Newton's method with differences of the likelihood."""
    v, h, eye = np.array(start, float), 1e-3, np.eye(3)
    for _ in range(20):
        f = lambda d: likelihood(v + d, x, y)  # noqa: B023, E731
        grad = np.array([(8 * (f(h * e) - f(-h * e)) - f(2 * h * e) + f(-2 * h * e)) / (12 * h) for e in eye])
        bend = np.array([[(f(h * (a + b)) - f(h * (a - b)) - f(h * (b - a)) + f(-h * (a + b))) / (4 * h * h) for b in eye] for a in eye])
        step = np.linalg.solve(bend, grad)
        v = v - step
        if np.abs(step).max() < 1e-9:
            break
    return v
