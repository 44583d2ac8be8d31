"""Distribution functions and assignment, for arrays that fit a task."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def student_two_tailed(t: float, df: float) -> float:
    """Probability of a value at least as far from 0 as t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def assignment(gain: np.ndarray) -> np.ndarray:
    """A column for each row so that the sum of gains is greatest; one each, square gains. Shortest augmenting paths with potentials."""
    cost = gain.max() - gain if gain.size else gain
    n = len(cost)
    row_of, u, v = np.full(n, -1), np.zeros(n), np.zeros(n)
    for start in range(n):
        reach, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, column, at = start, -1, 0.0
        while True:
            slack = at + cost[row] - u[row] - v
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, reach)))
            at = reach[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = int(row_of[column])
        for k in np.flatnonzero(done):
            if row_of[k] >= 0:
                u[row_of[k]] += at - reach[k]
            v[k] -= at - reach[k]
        u[start] += at
        while column >= 0:
            before = int(via[column])
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    out = np.empty(n, "int64")
    out[row_of] = np.arange(n)
    return out
