"""Special functions in numpy and math, for statistics on small tables."""

from __future__ import annotations

import math

import numpy as np


def inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - inc_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def student_two_sided(t: float, df: float) -> float:
    if not (df > 0) or math.isnan(t):
        return 1.0
    if math.isinf(df):
        return math.erfc(abs(t) / math.sqrt(2))
    return inc_beta(df / 2, 0.5, df / (df + t * t))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x: moved beyond 10 by the recurrence, then Stirling's series."""
    x, below = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):
        small = x < 10
        below += np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    series = (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - below


def inc_beta_all(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same as :func:`inc_beta` for arrays; the fraction is carried on for all until the last one has settled."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    swap = y > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    held = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(y), 1 / held(1 - (p + q) * y / (p + 1))
    f = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / held(1 + num * d)
            c = 1 + num / held(c)
            f = f * c * d
        if np.abs(c * d - 1).max(initial=0.0) < 1e-15:
            break
    found = np.where(swap, 1 - front * f, front * f)
    return np.where(inside, found, np.where(x <= 0, 0.0, 1.0))


def student_two_sided_all(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """:func:`student_two_sided` for arrays; where either is missing, or df isn't above 0, the p is 1."""
    t, df = np.array(t, float), np.array(df, float)
    known = ~np.isnan(t) & (df > 0)
    finite = known & ~np.isinf(df)
    out = np.ones(len(t))
    out[finite] = inc_beta_all(df[finite] / 2, np.full(finite.sum(), 0.5), df[finite] / (df[finite] + t[finite] ** 2))
    out[known & ~finite] = [math.erfc(abs(v) / math.sqrt(2)) for v in t[known & ~finite]]
    return out


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def tetragamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 2 / x**3
        x += 1
    f = 1 / (x * x)
    return out - f - f / x - f * f / 2 + f**3 / 6 - f**4 / 6 + 3 * f**5 / 10


def inverse_trigamma(y: float) -> float:
    """By Newton's method on 1 / trigamma."""
    if y > 1e7:
        return 1 / math.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(50):
        tri = trigamma(x)
        step = tri * (1 - tri / y) / tetragamma(x)
        x += step
        if -step / x < 1e-10:
            break
    return x


def quantile7(values: np.ndarray, q: float) -> float:
    return float(np.quantile(values, q))


def bh(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p, kind="stable")[::-1]
    n = len(p)
    out = np.empty(n)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1)))
    return out
