"""Tail probabilities for small result tables; Spark has none of Student's t."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """P(|T| >= |t|) with df degrees of freedom."""
    if t is None or df is None or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi_square_tail(x: float | None, df: int) -> float | None:
    """P(X >= x), by the series of the lower incomplete gamma function."""
    if x is None:
        return None
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    term = total = 1 / a
    for n in range(1, 1000):
        term *= y / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))
