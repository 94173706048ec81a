"""Student's t on the driver, in pure Python."""

from __future__ import annotations

from math import exp, lgamma, log, log1p


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1.0 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    # even and odd parts of the continued fraction, evaluated from the front by ratios of successive denominators
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d, c = 1.0 + term * d, 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            change = c * d
            value *= change
        if abs(change - 1.0) < 1e-15:
            break
    return front * value


def two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|), from the tail itself, so small values of either sign survive."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def t_cdf(t: float, df: float) -> float:
    tail = two_sided_p(t, df) / 2
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p and high < 1e300:
        low, high = high, 2 * high
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2
