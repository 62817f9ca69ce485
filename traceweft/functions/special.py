"""Tail probabilities of the chi-square, F and t distributions in plain Python; called once per statistic."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    # continued fraction by successive convergents
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * math.exp(log_front)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_p(statistic: float, df: float) -> float:
    return 1.0 if df <= 0 else gamma_q(df / 2, statistic / 2)


def f_p(statistic: float, d1: float, d2: float) -> float:
    return 1.0 if statistic <= 0 or d1 <= 0 or d2 <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * statistic))


def t_p(statistic: float, df: float) -> float:
    """Two-sided."""
    return 1.0 if df <= 0 else beta_i(df / 2, 0.5, df / (df + statistic * statistic))


def ks_p(distance: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov probability."""
    x = distance * math.sqrt(n * m / (n + m))
    if x < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p of 3 to 5,000 values by Royston's approximation; W is 1 where all are equal."""
    from statistics import NormalDist

    x, n, law = sorted(values), len(values), NormalDist()
    if not 3 <= n <= 5000:
        raise ValueError(f"the test takes 3 to 5000 values, not {n}")
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    if spread == 0:
        return 1.0, 1.0
    m = [law.inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
    size, u = sum(v * v for v in m), n**-0.5
    poly = lambda cs, t: sum(c * t**k for k, c in enumerate(cs))
    # fixed values: coefficients of the approximation, by rising powers
    last = m[-1] / math.sqrt(size) + poly((0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    elif n <= 5:
        rest = math.sqrt((size - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a = [-last, *(v / rest for v in m[1:-1]), last]
    else:
        next_ = m[-2] / math.sqrt(size) + poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
        rest = math.sqrt((size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2))
        a = [-last, -next_, *(v / rest for v in m[2:-2]), next_, last]
    w = min(1.0, sum(c * v for c, v in zip(a, x)) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 0.0
        z = (-math.log(gamma - y) - poly((0.5440, -0.39978, 0.025054, -0.0006714), n)) / math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        t = math.log(n)
        z = (y - poly((-1.5861, -0.31082, -0.083751, 0.0038915), t)) / math.exp(poly((-0.4803, -0.082676, 0.0030302), t))
    return w, 1 - law.cdf(z)
