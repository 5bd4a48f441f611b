"""Quantiles and chart constants that plans hold as literals. Scalars only; nothing here sees rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
#: Two-sided risk of limits three standard deviations away.
ALPHA = 2 * NORMAL.cdf(-3)


def solve(f: Callable[[float], float], low: float, high: float) -> float:
    """Root of an increasing or decreasing function, by bisection to the last bits."""
    falling = f(low) > f(high)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if (f(middle) > 0) != falling:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def upper_u(alpha: float = ALPHA) -> float:
    """Standard normal quantile that leaves alpha / 2 above it."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return NORMAL.inv_cdf(1 - alpha / 2)


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(df / 2, x / 2)


@lru_cache(maxsize=4096)
def chi2_ppf(p: float, df: float) -> float:
    high = df + 10
    while chi2_cdf(high, df) < p:
        high *= 2
    return solve(lambda x: chi2_cdf(x, df) - p, 0.0, high)


def t_cdf(t: float, df: float) -> float:
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


@lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 10.0
    while t_cdf(high, df) < p:
        high *= 2
    return solve(lambda x: t_cdf(x, df) - p, 0.0, high)


def f_cdf(x: float, a: float, b: float) -> float:
    return beta_cdf(a * x / (a * x + b), a / 2, b / 2) if x > 0 else 0.0


def f_sf(x: float, a: float, b: float) -> float:
    return beta_cdf(b / (a * x + b), b / 2, a / 2) if x > 0 else 1.0


@lru_cache(maxsize=4096)
def f_ppf(p: float, a: float, b: float) -> float:
    high = 10.0
    while f_cdf(high, a, b) < p:
        high *= 2
    return solve(lambda x: f_cdf(x, a, b) - p, 0.0, high)


def beta_ppf(p: float, a: float, b: float) -> float:
    return solve(lambda x: beta_cdf(x, a, b) - p, 0.0, 1.0)


def _smallest(cdf: Callable[[int], float], p: float, high: int) -> int:
    """Smallest whole number of which the distribution function reaches p."""
    while cdf(high) < p:
        high *= 2
    low = -1
    while high - low > 1:
        middle = (low + high) // 2
        if cdf(middle) >= p:
            high = middle
        else:
            low = middle
    return high


@lru_cache(maxsize=65536)
def poisson_ppf(p: float, mean: float) -> int:
    if mean <= 0:
        return 0
    return _smallest(lambda k: 1 - gamma_cdf(k + 1, mean), p, int(mean) + 10)


@lru_cache(maxsize=65536)
def binom_ppf(p: float, n: int, share: float) -> int:
    if share <= 0:
        return 0
    if share >= 1:
        return n
    return min(n, _smallest(lambda k: 1.0 if k >= n else beta_cdf(1 - share, n - k, k + 1), p, max(1, n)))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _phi(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    return _erfc(-np.asarray(x) / math.sqrt(2)).astype(float) / 2


@lru_cache(maxsize=1024)
def range_cdf(w: float, n: int) -> float:
    """P(range of n standard normal values <= w)."""
    if w <= 0:
        return 0.0
    x = _NODES * 9
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return float(n * 9 * (_WEIGHTS * density * (_phi(x + w) - _phi(x)) ** (n - 1)).sum())


@lru_cache(maxsize=256)
def w_quantile(n: int, p: float) -> float:
    return solve(lambda w: range_cdf(w, n) - p, 0.0, 12.0)


@lru_cache(maxsize=64)
def _range_moments(n: int) -> tuple[float, float]:
    w = (_NODES + 1) * 7
    above = 1 - np.array([range_cdf(float(x), n) for x in w])
    first = 7 * (_WEIGHTS * above).sum()
    second = 2 * 7 * (_WEIGHTS * w * above).sum()
    return float(first), float(math.sqrt(second - first**2))


def d2(n: int) -> float:
    """Expected range of n standard normal values."""
    return 2 / math.sqrt(math.pi) if n == 2 else _range_moments(n)[0]


def d3(n: int) -> float:
    """Standard deviation of that range."""
    return _range_moments(n)[1]


def c4(n: int) -> float:
    """Expected standard deviation of n standard normal values."""
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


#: Standard deviation of the median over that of the mean, for 2 to 10 normal values.
CN = {2: 1.000, 3: 1.160, 4: 1.092, 5: 1.198, 6: 1.135, 7: 1.214, 8: 1.160, 9: 1.223, 10: 1.176}


def run_length(h: float, k: float, shift: float, nodes: int = 96) -> float:
    """Average run length of a one-sided CUSUM, by the integral equation on Gauss-Legendre nodes."""
    x, weights = np.polynomial.legendre.leggauss(nodes)
    x, weights = (x + 1) * h / 2, weights * h / 2
    density = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    kernel = density(x[None, :] - x[:, None] + k - shift) * weights[None, :]
    at_zero = _phi(k - shift - x)
    system = np.eye(nodes + 1)
    system[:nodes, :nodes] -= kernel
    system[:nodes, nodes] -= at_zero
    system[nodes, :nodes] -= density(x + k - shift) * weights
    system[nodes, nodes] -= NORMAL.cdf(k - shift)
    return float(np.linalg.solve(system, np.ones(nodes + 1))[nodes])


def cusum_arl(h: float, k: float, shift: float) -> float:
    """Average run length of the two-sided scheme."""
    return 1 / (1 / run_length(h, k, shift) + 1 / run_length(h, k, -shift))


@lru_cache(maxsize=64)
def cusum_h(k: float, arl0: float) -> float:
    """Limit of the scheme for a run length without a shift. The run length rises with the limit, so an upper end is found by doubling."""
    high = 1.0
    while cusum_arl(high, k, 0.0) < arl0:
        high *= 2
    return solve(lambda h: cusum_arl(h, k, 0.0) - arl0, 0.0, high)


def ewma_arl(width: float, lam: float, shift: float, nodes: int = 96) -> float:
    """Average run length of an EWMA chart with limits at width * sigma * sqrt(lam / (2 - lam))."""
    h = width * math.sqrt(lam / (2 - lam))
    x, weights = np.polynomial.legendre.leggauss(nodes)
    x, weights = x * h, weights * h
    density = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    kernel = density((x[None, :] - (1 - lam) * x[:, None]) / lam - shift) * weights[None, :] / lam
    lengths = np.linalg.solve(np.eye(nodes) - kernel, np.ones(nodes))
    return float(1 + (density(x / lam - shift) * weights / lam * lengths).sum())


def beyond(distance: float, alpha: float = ALPHA) -> float:
    """Chance that a statistic falls outside its limits when its mean has moved by a distance in its own deviations."""
    u = upper_u(alpha)
    return NORMAL.cdf(distance - u) + NORMAL.cdf(-distance - u)


def mean_size(shift: float, max_arl: float, alpha: float = ALPHA) -> int:
    """Least number of values in a mean whose chart finds a shift, in deviations of a value, within a mean run length.

    The distance that gives this run length is solved for; a mean of n values moves by the root of n times the shift.
    """
    if beyond(0.0, alpha) * max_arl >= 1:
        return 1
    distance = solve(lambda d: beyond(d, alpha) * max_arl - 1, 0.0, upper_u(alpha) + 40.0)
    return max(1, math.ceil((distance / abs(shift)) ** 2 - 1e-9))


def sidak(alpha: float, k: int) -> float:
    """Limit for the largest of k absolute z values."""
    return upper_u(1 - (1 - alpha) ** (1 / k))


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    t = t_ppf(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
