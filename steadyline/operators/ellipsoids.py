"""Performance of characteristics that are judged together: ranges of equal density against a tolerance ellipsoid.

Means and covariances of each group come from one aggregate. What is left, the
least Mahalanobis distance to the border of an ellipsoid, is a quadratic on a
sphere: a row of moments in, a row of indices out, in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyline.functions.numeric import NORMAL, chi2_cdf, solve

#: Rows at least, and largest condition of a covariance matrix.
LEAST, CONDITION = 10, 1e12
#: Largest index times three: beyond it a tail is 0 in doubles.
FARTHEST = 37.0


def least_on_sphere(b: np.ndarray, g: np.ndarray) -> float:
    """Smallest y'by + 2g'y over the unit sphere, b symmetric.

    The solution is -(b + t)^-1 g at the largest t for which it has length 1;
    where it stays shorter down to the smallest eigenvalue, the rest of the
    length lies along that one's direction and t is its negative.
    """
    value, axes = np.linalg.eigh(b)
    g = axes.T @ g
    size = max(1.0, float(np.abs(value).max()), float(np.linalg.norm(g)))
    lowest = -float(value[0])

    def length(t: float) -> float:
        return float(np.sum(np.square(g / (value + t))))

    inner = value - value[0] > 1e-9 * size
    if np.all(np.abs(g[~inner]) <= 1e-12 * size):
        y = np.where(inner, -g / np.where(inner, value - value[0], 1.0), 0.0)
        if (rest := 1 - float(y @ y)) >= 0:
            y[0] = math.sqrt(rest)
            return float(y @ (value * y) + 2 * g @ y)
    low, high = lowest + 1e-14 * size, lowest + float(np.linalg.norm(g)) + 1e-14 * size
    t = solve(lambda t: length(t) - 1, low, high) if length(low) > 1 else low
    y = -g / (value + t)
    return float(y @ (value * y) + 2 * g @ y)


def border_distance(mean: np.ndarray, cov: np.ndarray, middle: np.ndarray, half: np.ndarray) -> float:
    """Least Mahalanobis distance from `mean` to the border of the ellipsoid with a middle and half axes."""
    inverse = np.linalg.inv(cov)
    away = middle - mean
    b = half[:, None] * inverse * half
    return math.sqrt(max(0.0, float(away @ inverse @ away) + least_on_sphere((b + b.T) / 2, half * (inverse @ away))))


def two_sided(c: float, d: int) -> float:
    """Normal quantile with as much outside it, on both sides, as lies outside the range of radius c in d dimensions."""
    inside = chi2_cdf(c * c, d)
    q = 1 - inside if inside < 0.999 else _upper_gamma(d / 2, c * c / 2)
    return min(FARTHEST, -NORMAL.inv_cdf(q / 2)) if q > 0 else FARTHEST


def _upper_gamma(a: float, x: float) -> float:
    """Upper incomplete gamma function of a whole or half number, by its recurrence, so that small tails keep their digits."""
    out = math.erfc(math.sqrt(x)) if a % 1 else math.exp(-x)
    k = 0.5 if a % 1 else 1.0
    while k < a:
        out += math.exp(k * math.log(x) - x - math.lgamma(k + 1))
        k += 1
    return out


def ellipsoid_performance(df: DataFrame, columns: Sequence[str], lower: Sequence[float], upper: Sequence[float], *by: str) -> DataFrame:
    """One row per group: n, centre_inside, c_pmk, pmk, c_pm, pm of all `columns` together.

    The tolerance is the ellipsoid about the limits' middles with half their
    distances for axes. Pmk: a third of the two-sided normal quantile of the
    largest range of equal density about the mean that lies inside it, or less
    the smallest that reaches it where the mean is outside. Pm: the same with
    the mean in the middle. Rows with a null in a column are left out, and so
    are groups of under 10 rows or d + 2, or with a singular covariance.
    """
    d = len(columns)
    low, high = np.array(lower, float), np.array(upper, float)
    if d < 2 or len(low) != d or len(high) != d or not (low < high).all():
        raise ValueError("give a lower and an upper limit, the first below the second, for each of two columns at least")
    middle, half = (low + high) / 2, (high - low) / 2
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    keys = list(by)
    rows = df.select(*keys, *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop(subset=[f"x{i}" for i in range(d)])
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.avg(f"x{i}") for i in range(d))).alias("means"), F.array(*(F.covar_samp(f"x{i}", f"x{j}") for i, j in pairs)).alias("covs"))
    facts = facts.filter(F.col("n") >= max(LEAST, d + 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                mean, cov = np.array(r["means"], float), np.zeros((d, d))
                for (i, j), v in zip(pairs, r["covs"], strict=True):
                    cov[i, j] = cov[j, i] = v
                if np.linalg.matrix_rank(cov) < d or np.linalg.cond(cov) > CONDITION:
                    continue
                inside = bool(np.sum(np.square((mean - middle) / half)) <= 1)
                ck, cm = border_distance(mean, cov, middle, half), border_distance(middle, cov, middle, half)
                out.append((*(r[k] for k in keys), r["n"], inside, ck, (1 if inside else -1) * two_sided(ck, d) / 3, cm, two_sided(cm, d) / 3))
            yield pd.DataFrame(out, columns=[*keys, "n", "centre_inside", "c_pmk", "pmk", "c_pm", "pm"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.select(*keys).schema) + ", " if keys else ""
    return facts.mapInPandas(run, own + "n long, centre_inside boolean, c_pmk double, pmk double, c_pm double, pm double")
