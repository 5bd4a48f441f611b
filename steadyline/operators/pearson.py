"""Limits from the shape of the plotted values: Pearson curves from four moments, and quantiles of the family that fits best.

Moments are one aggregate over all series. A curve of the Pearson system is one
density whatever its type: its logarithm is the integral of
-(x + a) / (c0 + c1 x + c2 x^2), and its domain is where that quadratic is
positive about the mode. Each side of the mode is mapped to 0..1 and integrated
by Gauss-Legendre panels, a row per series, in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from steadyline.functions.numeric import ALPHA, gamma_cdf, solve

from .charts import point
from .fits import closed_fits, ranked, weibull_fit
from .order import _ppf

#: Plotted values that a shape is read from, at least.
LEAST = 30
#: Nearness of roots, and of the coefficients to nothing.
NEAR = 1e-9
#: Panels of a side of the mode, and nodes of each.
PANELS, NODES = 64, 12


class NoCurve(ValueError):
    """No unimodal curve has these moments."""


class Curve:
    """The Pearson curve of mean 0 and variance 1 with a skewness and a kurtosis (3 for the normal)."""

    def __init__(self, skewness: float, kurtosis: float):
        g, k = skewness, kurtosis
        if not (math.isfinite(g) and math.isfinite(k)) or k <= g * g + 1 + NEAR:
            raise NoCurve("no distribution has this skewness and kurtosis")
        d = 10 * k - 12 * g * g - 18
        if d <= NEAR:
            raise NoCurve("the curve has the form of a U or a J")
        self.a = self.c1 = g * (k + 3) / d
        self.c0, self.c2 = (4 * k - 3 * g * g) / d, (2 * k - 3 * g * g - 6) / d
        if abs(self.c2 * d) < 1e-7:
            self.c2 = 0.0
        self.mode = -self.a
        self.low, self.high, self.kind, self._log = self._shape()
        side = [self._mass(s, 1.0) for s in (-1, 1)]
        self.total, self.under = sum(side), side[0]

    def _shape(self):
        a, c0, c1, c2 = self.a, self.c0, self.c1, self.c2
        if c2 == 0 and abs(c1) < 1e-8:
            return -math.inf, math.inf, "normal", lambda x: -x * x / (2 * c0)
        if c2 == 0:
            end = -c0 / c1
            low, high = (end, math.inf) if c1 > 0 else (-math.inf, end)
            if not low < self.mode < high:
                raise NoCurve("the curve has the form of a J")
            return low, high, "III", lambda x: -x / c1 + (c0 / c1 - a) / c1 * np.log(np.abs(c0 + c1 * x))
        gap = c1 * c1 - 4 * c0 * c2
        u = -c1 / (2 * c2)
        if c2 > 0 and abs(gap) <= NEAR * max(1.0, c1 * c1):
            low, high = (u, math.inf) if self.mode > u else (-math.inf, u)
            return self._bell(low, high, "V", lambda x: -np.log(np.abs(x - u)) / c2 + (u + a) / (c2 * (x - u)))
        if gap < 0:
            w = math.sqrt(-gap) / (2 * c2)
            return self._bell(-math.inf, math.inf, "IV", lambda x: -np.log(np.square(x - u) + w * w) / (2 * c2) - (a + u) / (c2 * w) * np.arctan((x - u) / w))
        one, two = sorted((u - math.sqrt(gap) / (2 * c2), u + math.sqrt(gap) / (2 * c2)))
        p, q = -(one + a) / (c2 * (one - two)), -(two + a) / (c2 * (two - one))
        log = lambda x: p * np.log(np.abs(x - one)) + q * np.log(np.abs(x - two))
        if c2 < 0:
            if p <= 0 or q <= 0:
                raise NoCurve("the curve has the form of a J")
            return one, two, "I", log
        return self._bell(*((two, math.inf) if self.mode > two else (-math.inf, one)), "VI", log)

    def _bell(self, low: float, high: float, kind: str, log):
        if not low < self.mode < high or 1 / self.c2 <= 2:
            raise NoCurve("no unimodal curve has these moments")
        return low, high, kind, log

    def at(self, side: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x, dx/ds) on a side of the mode: s runs from 0 at the mode to 1 at the end."""
        end = self.low if side < 0 else self.high
        if math.isinf(end):
            return self.mode + side * s / (1 - s), 1 / np.square(1 - s)
        return end - (end - self.mode) * (1 - s) ** 3, abs(end - self.mode) * 3 * np.square(1 - s)

    def _mass(self, side: int, upto: float) -> float:
        """Integral, relative to the height of the mode, from the mode to s."""
        nodes, weights = np.polynomial.legendre.leggauss(NODES)
        width = upto / PANELS
        s = (np.arange(PANELS)[:, None] + (nodes + 1) / 2).ravel() * width
        x, slope = self.at(side, s)
        with np.errstate(all="ignore"):
            density = np.exp(self._log(x) - self._log(np.array(self.mode))) * slope
        return float(np.nan_to_num(density) @ np.tile(weights, PANELS)) * width / 2

    def quantile(self, p: float) -> float:
        goal = p * self.total - self.under
        side = 1 if goal > 0 else -1
        s = solve(lambda s: self._mass(side, s) - abs(goal), 0.0, 1.0)
        return float(self.at(side, np.array(min(s, 1 - 1e-15)))[0])


def shapes(df: DataFrame) -> DataFrame:
    """(series, n, mean, sd, skewness, kurtosis) of series of at least 30 values that vary, corrected for the bias of small samples."""
    s = df.groupBy("series").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.skewness("value").alias("g"), F.kurtosis("value").alias("k"))
    n = F.col("n").cast("double")
    return s.filter((F.col("n") >= LEAST) & (F.col("sd") > 0)).select(
        "series", "n", "mean", "sd", (F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), (((n + 1) * F.col("k") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3).alias("kurtosis")
    )


def pearson_quantiles(moments: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """moments: `shapes`. (series, kind, low, middle, high, reason): quantiles on the scale of the values, or why there is no curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    curve = Curve(r["skewness"], r["kurtosis"])
                    out.append((r["series"], curve.kind, *(r["mean"] + r["sd"] * curve.quantile(p) for p in (alpha / 2, 0.5, 1 - alpha / 2)), None))
                except NoCurve as why:
                    out.append((r["series"], None, None, None, None, str(why)))
            yield pd.DataFrame(out, columns=["series", "kind", "low", "middle", "high", "reason"])

    return moments.select("series", "mean", "sd", "skewness", "kurtosis").mapInPandas(run, "series string, kind string, low double, middle double, high double, reason string")


def pearson_chart(df: DataFrame, alpha: float = ALPHA, reference_n: int | None = None) -> DataFrame:
    """Values within the quantiles of their Pearson curve, about their mean; its kind beside them.

    The curve is that of the first `reference_n` positions, or of all. Series
    without one (under 30 values, no variation, or no unimodal curve) have no points.
    """
    moments = shapes(df if reference_n is None else df.filter(F.col("pos") < reference_n))
    limits = pearson_quantiles(moments, alpha).filter("kind is not null").join(moments.select("series", "mean"), "series")
    return df.join(limits, "series").select("series", "pos", "kind", *point(F.col("value"), F.col("mean"), F.col("low"), F.col("high")))


@pandas_udf(DoubleType())
def _family_quantile(family: pd.Series, a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
    """A quantile for each row, a series: the gamma family's is searched for."""

    def one(name: str, a: float, b: float, p: float) -> float:
        if name == "gamma":
            return b * solve(lambda x: gamma_cdf(a, x) - p, 0.0, 10 * a + 100)
        return float(_ppf(name, np.array([a]), np.array([b]), np.array([p]))[0])

    return pd.Series([one(*row) for row in zip(family, a, b, p, strict=True)], dtype=float)


def fitted_chart(df: DataFrame, alpha: float = ALPHA, reference_n: int | None = None) -> DataFrame:
    """Values within the quantiles of the family that describes them best (by AIC), about their mean; the family beside them.

    Families are those of `fits`. Series of under 30 values, or without variation, have no points.
    """
    own = df if reference_n is None else df.filter(F.col("pos") < reference_n)
    kept = own.join(shapes(own).select("series", "mean"), "series")
    # A likelihood without a bound is no fit: with a value of 0, the gamma family has none.
    found = closed_fits(kept).filter(F.abs("loglik") < math.inf).unionByName(weibull_fit(kept))
    best = ranked(found).filter("rank = 1")
    limits = best.select("series", "family", *(_family_quantile("family", "a", F.coalesce("b", F.lit(1.0)), F.lit(p)).alias(name) for name, p in (("low", alpha / 2), ("high", 1 - alpha / 2))))
    limits = limits.join(kept.groupBy("series").agg(F.first("mean").alias("mean")), "series")
    return df.join(limits, "series").select("series", "pos", "family", *point(F.col("value"), F.col("mean"), F.col("low"), F.col("high")))
