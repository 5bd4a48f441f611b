"""Charts with memory, multivariate charts and autocorrelated series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, chi2_ppf, f_ppf

from .charts import point
from .measurements import by_series, chunked, within_chunk


def _in_order(df: DataFrame, step, schema: str) -> DataFrame:
    """Fold each series in order of `pos`, with the state carried over batches of rows.

    A chart that starts anew after its own signals depends on all points before,
    so a series is one task's; the task holds one batch and the state.
    """
    ordered = by_series(df).sortWithinPartitions("series", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.series != series:
                    series, state = row.series, None
                state, made = step(state, row)
                out.append((row.series, row.pos, *made))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return ordered.mapInPandas(run, schema)


def cusum(df: DataFrame, target: str, sigma: str, k: float = 0.5, h: float = 4.774897046326059) -> DataFrame:
    """Two-sided tabular CUSUM, in units of sigma, which starts again after each signal.

    df has the columns named by `target` and `sigma`, constant in a series.
    """

    def step(state, row):
        high, low = state or (0.0, 0.0)
        z = (row.value - row.target_) / row.sigma_
        high, low = max(0.0, high + z - k), min(0.0, low + z + k)
        signal = "shift_up" if high > h else "shift_down" if -low > h else None
        return (None if signal else (high, low)), (high, low, signal)

    rows = df.select("series", "pos", "value", F.col(target).alias("target_"), F.col(sigma).alias("sigma_"))
    return _in_order(rows, step, "series string, pos long, high double, low double, signal string")


def cusum_sums(df: DataFrame, target: str, sigma: str, k: float = 0.5) -> DataFrame:
    """The same sums without a restart, natively: a sum less its running minimum."""
    z = (F.col("value") - F.col(target)) / F.col(sigma)
    rows = df.withColumns({"up": z - k, "down": z + k})
    order = Window.partitionBy("series").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"up": F.sum("up").over(order), "down": F.sum("down").over(order)})
    high = F.col("up") - F.least(F.lit(0.0), F.min("up").over(order))
    low = F.col("down") - F.greatest(F.lit(0.0), F.max("down").over(order))
    return rows.select("series", "pos", high.alias("high"), low.alias("low"))


def ewma(df: DataFrame, target: str, sigma: str, lam: float = 0.2, width: float = 2.962) -> DataFrame:
    """Exponentially weighted mean with exact limits, which starts again after each signal."""

    def step(state, row):
        z, i = state or (row.target_, 0)
        z, i = lam * row.value + (1 - lam) * z, i + 1
        half = width * row.sigma_ * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * i)))
        signal = "shift_up" if z > row.target_ + half else "shift_down" if z < row.target_ - half else None
        return (None if signal else (z, i)), (z, half, signal)

    rows = df.select("series", "pos", "value", F.col(target).alias("target_"), F.col(sigma).alias("sigma_"))
    return _in_order(rows, step, "series string, pos long, z double, half double, signal string")


# -- Vectors -------------------------------------------------------------------


def vector_moments(df: DataFrame, p: int, vector: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean vector and covariance matrix of the first p elements, in one pass."""
    v = [F.col(vector)[i].cast("double") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(F.count("*"), *(F.avg(x) for x in v), *(F.covar_samp(v[i], v[j]) for i, j in pairs)).first()
    cov = np.zeros((p, p))
    for (i, j), c in zip(pairs, row[1 + p :], strict=True):
        cov[i, j] = cov[j, i] = c
    return row[0], np.array(row[1 : 1 + p]), cov


def quadratic(vector: Column, mean: np.ndarray, inverse: np.ndarray) -> Column:
    """(x - mean)' inverse (x - mean) as a plain expression."""
    p = len(mean)
    d = [vector[i].cast("double") - float(mean[i]) for i in range(p)]
    terms = [float(inverse[i, i]) * d[i] * d[i] for i in range(p)] + [2 * float(inverse[i, j]) * d[i] * d[j] for i in range(p) for j in range(i + 1, p)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def t2_limit(p: int, alpha: float, n_ref: int | None = None) -> float:
    """Upper limit of T2: chi-square with known parameters, else a scaled F quantile."""
    if n_ref is None:
        return chi2_ppf(1 - alpha, p)
    return p * (n_ref + 1) * (n_ref - 1) / (n_ref * (n_ref - p)) * f_ppf(1 - alpha, p, n_ref - p)


def t2_chart(df: DataFrame, p: int, vector: str = "vec", alpha: float = ALPHA) -> DataFrame:
    """T2 of each vector against the mean and covariance of all, and what each element adds to it."""
    n, mean, cov = vector_moments(df, p, vector)
    x = F.col(vector)
    t2 = quadratic(x, mean, np.linalg.inv(cov))
    limit = t2_limit(p, alpha, n)
    out = df.withColumn("t2", t2)
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        kept = F.array(*(x[i] for i in rest))
        out = out.withColumn(f"d{j + 1}", F.col("t2") - quadratic(kept, mean[rest], np.linalg.inv(cov[np.ix_(rest, rest)])))
    return out.withColumn("alarm", F.col("t2") > limit)


def _vector_fold(df: DataFrame, mean: np.ndarray, cov: np.ndarray, vector: str, step) -> DataFrame:
    """Fold whitened deviations of each series: in these coordinates the covariance is the unit matrix."""
    p = len(mean)
    whiten = np.linalg.inv(np.linalg.cholesky(cov))

    def run(state, row):
        return step(state, whiten @ (np.array(row.value, float)[:p] - mean))

    rows = df.select("series", "pos", F.col(vector).alias("value"))
    return _in_order(rows, run, "series string, pos long, statistic double, signal boolean")


def mewma(df: DataFrame, mean: np.ndarray, cov: np.ndarray, vector: str = "vec", lam: float = 0.1, h: float = 8.66) -> DataFrame:
    """Multivariate EWMA with its exact covariance at the start, which starts again after each signal."""

    def step(state, d):
        z, i = state or (np.zeros(len(d)), 0)
        z, i = lam * d + (1 - lam) * z, i + 1
        q = float(z @ z) / (lam / (2 - lam) * (1 - (1 - lam) ** (2 * i)))
        return (None if q > h else (z, i)), (q, q > h)

    return _vector_fold(df, mean, cov, vector, step)


def mcusum(df: DataFrame, mean: np.ndarray, cov: np.ndarray, vector: str = "vec", k: float = 0.5, h: float = 5.5) -> DataFrame:
    """Crosier's multivariate CUSUM, which starts again after each signal."""

    def step(state, d):
        v = (np.zeros(len(d)) if state is None else state) + d
        c = float(np.sqrt(v @ v))
        s = v * (1 - k / c) if c > k else np.zeros(len(d))
        y = float(np.sqrt(s @ s))
        return (None if y > h else s), (y, y > h)

    return _vector_fold(df, mean, cov, vector, step)


# -- Autocorrelation -----------------------------------------------------------


def lag_products(df: DataFrame, lags: int) -> DataFrame:
    """One row per series: n, and c0 ... c_lags, the mean products of deviations `lag` apart."""
    mean = df.groupBy("series").agg(F.avg("value").alias("mean"))
    rows = df.join(mean, "series").withColumn("d", F.col("value") - F.col("mean"))
    own = chunked(rows, lags).withColumns({f"l{k}": F.lag("d", k).over(within_chunk()) for k in range(1, lags + 1)}).filter("own")
    return own.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), *(F.coalesce(F.sum(F.col("d") * F.col(f"l{k}")), F.lit(0.0)).alias(f"c{k}") for k in range(1, lags + 1)))


def ljung_box(df: DataFrame, lags: int = 10) -> DataFrame:
    """Autocorrelations at each lag, and Q."""
    c = lag_products(df, lags)
    r = [F.col(f"c{k}") / F.col("c0") for k in range(1, lags + 1)]
    n = F.col("n")
    q = n * (n + 2) * sum((x * x / (n - k) for k, x in enumerate(r[1:], 2)), r[0] * r[0] / (n - 1))
    return c.select("series", "n", r[0].alias("r1"), q.alias("q"))


def ar_fit(df: DataFrame, order: int = 1) -> DataFrame:
    """Conditional least squares of a deviation on the `order` before it: phi, and the residual standard deviation (series, phi, sigma_e, n).

    One aggregate gives the normal equations of each series; they are solved per series row.
    """
    mean = df.groupBy("series").agg(F.avg("value").alias("mean"))
    rows = df.join(mean, "series").withColumn("l0", F.col("value") - F.col("mean"))
    rows = chunked(rows, order).withColumns({f"l{k}": F.lag("l0", k).over(within_chunk()) for k in range(1, order + 1)}).filter(f"own and l{order} is not null")
    names = [f"s{i}_{j}" for i in range(order + 1) for j in range(i, order + 1)]
    sums = rows.groupBy("series").agg(F.first("mean").alias("mean"), F.count("*").alias("n"), *(F.sum(F.col(f"l{i}") * F.col(f"l{j}")).alias(f"s{i}_{j}") for i in range(order + 1) for j in range(i, order + 1)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                s = np.zeros((order + 1, order + 1))
                for name in names:
                    i, j = map(int, name[1:].split("_"))
                    s[i, j] = s[j, i] = row[name]
                phi = np.linalg.solve(s[1:, 1:], s[0, 1:])
                sse = s[0, 0] - phi @ s[0, 1:]
                out.append((row["series"], row["mean"], row["n"], phi.tolist(), math.sqrt(max(0.0, sse) / (row["n"] - order))))
            yield pd.DataFrame(out, columns=["series", "mean", "n", "phi", "sigma_e"])

    return sums.mapInPandas(solve, "series string, mean double, n long, phi array<double>, sigma_e double")


def ar_residual_chart(df: DataFrame, fit: DataFrame, order: int, u: float = 3.0) -> DataFrame:
    """Residuals of the fitted model, missing history counting as the mean, within u residual standard deviations."""
    rows = df.join(fit.select("series", "mean", "phi", "sigma_e"), "series").withColumn("d", F.col("value") - F.col("mean"))
    rows = chunked(rows, order).withColumns({f"l{k}": F.coalesce(F.lag("d", k).over(within_chunk()), F.lit(0.0)) for k in range(1, order + 1)}).filter("own")
    e = F.col("d") - sum((F.col("phi")[k - 1] * F.col(f"l{k}") for k in range(2, order + 1)), F.col("phi")[0] * F.col("l1"))
    half = u * F.col("sigma_e")
    return rows.select("series", "pos", *point(e, F.lit(0.0), -half, half))


def stream_anova(df: DataFrame, time: str, stream: str) -> DataFrame:
    """Two-way analysis of balanced streams measured at the same times: one row of n, k, mu, sigma_within and sigma_time.

    Cells are averaged first, so a time or a stream is never gathered in one task.
    """
    cells = df.groupBy(time, stream).agg(F.avg("value").alias("value"))
    times = cells.groupBy(time).agg(F.avg("value").alias("t_mean"), F.count("*").alias("k"))
    streams = cells.groupBy(stream).agg(F.avg("value").alias("s_mean"))
    grand = cells.agg(F.avg("value").alias("mu"), F.count_distinct(time).alias("n"), F.count_distinct(stream).alias("k"))
    rows = cells.join(times.drop("k"), time).join(F.broadcast(streams), stream).join(F.broadcast(grand))  # a row per stream; one row
    sse = rows.groupBy("mu", "n", "k").agg(F.sum(F.pow(F.col("value") - F.col("t_mean") - F.col("s_mean") + F.col("mu"), F.lit(2))).alias("sse"), F.var_pop("t_mean").alias("t_var"))
    n, k = F.col("n"), F.col("k")
    within = F.col("sse") / ((n - 1) * (k - 1))
    time_ms = F.col("t_var") * n * k / (n - 1)
    return sse.select("n", "k", "mu", F.sqrt(within).alias("sigma_within"), F.sqrt(F.greatest(F.lit(0.0), (time_ms - within) / k)).alias("sigma_time"))
