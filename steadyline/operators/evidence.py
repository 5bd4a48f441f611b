"""Evidence about a series: time model, normality, bias, geometry, vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadyline.functions.numeric import t_ppf

from .counts import by_count
from .sequential import quadratic, vector_moments


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def time_model_evidence(groups: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """Facts from which a process's time model is read, one row per series.

    groups: whole subgroups of n; df: the values. f: variation of the means
    against that in subgroups; trend_r2: share of the means' variation on a
    straight line; dispersion: variance of ln s2 over what chance and the pooled
    kurtosis explain; skewness and kurtosis (population, not excess).
    """
    fourth = df.withColumn("label", (F.floor(F.col("pos") / n) + 1).cast("string")).join(groups.select("series", "label", "mean"), ["series", "label"])
    d = F.col("value") - F.col("mean")
    per = fourth.groupBy("series", "label").agg(F.sum(F.pow(d, F.lit(2))).alias("m2"), F.sum(F.pow(d, F.lit(4))).alias("m4"))
    # Unbiased fourth cumulant and squared variance of each subgroup, pooled.
    k4 = (n * (n + 1) * F.col("m4") - 3 * (n - 1) * F.col("m2") * F.col("m2")) * (1 / ((n - 1) * (n - 2) * (n - 3))) if n > 3 else F.lit(None).cast("double")
    v2 = (F.col("m2") / (n - 1)) * (F.col("m2") / (n - 1))
    pooled = per.groupBy("series").agg((F.avg(k4) / F.avg(v2)).alias("kappa"))
    means = groups.groupBy("series").agg(
        F.count("*").alias("k"), (n * F.var_samp("mean") / F.avg("var")).alias("f"), F.regr_r2("mean", F.col("ord").cast("double")).alias("trend_r2"), F.var_samp(F.log(F.when(F.col("var") > 0, F.col("var")))).alias("log_var")
    )
    shape = df.groupBy("series").agg(F.skewness("value").alias("skewness"), (F.kurtosis("value") + 3).alias("kurtosis"))
    out = means.join(pooled, "series").join(shape, "series")
    return out.select("series", "k", "f", "trend_r2", "kappa", (F.col("log_var") / (trigamma((n - 1) / 2) + F.coalesce("kappa", F.lit(0.0)) / n)).alias("dispersion"), "skewness", "kurtosis")


def normality(df: DataFrame) -> DataFrame:
    """D'Agostino and Pearson's test from the moments: z of skewness and kurtosis, and their sum of squares (chi-square with 2 degrees of freedom)."""
    s = df.groupBy("series").agg(F.count("*").cast("double").alias("n"), F.skewness("value").alias("g1"), (F.kurtosis("value") + 3).alias("b2")).filter("n >= 20")
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    t = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(t + F.sqrt(t * t + 1)) / F.sqrt(F.log(w2) / 2)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("b2") - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    cube = F.signum(ratio) * F.pow(F.abs(ratio), F.lit(1 / 3))
    z2 = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    out = s.select("series", z1.alias("z_skewness"), z2.alias("z_kurtosis"))
    k2 = F.col("z_skewness") * F.col("z_skewness") + F.col("z_kurtosis") * F.col("z_kurtosis")
    return out.select("series", "z_skewness", "z_kurtosis", k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def bias_study(df: DataFrame, reference: float, alpha: float = 0.05) -> DataFrame:
    """Readings of one reference: bias, its standard error, t and confidence limits. A t quantile per distinct count of readings."""
    s = df.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s")).filter("n > 1")
    table = by_count(F.col("n"), lambda n: t_ppf(1 - alpha / 2, n - 1))
    bias, se = F.col("mean") - reference, F.col("s") / F.sqrt("n")
    out = s.select("series", "n", bias.alias("bias"), se.alias("se"), (bias / se).alias("t"), table.alias("t_critical"))
    half = F.col("t_critical") * F.col("se")
    return out.select("*", (F.col("bias") - half).alias("low"), (F.col("bias") + half).alias("high"))


def position_deviation(dx: Column, dy: Column) -> Column:
    """Diameter of the smallest zone about the true position that holds the axis."""
    return 2 * F.sqrt(dx * dx + dy * dy)


def clearance(df: DataFrame, size: str, dx: str, dy: str, tolerance: float, limit: float, bore: bool = True) -> DataFrame:
    """Each part's clearance at maximum material: its zone grows by what its size departs from the limit."""
    departure = (F.col(size) - limit) if bore else (limit - F.col(size))
    zone = tolerance + departure
    return df.select("*", position_deviation(F.col(dx), F.col(dy)).alias("deviation"), (zone - position_deviation(F.col(dx), F.col(dy))).alias("clearance"))


def mardia_kurtosis(df: DataFrame, p: int, vector: str = "vec") -> DataFrame:
    """Mean squared distance to the fourth power, and its z value: one pass for the moments, one for the mean."""
    n, mean, cov = vector_moments(df, p, vector)
    d2 = quadratic(F.col(vector), mean, np.linalg.inv(cov * (n - 1) / n))
    b = df.agg(F.avg(d2 * d2).alias("b2"))
    return b.select("b2", ((F.col("b2") - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / n)).alias("z"))


def level_capability(df: DataFrame, level: str, lsl: float, usl: float) -> DataFrame:
    """Indices of each level of a factor (cavity, spindle) from its own spread."""
    s = df.groupBy(level).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter("sd > 0")
    return s.select(level, "n", "mean", "sd", ((usl - lsl) / (6 * F.col("sd"))).alias("pm"), F.least((F.col("mean") - lsl) / (3 * F.col("sd")), (usl - F.col("mean")) / (3 * F.col("sd"))).alias("pmk"))
