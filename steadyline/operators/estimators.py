"""Estimators and indices: everything is an aggregate of aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, NORMAL, c4, chi2_ppf, d2, upper_u

from .counts import by_count
from .order import medians, quantiles


def location(groups: DataFrame) -> DataFrame:
    """groups: whole subgroups. l3: mean of means; l4: mean of medians."""
    return groups.groupBy("series").agg(F.avg("mean").alias("l3"), F.avg("median").alias("l4"))


def overall(df: DataFrame) -> DataFrame:
    """l1: mean, l2: median, d5: total standard deviation, range and count of the values."""
    rest = df.groupBy("series").agg(F.avg("value").alias("l1"), F.stddev_samp("value").alias("d5"), (F.max("value") - F.min("value")).alias("total_range"), F.count("*").alias("n"))
    return rest.join(medians(df, "series").withColumnRenamed("median", "l2"), "series", "left").select("series", "l1", "l2", "d5", "total_range", "n")


def dispersion(groups: DataFrame, n: int) -> DataFrame:
    """d2: root of the mean variance; d3: mean s / c4; d4: mean range / d2(n); and the plain means."""
    return groups.groupBy("series").agg(
        F.sqrt(F.avg("var")).alias("sigma_var"), (F.avg("sd") / c4(n)).alias("sigma_s"), (F.avg("range") / d2(n)).alias("sigma_r"), F.avg("sd").alias("s_bar"), F.avg("range").alias("r_bar")
    )


def within_between(groups: DataFrame, n: int) -> DataFrame:
    """Mean of means, and the standard deviation in and between subgroups."""
    return groups.groupBy("series").agg(
        F.avg("mean").alias("mu"), F.sqrt(F.avg("var")).alias("sigma_in"), F.sqrt(F.greatest(F.lit(0.0), F.var_samp("mean") - F.avg("var") / n)).alias("sigma_out"), F.count("*").alias("k")
    )


def extremes(groups: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k largest and of the k smallest subgroup means.

    The window keeps k rows per task and series before it shuffles.
    """
    def end(order, name):
        w = Window.partitionBy("series").orderBy(order, "ord")
        return groups.select("series", "mean", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k).groupBy("series").agg(F.avg("mean").alias(name))

    return end(F.desc("mean"), "mu_max").join(end(F.asc("mean"), "mu_min"), "series")


def moments(df: DataFrame) -> DataFrame:
    """Mean, s, and bias-corrected skewness and kurtosis (not excess)."""
    m = df.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    n = F.col("n")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3
    return m.filter("n > 3").select("series", "n", "mean", "s", skew.alias("skewness"), kurt.alias("kurtosis"))


def capability(df: DataFrame, lsl: float | None, usl: float | None) -> DataFrame:
    """p, pk, pl, pu from the total standard deviation; p is null with one limit."""
    s = df.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s")).filter("s > 0")
    return s.select("series", "n", "mean", "s", *_indices(F.col("mean"), F.col("s"), lsl, usl))


def _indices(mean, sigma, lsl, usl, prefix="p"):
    none = F.lit(None).cast("double")
    pl = (mean - lsl) / (3 * sigma) if lsl is not None else none
    pu = (usl - mean) / (3 * sigma) if usl is not None else none
    p = (usl - lsl) / (6 * sigma) if lsl is not None and usl is not None else none
    return p.alias(prefix), F.least(pl, pu).alias(f"{prefix}k"), pl.alias(f"{prefix}l"), pu.alias(f"{prefix}u")


def within_capability(groups: DataFrame, n: int, lsl: float | None, usl: float | None) -> DataFrame:
    """Cw and Cwk from the standard deviation in subgroups: for diagnosis only."""
    s = groups.groupBy("series").agg(F.avg("mean").alias("mean"), F.sqrt(F.avg("var")).alias("sigma"))
    return s.select("series", "mean", "sigma", *_indices(F.col("mean"), F.col("sigma"), lsl, usl, "cw"))


def quantile_capability(df: DataFrame, lsl: float | None, usl: float | None) -> DataFrame:
    """Indices from the empirical 0.135 %, 50 % and 99.865 % quantiles."""
    q = quantiles(df, {"low": 0.00135, "mid": 0.5, "high": 0.99865}, "series")
    low, mid, high = (F.col(c) for c in ("low", "mid", "high"))
    none = F.lit(None).cast("double")
    pl = (mid - lsl) / (mid - low) if lsl is not None else none
    pu = (usl - mid) / (high - mid) if usl is not None else none
    p = (usl - lsl) / (high - low) if lsl is not None and usl is not None else none
    return q.select("series", low.alias("x_low"), mid.alias("x_mid"), high.alias("x_high"), p.alias("p"), F.least(pl, pu).alias("pk"))


def out_of_spec(df: DataFrame, lsl: float | None, usl: float | None) -> DataFrame:
    """Parts per million outside the limits, as counted."""
    below = F.lit(False) if lsl is None else F.col("value") < lsl
    above = F.lit(False) if usl is None else F.col("value") > usl
    return df.groupBy("series").agg((1e6 * F.avg(below.cast("double"))).alias("ppm_below"), (1e6 * F.avg(above.cast("double"))).alias("ppm_above"))


def index_intervals(indices: DataFrame, confidence: float = 0.95) -> DataFrame:
    """indices: (series, n, p, pk). Confidence limits of both.

    The limits of p need a quantile for each n; tasks find them.
    """
    low, high = (by_count(F.col("n"), lambda n, q=q: math.sqrt(chi2_ppf(q, n - 1) / (n - 1)) if n > 1 else None) for q in ((1 - confidence) / 2, (1 + confidence) / 2))
    u = NORMAL.inv_cdf((1 + confidence) / 2)
    half = u * F.sqrt(1 / (9 * F.col("n")) + F.pow("pk", F.lit(2)) / (2 * (F.col("n") - 1)))
    return indices.select("series", "n", "p", (F.col("p") * low).alias("p_low"), (F.col("p") * high).alias("p_high"), "pk", (F.col("pk") - half).alias("pk_low"), (F.col("pk") + half).alias("pk_high"))


def spread(sigma: float, alpha: float = ALPHA) -> float:
    return 2 * upper_u(alpha) * sigma


def verdict(pk, pk_low, target: float):
    """meets, meets_estimate_only, meets_no_interval or fails."""
    return F.when(pk < target, "fails").when(pk_low.isNull(), "meets_no_interval").when(pk_low >= target, "meets").otherwise("meets_estimate_only")


def best_split(groups: DataFrame, min_part: int = 8) -> DataFrame:
    """The two-level split of the subgroup means that explains most: where it is, and both levels.

    Prefix sums run over subgroups, which are fewer than rows by the subgroup size.
    """
    order = Window.partitionBy("series").orderBy("ord")
    upto = groups.select("series", "ord", F.row_number().over(order).alias("i"), F.sum("mean").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("left"))
    whole = groups.groupBy("series").agg(F.sum("mean").alias("all"), F.count("*").alias("n"))
    a, b = F.col("left") / F.col("i"), (F.col("all") - F.col("left")) / (F.col("n") - F.col("i"))
    scored = upto.join(whole, "series").filter((F.col("i") >= min_part) & (F.col("n") - F.col("i") >= min_part))
    scored = scored.withColumns({"a": a, "b": b}).withColumn("score", F.pow(F.col("a") - F.col("b"), 2) * F.col("i") * (F.col("n") - F.col("i")) / F.col("n"))
    best = scored.groupBy("series").agg(F.max_by(F.struct("i", "a", "b", "score"), F.struct(F.round("score", 9), -F.col("i"))).alias("best"))
    return best.select("series", F.col("best.i").alias("split_after"), F.col("best.a").alias("level_before"), F.col("best.b").alias("level_after"), "best.score")


def coverage(df: DataFrame, factor: str, subgroup: str, thin_share: float = 0.5) -> DataFrame:
    """Per level of a factor: values, share, distinct subgroups, and whether it has under `thin_share` of an equal share."""
    levels = df.groupBy(F.col(factor).cast("string").alias("level")).agg(F.count("*").alias("values"), F.count_distinct(subgroup).alias("subgroups"))
    total = levels.agg(F.sum("values").alias("all"), F.count("*").alias("levels"))
    out = levels.join(F.broadcast(total))  # one row
    share = F.col("values") / F.col("all")
    return out.select("level", "values", "subgroups", share.alias("share"), (share < thin_share / F.col("levels")).alias("thin"))
