"""Analysis charts: one row per plotted point, with its centre line, limits and alarm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, CN, binom_ppf, c4, chi2_ppf, d2, d3, poisson_ppf, upper_u, w_quantile

from .lineage import cut
from .measurements import chunked, within_chunk
from .order import quantiles

D2 = d2(2)


def point(value: Column, center: Column, lcl: Column, ucl: Column) -> list[Column]:
    """The columns of a plotted point; it alarms strictly outside its limits."""
    return [value.alias("point"), center.alias("center"), lcl.alias("lcl"), ucl.alias("ucl"), ((value > ucl) | (value < lcl)).alias("alarm")]


def _range_limits(n: int, sigma: Column, center: Column, alpha: float, method: str) -> tuple[Column, Column]:
    if method == "iso7870":
        half = upper_u(alpha) * d3(n) * sigma
        return F.greatest(F.lit(0.0), center - half), center + half
    return w_quantile(n, alpha / 2) * sigma, w_quantile(n, 1 - alpha / 2) * sigma


def _two_charts(groups: DataFrame, estimates: DataFrame, where: str, spread: str, half: Column, limits: tuple[Column, Column], variation_center: Column) -> DataFrame:
    rows = groups.join(estimates, "series")
    low, high = limits
    location = rows.select("series", "label", "ord", F.lit("location").alias("chart"), *point(F.col(where), F.col("mu"), F.col("mu") - half, F.col("mu") + half))
    variation = rows.select("series", "label", "ord", F.lit("variation").alias("chart"), *point(F.col(spread), variation_center, low, high))
    return location.unionByName(variation)


def xbar_s(groups: DataFrame, n: int, alpha: float = ALPHA, method: str = "draft") -> DataFrame:
    """Means and standard deviations of whole subgroups of n values.

    draft: sigma is the root of the mean variance, limits of s by chi-square.
    iso7870: sigma is mean s / c4, limits of s at u standard errors, not under 0.
    """
    u, f = upper_u(alpha), n - 1
    est = groups.groupBy("series").agg(F.avg("mean").alias("mu"), F.avg("sd").alias("s_bar"), F.sqrt(F.avg("var")).alias("s_root"))
    if method == "iso7870":
        sigma, s_bar = F.col("s_bar") / c4(n), F.col("s_bar")
        wide = u * math.sqrt(1 - c4(n) ** 2) / c4(n)
        limits = F.greatest(F.lit(0.0), s_bar * (1 - wide)), s_bar * (1 + wide)
    else:
        sigma = F.col("s_root")
        limits = tuple(math.sqrt(chi2_ppf(q, f) / f) * sigma for q in (alpha / 2, 1 - alpha / 2))
    return _two_charts(groups, est, "mean", "sd", u * sigma / math.sqrt(n), limits, F.col("s_bar"))


def xbar_r(groups: DataFrame, n: int, alpha: float = ALPHA, method: str = "draft") -> DataFrame:
    """Means and ranges; sigma is the mean range / d2."""
    est = groups.groupBy("series").agg(F.avg("mean").alias("mu"), F.avg("range").alias("r_bar"))
    sigma = F.col("r_bar") / d2(n)
    return _two_charts(groups, est, "mean", "range", upper_u(alpha) * sigma / math.sqrt(n), _range_limits(n, sigma, F.col("r_bar"), alpha, method), F.col("r_bar"))


def median_r(groups: DataFrame, n: int, alpha: float = ALPHA, method: str = "draft") -> DataFrame:
    """Medians and ranges; the median's limits are wider by a fixed factor (n from 2 to 10)."""
    est = groups.groupBy("series").agg(F.avg("median").alias("mu"), F.avg("range").alias("r_bar"))
    sigma = F.col("r_bar") / d2(n)
    return _two_charts(groups, est, "median", "range", upper_u(alpha) * CN[n] * sigma / math.sqrt(n), _range_limits(n, sigma, F.col("r_bar"), alpha, method), F.col("r_bar"))


def moving_ranges(df: DataFrame) -> DataFrame:
    """`df` with `mr`, the distance to the value before; null for the first of a series."""
    return chunked(df, 1).withColumn("mr", F.abs(F.col("value") - F.lag("value").over(within_chunk()))).filter("own").drop("chunk", "own")


def imr(df: DataFrame, alpha: float = ALPHA, method: str = "draft") -> DataFrame:
    """Individual values and moving ranges of two. Positions must be gapless."""
    rows = moving_ranges(df)
    est = rows.groupBy("series").agg(F.avg("value").alias("mu"), F.avg("mr").alias("mr_bar"))
    joined = rows.join(est, "series")
    sigma = F.col("mr_bar") / D2
    half = upper_u(alpha) * sigma
    low, high = _range_limits(2, sigma, F.col("mr_bar"), alpha, method)
    location = joined.select("series", "pos", F.lit("location").alias("chart"), *point(F.col("value"), F.col("mu"), F.col("mu") - half, F.col("mu") + half))
    variation = joined.filter("mr is not null").select("series", "pos", F.lit("variation").alias("chart"), *point(F.col("mr"), F.col("mr_bar"), low, high))
    return location.unionByName(variation)


def imr_moving(df: DataFrame, moving_n: int = 3, alpha: float = ALPHA) -> DataFrame:
    """Moving means and ranges that start anew in each segment, with limits per phase and sample size.

    df has `segment` and `phase` (see `measurements.with_segments`). A point's
    sample grows from 1 to moving_n values in its segment. sigma comes from the
    complete moving samples of the phase.
    """
    most = max(moving_n, 2)
    rows = chunked(df, most - 1)
    own = Window.partitionBy("series", "chunk", "segment").orderBy("pos")
    first = df.groupBy("series", "segment").agg(F.min("pos").alias("first"))
    rows = rows.withColumns(
        {
            "mean": F.avg("value").over(own.rowsBetween(-(moving_n - 1), 0)),
            "range": F.max("value").over(own.rowsBetween(-(most - 1), 0)) - F.min("value").over(own.rowsBetween(-(most - 1), 0)),
        }
    ).filter("own")
    rows = rows.join(first, ["series", "segment"])
    rows = rows.withColumns({"t": F.least(F.col("pos") - F.col("first") + 1, F.lit(moving_n)), "tv": F.least(F.col("pos") - F.col("first") + 1, F.lit(most))})
    est = rows.groupBy("series", "phase").agg(F.avg("value").alias("mu"), F.avg(F.when(F.col("tv") == most, F.col("range"))).alias("r_bar")).filter("r_bar is not null")
    rows = rows.join(est, ["series", "phase"])
    sigma = F.col("r_bar") / d2(most)
    half = upper_u(alpha) * sigma / F.sqrt("t")

    def factor(q: float) -> Column:
        return reduce(lambda c, t: c.when(F.col("tv") == t, F.lit(w_quantile(t, q))), range(3, most + 1), F.when(F.col("tv") == 2, F.lit(w_quantile(2, q))))

    keys = ["series", "pos", "segment", "phase"]
    location = rows.select(*keys, F.lit("location").alias("chart"), *point(F.col("mean"), F.col("mu"), F.col("mu") - half, F.col("mu") + half))
    variation = rows.filter("tv >= 2").select(*keys, F.lit("variation").alias("chart"), *point(F.col("range"), F.col("r_bar"), factor(alpha / 2) * sigma, factor(1 - alpha / 2) * sigma))
    return location.unionByName(variation)


# -- Counts --------------------------------------------------------------------


def attribute_chart(df: DataFrame, kind: str, alpha: float = ALPHA) -> DataFrame:
    """p, np, c and u charts with exact binomial or Poisson limits.

    df: (series, pos, x, n); np and c need an n that does not vary. Limits depend
    on a series' centre and the size of a sample alone: each task finds them once
    for every distinct pair of series and size among its own, and they are joined
    on these two. No pair comes to the driver.
    """
    total = df.groupBy("series").agg((F.sum("x") / F.sum("n")).alias("rate"), F.avg("x").alias("mean_x"))
    # Sums of doubles depend on the order of rows, so there must be one result of them.
    total = cut(total)
    size = F.lit(1.0) if kind == "c" else F.col("n").cast("double")
    base = F.col("mean_x") if kind == "c" else F.col("rate")
    pairs = df.select("series", size.alias("size")).distinct().join(total, "series").select("series", "size", base.alias("base"))

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for center, n in zip(batch["base"], batch["size"], strict=True):
                if kind in ("p", "np"):
                    low, high = (binom_ppf(q, int(n), center) for q in (alpha / 2, 1 - alpha / 2))
                else:
                    low, high = (poisson_ppf(q, center * n) for q in (alpha / 2, 1 - alpha / 2))
                found.append((low / n, high / n) if kind in ("p", "u") else (float(low), float(high)))
            yield batch[["series", "size"]].assign(lcl_=[x[0] for x in found], ucl_=[x[1] for x in found])

    kind_of_series = df.select("series").schema["series"].dataType.simpleString()
    known = pairs.mapInPandas(limits, f"series {kind_of_series}, size double, lcl_ double, ucl_ double")
    rows = df.join(total, "series").withColumns({"base": base, "size": size}).join(known, ["series", "size"])
    value = F.col("x") / F.col("n") if kind in ("p", "u") else F.col("x").cast("double")
    center = F.col("rate") * F.col("n") if kind == "np" else F.col("base")
    return rows.select("series", "pos", *point(value, center, F.col("lcl_"), F.col("ucl_")))


def standardised(df: DataFrame, kind: str) -> DataFrame:
    """rate, centre, sigma and z of each sample of a p or u chart."""
    total = df.groupBy("series").agg((F.sum("x") / F.sum("n")).alias("center"))
    c = F.col("center")
    sigma = F.sqrt((c * (1 - c) if kind == "p" else c) / F.col("n"))
    rate = F.col("x") / F.col("n")
    return df.join(total, "series").select("series", "pos", "x", "n", rate.alias("rate"), "center", sigma.alias("sigma"), ((rate - c) / sigma).alias("z"))


def z_chart(df: DataFrame, kind: str, alpha: float = ALPHA) -> DataFrame:
    u = upper_u(alpha)
    return standardised(df, kind).select("series", "pos", *point(F.col("z"), F.lit(0.0), F.lit(-u), F.lit(u)))


def laney(df: DataFrame, kind: str, alpha: float = ALPHA) -> DataFrame:
    """p' and u' charts: limits wider by the standard deviation of the z values, from their moving range."""
    rows = standardised(df, kind)
    rows = moving_ranges(rows.withColumn("value", F.col("z")))
    extra = rows.groupBy("series").agg((F.avg("mr") / D2).alias("sigma_z"))
    half = upper_u(alpha) * F.col("sigma_z") * F.col("sigma")
    high = F.col("center") + half
    limits = F.greatest(F.lit(0.0), F.col("center") - half), F.least(F.lit(1.0), high) if kind == "p" else high
    return rows.join(extra, "series").select("series", "pos", "sigma_z", *point(F.col("rate"), F.col("center"), *limits))


# -- Special charts ------------------------------------------------------------


def g_chart(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Gaps between rare events (whole numbers), against quantiles of the geometric distribution of the mean gap."""
    est = df.groupBy("series").agg((1 / (F.avg("value") + 1)).alias("p"))

    def quantile(q: float) -> Column:
        # A quotient that rounding leaves just over a whole number counts as that number.
        return F.greatest(F.lit(0.0), F.ceil(F.lit(math.log1p(-q)) / F.log1p(-F.col("p")) - 1e-12).cast("double") - 1)

    return df.join(est.filter("p < 1"), "series").select("series", "pos", *point(F.col("value").cast("double"), quantile(0.5), quantile(alpha / 2), quantile(1 - alpha / 2)))


def percentile_chart(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Limits at the empirical quantiles; series under 5.4 / alpha values have none and are left out."""
    q = quantiles(df, {"low": alpha / 2, "mid": 0.5, "high": 1 - alpha / 2}, "series")
    q = q.filter(F.col("n") >= round(5.4 / alpha))
    return df.join(q, "series").select("series", "pos", *point(F.col("value"), F.col("mid"), F.col("low"), F.col("high")))


def _sigma_mr(df: DataFrame) -> DataFrame:
    return moving_ranges(df).groupBy("series").agg(F.avg("value").alias("mu"), (F.avg("mr") / D2).alias("sigma"))


def uwma_chart(df: DataFrame, span: int, alpha: float = ALPHA) -> DataFrame:
    """Average of the last `span` values; the first points average fewer and have wider limits."""
    ma = chunked(df, span - 1).withColumn("ma", F.avg("value").over(within_chunk().rowsBetween(-(span - 1), 0))).filter("own")
    half = upper_u(alpha) * F.col("sigma") / F.sqrt(F.least(F.col("pos") + 1, F.lit(span)))
    return ma.join(_sigma_mr(df), "series").select("series", "pos", *point(F.col("ma"), F.col("mu"), F.col("mu") - half, F.col("mu") + half))


def delta_target_chart(df: DataFrame, targets: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """df has `product`; targets: (product, target). Differences to the target on one chart per series.

    Products without a target are left out; `missing_targets` lists them.
    """
    delta = df.join(targets, "product").withColumn("value", F.col("value") - F.col("target"))
    half = upper_u(alpha) * F.col("sigma")
    return delta.join(_sigma_mr(delta), "series").select("series", "pos", "product", *point(F.col("value"), F.lit(0.0), -half, half))


def missing_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    return df.join(targets, "product", "left_anti").select("product").distinct()


def levey_jennings(df: DataFrame, stream: str, alpha: float = ALPHA, least: int = 20) -> DataFrame:
    """Each stream against its own mean and standard deviation; streams under `least` values are left out."""
    est = df.groupBy(stream).agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("sd") > 0))
    half = upper_u(alpha) * F.col("sd")
    return df.join(est, stream).select(stream, "pos", *point(F.col("value"), F.col("mu"), F.col("mu") - half, F.col("mu") + half))


def trend_chart(df: DataFrame, cycle: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """Residuals about a straight line over the position (in its cycle), with limits at u residual standard deviations."""
    x = F.col("pos") % cycle if cycle else F.col("pos")
    rows = df.withColumn("x", x.cast("double"))
    fit = rows.groupBy("series").agg(
        F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_syy("value", "x").alias("syy"), F.regr_sxy("value", "x").alias("sxy"), F.count("*").alias("n")
    )
    s = F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    fit = fit.select("series", "slope", "intercept", s.alias("s"))
    line = F.col("intercept") + F.col("slope") * F.col("x")
    half = upper_u(alpha) * F.col("s")
    return rows.join(fit, "series").select("series", "pos", "slope", *point(F.col("value"), line, line - half, line + half))


def extended_limits(groups: DataFrame, estimates: DataFrame, n: int, alpha: float = ALPHA, u_out: float = 1.5) -> DataFrame:
    """Limits that allow for variation between subgroups. estimates: `estimators.within_between`."""
    half = upper_u(alpha) * F.col("sigma_in") / math.sqrt(n) + u_out * F.col("sigma_out")
    return groups.join(estimates, "series").select("series", "label", *point(F.col("mean"), F.col("mu"), F.col("mu") - half, F.col("mu") + half))
