"""The time model of a process: what its location, its variation and its shape do, and the model that follows.

Evidence is one row per series: sums over subgroups, ranks for the trend, order
statistics for the shape, and a binned density for its modes. The decision is a
table of conditions over that row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from steadyline.functions.numeric import chi2_cdf, f_sf

from .evidence import trigamma
from .lineage import cut
from .order import SHAPIRO_MOST, rank_trend, shapiro_wilk

#: Limits of the decision.
ALPHA, BORDERLINE = 0.01, 0.05
MIN_GROUPS, MIN_VALUES, MODE_GROUPS = 8, 30, 20
DISPERSION_RATIO, TREND_SHARE = 1.8, 0.5
#: Models that go with what is known about a process.
HINT_MODELS = {
    "natural_limit": ("A2", "C2"), "different_fixtures": ("C1", "C2"), "tool_wear_trend": ("C3", "C4"), "tool_or_batch_changes": ("C4",), "spindle_wear": ("B",), "multi_stream": ("D",),
}
#: Chart for the analysis, chart for control, sample size and frequency that suit a model.
CHARTS = {
    "A1": ("shewhart", "shewhart", "smaller", "lower"), "A2": ("pearson", "pearson", "smaller", "lower"), "B": ("pearson", "shewhart", "bigger", "lower"),
    "C": ("extended", "acceptance", "smaller", "higher"), "D": ("extended", "acceptance", "bigger", "higher"),
}
#: Points at which a density is looked at, bins between two of them, and share of the highest that a peak must rise by.
GRID, BINS, PROMINENCE = 512, 8, 0.1


# -- Modes -----------------------------------------------------------------------


def peaks(density: np.ndarray, prominence: float = PROMINENCE) -> int:
    """Local maxima, a level stretch once, that rise by a share of the highest over the higher of the lowest points towards higher ground on both sides."""
    d = density[np.r_[True, density[1:] != density[:-1]]]
    tops = np.flatnonzero((d[1:-1] > d[:-2]) & (d[1:-1] > d[2:])) + 1
    found = 0
    for at in tops.tolist():
        left, right = np.flatnonzero(d[:at] > d[at]), np.flatnonzero(d[at + 1 :] > d[at])
        low = d[left[-1] if len(left) else 0 : at].min(), d[at + 1 : at + 1 + (right[0] + 1 if len(right) else len(d))].min()
        found += d[at] - max(low) >= prominence * density.max()
    return found


def _modes_of(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    mass = np.zeros(GRID * BINS + 2)
    np.add.at(mass, bins["bin"].to_numpy(), bins["here"].to_numpy())
    np.add.at(mass, bins["bin"].to_numpy() + 1, bins["next"].to_numpy())
    reach = len(mass)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * float(bins["width"].iloc[0])) ** 2)
    density = np.convolve(mass, kernel)[reach : reach + GRID * BINS : BINS]
    return pd.DataFrame([(key[0], max(1, peaks(density)))], columns=["series", "modes"])


def modes(df: DataFrame) -> DataFrame:
    """(series, modes): clear peaks of a Gaussian kernel density with Silverman's width, 1 where fewer than 30 values or no variation.

    Values are dealt to fine bins, each between the two next to it, in one
    aggregate; the bins of a series, some thousands at most, are smoothed in a task.
    """
    s = df.groupBy("series").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))
    factor = F.pow(0.75 * F.col("n"), F.lit(-0.2))
    pad = 3 * F.col("sd") * F.sqrt((F.col("n") - 1) / F.col("n")) * factor
    able = (F.col("n") >= MIN_VALUES) & (F.col("sd") > 0)
    s = s.withColumns({"low": F.col("least") - pad, "step": (F.col("most") - F.col("least") + 2 * pad) / ((GRID - 1) * BINS), "h": F.col("sd") * factor, "able": F.coalesce(able, F.lit(False))})
    rows = df.filter("value is not null").join(s.filter("able").select("series", "low", "step", (F.col("step") / F.col("h")).alias("width")), "series")
    place = (F.col("value") - F.col("low")) / F.col("step")
    rows = rows.withColumns({"bin": F.floor(place), "rest": place - F.floor(place)})
    bins = rows.groupBy("series", "bin").agg(F.sum(1 - F.col("rest")).alias("here"), F.sum("rest").alias("next"), F.first("width").alias("width"))
    found = bins.groupBy("series").applyInPandas(_modes_of, "series string, modes int")
    return s.select("series").join(found, "series", "left").select("series", F.coalesce("modes", F.lit(1)).alias("modes"))


# -- Evidence ----------------------------------------------------------------------


@pandas_udf(DoubleType())
def _f_p(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([f_sf(x, p, q) if x == x and x is not None else None for x, p, q in zip(f, a, b, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([1 - chi2_cdf(v, k) if v == v and v is not None else None for v, k in zip(x, df, strict=True)], dtype=float)


def evidence(groups: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """groups: whole subgroups of n consecutive positions (series, ord, mean, sd, var). df: the values (series, pos, value).

    One row per series: k, anova_p, between_to_within, trend_p, trend_tau,
    trend_r2, after_trend_p, modes_of_means, dispersion_p, dispersion_ratio,
    sd_trend_p, instantaneous_p, resulting_p, skewness, kurtosis, modes. The
    tests of shape take every so-manieth value where there are over 5000. Series
    whose values do not vary in the subgroups have no row.
    """
    groups = cut(groups.select("series", F.floor(F.col("ord") / n).alias("at"), "mean", "sd", "var"))
    rows = df.withColumn("at", F.floor(F.col("pos") / n)).join(groups.select("series", "at", "mean"), ["series", "at"]).withColumn("rest", F.col("value") - F.col("mean"))
    rows = cut(rows.select("series", "at", "pos", "value", "rest"))
    d2, d4 = F.pow("rest", F.lit(2.0)), F.pow("rest", F.lit(4.0))
    per = rows.groupBy("series", "at").agg(F.avg(d2).alias("m2"), F.avg(d4).alias("m4"))
    if n >= 4:
        k4 = n * n * ((n + 1) * F.col("m4") - 3 * (n - 1) * F.col("m2") * F.col("m2")) / ((n - 1) * (n - 2) * (n - 3))
        kappa = per.groupBy("series").agg((F.avg(k4) / F.pow(F.avg(F.col("m2") * n / (n - 1)), F.lit(2.0))).alias("kappa"))
    else:
        kappa = per.groupBy("series").agg((F.avg("m4") / F.pow(F.avg("m2"), F.lit(2.0)) - 3).alias("kappa"))
    log_var = F.log(F.greatest(F.col("var"), F.lit(1e-300)))
    g = groups.groupBy("series").agg(
        F.count("*").alias("k"), F.avg("var").alias("within"), F.var_samp("mean").alias("between"), F.regr_r2("mean", F.col("at").cast("double")).alias("trend_r2"), F.var_samp(log_var).alias("log_var")
    )
    g = g.filter("within > 0 and k > 2").join(kappa, "series")
    k, within, between = F.col("k").cast("double"), F.col("within"), F.col("between")
    ratio = F.col("log_var") / (trigamma((n - 1) / 2) + F.greatest(F.col("kappa"), F.lit(0.0)) / n)
    g = g.withColumn("dispersion_ratio", ratio)
    left = (k - 1) * between * (1 - F.coalesce("trend_r2", F.lit(0.0))) / (k - 2)
    g = g.select(
        "series", "k", _f_p(n * between / within, k - 1, k * (n - 1)).alias("anova_p"), F.sqrt(F.greatest(F.lit(0.0), between - within / n) / within).alias("between_to_within"), "trend_r2",
        _f_p(left * n / within, k - 2, k * (n - 1)).alias("after_trend_p"), _chi2_p(F.col("dispersion_ratio") * (k - 1), k - 1).alias("dispersion_p"), "dispersion_ratio",
    )
    trend = rank_trend(groups.select("series", F.col("at").alias("pos"), F.col("mean").alias("value"))).select("series", F.col("p").alias("trend_p"), F.col("tau").alias("trend_tau"))
    sd_trend = rank_trend(groups.select("series", F.col("at").alias("pos"), F.col("sd").alias("value"))).select("series", F.col("p").alias("sd_trend_p"))
    thin = rows.join(g.select("series", F.ceil(F.col("k") * n / SHAPIRO_MOST).alias("thin")), "series").filter(F.col("pos") % F.col("thin") == 0)
    shapes = [shapiro_wilk(thin.select("series", F.col(c).alias("value"))).select("series", F.col("p").alias(name)) for c, name in (("rest", "instantaneous_p"), ("value", "resulting_p"))]
    moments = rows.groupBy("series").agg(F.skewness("value").alias("skewness"), (F.kurtosis("value") + 3).alias("kurtosis"))
    of_means = modes(groups.select("series", F.col("mean").alias("value"))).withColumnRenamed("modes", "modes_of_means")
    out = g
    for other in (trend, sd_trend, *shapes, moments, modes(rows), of_means):
        out = out.join(other, "series", "left")
    return out.withColumn("modes_of_means", F.when(F.col("k") >= MODE_GROUPS, F.col("modes_of_means")).otherwise(1))


# -- Decision ------------------------------------------------------------------------


def _decided(alpha: float) -> tuple[Column, Column]:
    """(model, reasons in the order of the decision) at a limit."""
    under = lambda c: F.coalesce(F.col(c) <= alpha, F.lit(False))
    moves = under("anova_p") | under("trend_p")
    spreads = under("dispersion_p") & (F.col("dispersion_ratio") >= DISPERSION_RATIO)
    normal, inner = ~under("resulting_p"), ~under("instantaneous_p")
    several = (F.col("modes") > 1) | (F.col("modes_of_means") > 1)
    trend = under("trend_p") & (F.col("trend_r2") >= TREND_SHARE)
    still, steady = ("location_constant",), ("variation_constant",)
    table = [
        (spreads & moves, "D", ("variation_changes", "location_changes")),
        (spreads, "B", ("variation_changes", *still)),
        (~moves & several, "D", (*steady, *still, "multimodal")),
        (~moves & normal, "A1", (*steady, *still, "normal")),
        (~moves, "A2", (*steady, *still, "not_normal_unimodal")),
        (trend & under("after_trend_p"), "C4", (*steady, "location_changes", "trend", "random_remainder")),
        (trend, "C3", (*steady, "location_changes", "trend")),
        (several, "C4", (*steady, "location_changes", "random_location", "multimodal")),
        (~inner, "C4", (*steady, "location_changes", "random_location", "instantaneous_not_normal")),
        (normal, "C1", (*steady, "location_changes", "random_location", "normal")),
        (F.lit(True), "C2", (*steady, "location_changes", "random_location", "not_normal_unimodal")),
    ]
    model = F.coalesce(*(F.when(c, m) for c, m, _ in table))
    reasons = F.coalesce(*(F.when(c, ",".join(why)) for c, _, why in table))
    return model, reasons


def decide(found: DataFrame, n: int, alpha: float = ALPHA, blocks: bool = False, hints: Sequence[str] = ()) -> DataFrame:
    """found: `evidence`. (series, k, model, reasons, alternatives, borderline, confidence, in_control, analysis_chart, control_chart, sample_size, frequency).

    alternatives: other models at five times the limit and at a fifth of it;
    borderline: tests near the limit. Confidence falls with few groups, with
    `blocks` (subgroups that were cut from a plain series), with borderline
    tests, and with a hint that the model does not agree with. Too few groups or
    values have no model, and the reason `not_enough_data`.
    """
    unknown = set(hints) - set(HINT_MODELS)
    if unknown:
        raise ValueError(f"unknown hints: {sorted(unknown)}")
    model, reasons = _decided(alpha)
    looser, stricter = _decided(5 * alpha)[0], _decided(alpha / 5)[0]
    rows = found.withColumns({"model": model, "reasons": reasons, "looser": looser, "stricter": stricter})
    first = F.when(F.col("looser") != F.col("model"), F.col("looser"))
    second = F.when((F.col("stricter") != F.col("model")) & (F.col("stricter") != F.col("looser")), F.col("stricter"))
    near = [F.when((F.col(c) > alpha / 5) & (F.col(c) < BORDERLINE), F.lit(c)) for c in ("anova_p", "trend_p", "dispersion_p", "resulting_p", "instantaneous_p", "after_trend_p")]
    rows = rows.withColumns({"alternatives": F.concat_ws(",", first, second), "borderline": F.concat_ws(",", *near)})
    level = F.when((F.col("k") >= 25) & (F.col("k") * n >= 100), 2).when(F.col("k") >= 12, 1).otherwise(0)
    level = F.least(level, F.lit(1)) if blocks else level
    level = F.greatest(F.lit(0), level - F.when(F.col("borderline") != "", 1).otherwise(0))
    if hints:
        agrees = reduce(Column.__and__, [F.col("model").isin(*HINT_MODELS[h]) for h in hints])
        level = F.when(agrees, level).otherwise(F.greatest(F.lit(0), level - 1))
    kind = F.when(F.col("model").startswith("C"), "C").otherwise(F.col("model"))
    enough = (F.col("k") >= MIN_GROUPS) & (F.col("k") * n >= MIN_VALUES)
    chart = [F.coalesce(*(F.when(kind == m, row[i]) for m, row in CHARTS.items())) for i in range(4)]
    given = {
        "model": F.col("model"), "reasons": F.col("reasons"), "alternatives": F.col("alternatives"), "borderline": F.col("borderline"),
        "confidence": F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), level + 1), "in_control": F.col("model").isin("A1", "A2"),
        **dict(zip(("analysis_chart", "control_chart", "sample_size", "frequency"), chart, strict=True)),
    }
    blank = {"reasons": F.lit("not_enough_data"), "alternatives": F.lit(""), "borderline": F.lit("")}
    return rows.select("series", "k", *(F.when(enough, c).otherwise(blank.get(name)).alias(name) for name, c in given.items()))


def suggested(groups: DataFrame, df: DataFrame, n: int, alpha: float = ALPHA, blocks: bool = False, hints: Sequence[str] = ()) -> DataFrame:
    """The time model of each series that its subgroups suggest, with reasons and charts."""
    if not 0 < alpha < 0.2 or math.isnan(alpha):
        raise ValueError("alpha must lie between 0 and 0.2")
    if n < 2:
        raise ValueError("subgroups need two values at least")
    return decide(cut(evidence(groups, df, n)), n, alpha, blocks, hints)
