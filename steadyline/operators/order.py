"""Order statistics of series of any length: ranks by value, quantiles, and what is built on them.

Equal values are one row with a count, so a value that a third of all rows share
is a number. Distinct values are dealt to ranges of (series, value); prefix sums
of the ranges' counts and a running sum inside each give every value the ranks
that it takes. No task holds a series, and no aggregate all of its values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from steadyline.functions.numeric import NORMAL, gamma_cdf

from .counts import by_count
from .lineage import cut

#: Plotting positions that one row stands for at most.
PIECE = 65_536
#: Probabilities are kept from 0 and 1 by this much before their logarithm is taken.
NEAR = 1e-12


def ordered_values(df: DataFrame, *by: str, column: str = "value", weight: str | None = None) -> DataFrame:
    """(by..., value, count, before, n): the distinct values of each group; they take the ranks from before + 1 to before + count of n.

    Nulls are left out. A row counts once, or as often as the whole number `weight`.
    """
    keys = list(by)
    each = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("value")).agg(each.alias("count"))
    # The ranges depend on a sample, so they are fixed before they are counted.
    ranges = cut(counts.repartitionByRange(*keys, "value").withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy(*keys, "range").agg(F.sum("count").alias("rows"))
    own = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "range", F.coalesce(F.sum("rows").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ranges_before"), F.sum("rows").over(own).alias("n"))
    inside = Window.partitionBy(*keys, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranges.withColumn("upto", F.sum("count").over(inside)).join(sizes, [*keys, "range"])
    return ranked.select(*keys, "value", "count", (F.col("ranges_before") + F.col("upto") - F.col("count")).alias("before"), "n")


def holds(rank: Column) -> Column:
    """Whether a row of `ordered_values` takes a 0-based rank."""
    return (F.col("before") <= rank) & (rank < F.col("before") + F.col("count"))


def quantiles(df: DataFrame, probabilities: dict[str, float], *by: str, column: str = "value", weight: str | None = None) -> DataFrame:
    """One row per group: each named quantile, between the two values next to (n - 1) p, and n."""
    ends, out = [], []
    for name, p in probabilities.items():
        place = (F.col("n") - 1) * F.lit(p)
        low = F.floor(place)
        ends += [F.max(F.when(holds(low), F.col("value"))).alias(f"{name}_low"), F.max(F.when(holds(F.ceil(place)), F.col("value"))).alias(f"{name}_high")]
        out.append((F.col(f"{name}_low") + (place - low) * (F.col(f"{name}_high") - F.col(f"{name}_low"))).alias(name))
    found = ordered_values(df, *by, column=column, weight=weight).groupBy(*by, "n").agg(*ends)
    return found.select(*by, "n", *out)


def medians(df: DataFrame, *by: str, column: str = "value") -> DataFrame:
    """(by..., median)."""
    return quantiles(df, {"median": 0.5}, *by, column=column).drop("n")


# -- Fitted families against ranks ---------------------------------------------


def _cdf(family: str, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    if family in ("normal", "lognormal"):
        z = ((np.log(x) if family == "lognormal" else x) - a) / b
        return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z.tolist()])
    if family == "exponential":
        return -np.expm1(-x / a)
    if family == "rayleigh":
        return -np.expm1(-x * x / (2 * a * a))
    if family == "weibull":
        return -np.expm1(-np.power(x / b, a))
    if family == "gamma":
        return np.array([gamma_cdf(s, v) for s, v in zip(a.tolist(), (x / b).tolist(), strict=True)])
    raise ValueError(f"no distribution function of {family}")


def _ppf(family: str, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    if family in ("normal", "lognormal"):
        y = a + b * np.array([NORMAL.inv_cdf(v) for v in p.tolist()])
        return np.exp(y) if family == "lognormal" else y
    tail = -np.log1p(-p)
    if family == "exponential":
        return a * tail
    if family == "rayleigh":
        return a * np.sqrt(2 * tail)
    if family == "weibull":
        return b * np.power(tail, 1 / a)
    raise ValueError(f"no quantiles of {family} in closed form")


def _by_family(f, family: pd.Series, *columns: np.ndarray) -> np.ndarray:
    out = np.full(len(family), np.nan)
    for name in family.unique():
        own = (family == name).to_numpy()
        out[own] = f(name, *(c[own] for c in columns))
    return out


@pandas_udf(DoubleType())
def family_cdf(family: pd.Series, a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """Probability up to x under a family with its parameters."""
    return pd.Series(_by_family(_cdf, family, *(c.to_numpy(float) for c in (a, b, x))))


def anderson_darling(df: DataFrame, fits: DataFrame) -> DataFrame:
    """fits: (series, family, a, b). (series, family, n, a2): the squared distance of Anderson and Darling, from one sum over the distinct values.

    Value i of n counts ln F with 2i - 1 and ln(1 - F) with 2(n - i) + 1. The
    ranks b + 1 to u of equal values sum up to u^2 - b^2 and (n - b)^2 - (n - u)^2.
    """
    rows = ordered_values(df, "series").join(fits.select("series", "family", "a", "b"), "series")
    # NaN, of a family without a fit, comes back from pandas as null.
    p = F.least(F.greatest(F.coalesce(family_cdf("family", "a", "b", "value"), F.lit(math.nan)), F.lit(NEAR)), F.lit(1 - NEAR))
    u, b, n = (F.col("before") + F.col("count")).cast("double"), F.col("before").cast("double"), F.col("n").cast("double")
    part = F.log("p") * (u * u - b * b) + F.log1p(-F.col("p")) * ((n - b) * (n - b) - (n - u) * (n - u))
    sums = rows.withColumn("p", p).groupBy("series", "family", "n").agg(F.sum(part).alias("s"))
    return sums.select("series", "family", "n", (-F.col("n") - F.col("s") / F.col("n")).alias("a2"))


def pieces(ordered: DataFrame) -> DataFrame:
    """`ordered_values` with counts of PIECE at most: a value that many rows share becomes several rows."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(PIECE).cast("long"))
    rows = ordered.withColumn("at", F.explode(starts))
    return rows.withColumns({"before": F.col("before") + F.col("at"), "count": F.least(F.col("count") - F.col("at"), F.lit(PIECE))}).drop("at")


def quantile_sums(shift: float, stretch: float):
    """Sums over the ranks of a row of the quantiles at (i - shift) / (n + stretch), and of their squares, over ranks from `first` to `last` only. A column expression."""

    @pandas_udf("k long, q double, qq double")
    def found(family: pd.Series, a: pd.Series, b: pd.Series, before: pd.Series, count: pd.Series, n: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        low, high = np.maximum(before.to_numpy(), first.to_numpy()), np.minimum((before + count).to_numpy(), last.to_numpy())
        size = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(size)), size)
        rank = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        p = (rank + 1 - shift) / (n.to_numpy()[row] + stretch)
        q = _by_family(_ppf, family.iloc[row].reset_index(drop=True), a.to_numpy(float)[row], b.to_numpy(float)[row], p)
        return pd.DataFrame({"k": size, "q": np.bincount(row, q, len(size)), "qq": np.bincount(row, q * q, len(size))})

    return found


def plot_correlation(df: DataFrame, fits: DataFrame, side: str = "upper", share: float = 0.25) -> DataFrame:
    """fits: (series, family, a, b) of normal, lognormal, exponential, Rayleigh or Weibull. (series, family, n, n_tail, corr_all, corr_tail).

    Correlation of the ordered values with the family's quantiles at the
    plotting positions (i - 0.3) / (n + 0.4): over all, and over the `share` of
    them next to the limit on `side`, three at least. It tells how well a
    family describes the values, and is no test. Null where nothing varies.
    """
    if side not in ("upper", "lower"):
        raise ValueError("side must be upper or lower")
    ordered = pieces(ordered_values(df, "series"))
    centre = df.groupBy("series").agg(F.avg("value").alias("centre"))
    rows = ordered.join(centre, "series").join(fits.select("series", "family", "a", "b"), "series")
    m = F.least(F.col("n"), F.greatest(F.lit(3), F.round(F.col("n") * F.lit(share)).cast("long")))
    rows = rows.withColumns({"m": m, "x": F.col("value") - F.col("centre")})
    first, last = (F.col("n") - F.col("m"), F.col("n")) if side == "upper" else (F.lit(0).cast("long"), F.col("m"))
    sums = quantile_sums(0.3, 0.4)
    own = ("family", "a", "b", "before", "count", "n")
    rows = rows.withColumns({"all": sums(*own, F.lit(0).cast("long"), F.col("n")), "tail": sums(*own, first, last)})
    parts = []
    for c in ("all", "tail"):
        x, k = F.col("x"), F.col(f"{c}.k")
        q, qq = (F.coalesce(F.col(f"{c}.{v}"), F.lit(math.nan)) for v in ("q", "qq"))  # NaN, of a family without a fit, comes back from pandas as null
        parts += [F.sum(v).alias(f"{c}_{name}") for name, v in (("k", k), ("x", x * k), ("xx", x * x * k), ("q", q), ("qq", qq), ("xq", x * q))]
    total = rows.groupBy("series", "family", "n", "m").agg(*parts)

    def corr(c: str) -> Column:
        k, x, xx, q, qq, xq = (F.col(f"{c}_{v}") for v in ("k", "x", "xx", "q", "qq", "xq"))
        vx, vq = xx - x * x / k, qq - q * q / k
        return F.when((k >= 3) & (vx > 0) & (vq > 0), (xq - x * q / k) / F.sqrt(vx * vq))

    return total.select("series", "family", "n", F.col("m").alias("n_tail"), corr("all").alias("corr_all"), corr("tail").alias("corr_tail"))


#: Royston's polynomials for the weights of the two outer values (powers 1 to 5 of 1 / sqrt(n)), and for the distribution of W.
OUTER = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW_MEAN, FEW_SD, FEW_SHIFT = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
MANY_MEAN, MANY_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: Fixed value: the approximation holds up to so many values.
SHAPIRO_MOST = 5000


def _poly(c: tuple[float, ...], x: Column, first: int = 0) -> Column:
    return sum((v * F.pow(x, F.lit(float(k))) for k, v in enumerate(c, first)), F.lit(0.0))


@pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return z.map(lambda x: None if x is None or math.isnan(x) else 0.5 * math.erfc(x / math.sqrt(2)))


def shapiro_wilk(df: DataFrame, *by: str) -> DataFrame:
    """(by..., n, w, z, p) of groups of 4 to 5000 values that vary; others have no row, and longer ones a test by moments (`normality`)."""
    keys = list(by) or ["series"]
    ordered = ordered_values(df, *keys).filter(F.col("n").between(4, SHAPIRO_MOST))
    rows = ordered.withColumn("m", quantile_sums(0.375, 0.25)(F.lit("normal"), F.lit(0.0), F.lit(1.0), "before", "count", "n", F.lit(0).cast("long"), F.col("n")))
    n = F.col("n")
    at = lambda rank: F.max(F.when(holds(rank), F.col("value")))
    k = F.col("count")
    s = rows.groupBy(*keys, "n").agg(
        F.sum("m.qq").alias("mm"), F.sum(F.col("value") * F.col("m.q")).alias("xm"), F.sum(F.col("value") * k).alias("x"), at(F.lit(0)).alias("x1"), at(F.lit(1)).alias("x2"), at(n - 2).alias("y2"), at(n - 1).alias("y1"),
    )
    squares = ordered.join(s.select(*keys, (F.col("x") / n).alias("mean")), keys).groupBy(*keys).agg(F.sum(k * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))).alias("ss"))
    s = s.join(squares.filter("ss > 0"), keys)
    s = s.withColumns({f"m{i}": by_count(n, lambda k, i=i: NORMAL.inv_cdf((k + 1 - i - 0.375) / (k + 0.25))) for i in (1, 2)})
    u = 1 / F.sqrt(n)
    a1 = F.col("m1") / F.sqrt("mm") + _poly(OUTER, u, 1)
    a2 = F.col("m2") / F.sqrt("mm") + _poly(NEXT, u, 1)
    s = s.withColumns({"a1": a1, "a2": F.when(n > 5, a2)})
    m1, m2, wide, narrow = F.col("m1"), F.col("m2"), F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    two = n > 5
    scale = F.sqrt((F.col("mm") - 2 * m1 * m1 - F.when(two, 2 * m2 * m2).otherwise(0.0)) / (1 - 2 * F.col("a1") * F.col("a1") - F.when(two, 2 * F.col("a2") * F.col("a2")).otherwise(0.0)))
    inner = (F.col("xm") - m1 * wide - F.when(two, m2 * narrow).otherwise(0.0)) / scale
    top = F.col("a1") * wide + F.when(two, F.col("a2") * narrow).otherwise(0.0) + inner
    s = s.withColumn("w", F.least(F.lit(1.0), top * top / F.col("ss")))
    size, rest = n.cast("double"), F.log1p(-F.col("w"))
    few = (-F.log(_poly(FEW_SHIFT, size) - rest) - _poly(FEW_MEAN, size)) / F.exp(_poly(FEW_SD, size))
    many = (rest - _poly(MANY_MEAN, F.log(size))) / F.exp(_poly(MANY_SD, F.log(size)))
    s = s.withColumn("z", F.when(n <= 11, few).otherwise(many))
    return s.select(*keys, "n", "w", "z", normal_tail("z").alias("p"))


# -- Rank trend ------------------------------------------------------------------


def _signs(rank: np.ndarray) -> int:
    """Later values that are higher, less later values that are lower, over all pairs of an array: by merging runs of doubling length."""
    n, total, width = len(rank), 0, 1
    if n < 2:
        return 0
    span = int(rank.max()) + 2
    rank = rank - rank.min()
    while width < n:
        pair = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        key = pair * span + rank
        lower = np.sort(key[left])
        right = key[~left]
        base = np.searchsorted(lower, pair[~left] * span)
        ends = np.searchsorted(lower, (pair[~left] + 1) * span)
        under = np.searchsorted(lower, right, side="left") - base
        upto = np.searchsorted(lower, right, side="right")
        total += int(under.sum() - (ends - upto).sum())
        width *= 2
    return total


def _signs_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    order = rows.sort_values("pos")
    rank = np.unique(order["value"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    return pd.DataFrame([(key[0], _signs(rank))], columns=["series", "s"])


def _across(counts: DataFrame) -> DataFrame:
    """counts: (series, t, v, k), the rows of each block of time and of ranks. (series, s): signs of pairs in different blocks of both kinds.

    The table of blocks is filled up, so it has the square of (rows / block) cells.
    """
    grid = counts.select("series", "t").distinct().join(counts.select("series", "v").distinct(), "series").join(counts, ["series", "t", "v"], "left").na.fill(0, ["k"])
    earlier = Window.partitionBy("series", "v").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.withColumn("earlier", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    row = Window.partitionBy("series", "t")
    under = F.coalesce(F.sum("earlier").over(row.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = filled.withColumns({"under": under, "whole": F.sum("earlier").over(row)})
    return placed.groupBy("series").agg(F.sum(F.col("k") * (2 * F.col("under") + F.col("earlier") - F.col("whole"))).alias("s"))


@pandas_udf(DoubleType())
def _exact_p(n: pd.Series, lower: pd.Series) -> pd.Series:
    """Two-sided probability of so few discordant (or concordant) pairs among n values in random order."""

    def one(n: int, c: int) -> float:
        ways = [1]
        for k in range(2, n + 1):  # orders of k values by their inversions
            ways = [sum(ways[max(0, i - k + 1) : i + 1]) for i in range(len(ways) + k - 1)]
        return min(1.0, 2 * sum(ways[: c + 1]) / sum(ways))

    return pd.Series([one(int(k), int(c)) for k, c in zip(n, lower, strict=True)], dtype=float)


#: Up to so many values without ties the probability of tau is exact.
EXACT_MOST = 33


def rank_trend(df: DataFrame, block: int = PIECE) -> DataFrame:
    """Kendall's tau of values with their order: (series, n, s, tau, z, p) of series whose values vary.

    s: pairs that rise less pairs that fall. Series are cut in blocks of
    positions and in blocks of value ranks. Pairs in one block of either kind
    are counted by merging inside tasks (those in one block of both kinds but
    once); pairs in different blocks of both kinds by prefix sums over the table
    of block counts. No pair is formed, and
    no task holds a series. p is two-sided; exact up to 33 values without ties.
    """
    ranks = ordered_values(df, "series")
    rows = df.filter("value is not null").select("series", "pos", F.col("value").cast("double").alias("value")).join(ranks.select("series", "value", "before", "count"), ["series", "value"])
    # A value that fills a block of ranks by itself is a block of its own, after the smaller values of the one that it starts in; there is nothing to count in it.
    alone = F.col("count") > block
    v = 2 * F.floor(F.col("before") / block) + alone.cast("long")
    rows = cut(rows.select("series", "pos", "value", F.floor(F.col("pos") / block).alias("t"), v.alias("v"), alone.alias("alone")))
    mixed, kind = rows.filter("not alone"), "series string, s long"
    in_time = rows.groupBy("series", "t").applyInPandas(_signs_of, kind)
    in_ranks = mixed.groupBy("series", "v").applyInPandas(_signs_of, kind)
    in_both = mixed.groupBy("series", "t", "v").applyInPandas(_signs_of, kind)
    across = _across(cut(rows.groupBy("series", "t", "v").agg(F.count("*").alias("k"))))
    total = in_time.union(in_ranks).union(in_both.select("series", -F.col("s"))).union(across).groupBy("series").agg(F.sum("s").alias("s"))
    ties = ranks.groupBy("series", "n").agg(F.sum(F.col("count") * (F.col("count") - 1)).cast("double").alias("t2"), F.sum((F.col("count") * (F.col("count") - 1)).cast("double") * (2 * F.col("count") + 5)).alias("t3"))
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    pairs = n * (n - 1)
    out = ties.join(total, "series").filter((F.col("t2") < pairs) & (n > 1))
    z = s / F.sqrt((pairs * (2 * n + 5) - F.col("t3")) / 18)
    few = (F.col("n") <= EXACT_MOST) & (F.col("t2") == 0)
    lower = ((pairs / 2 - F.abs(s)) / 2).cast("long")
    exact = _exact_p(F.when(few, F.col("n")).otherwise(1), F.when(few, lower).otherwise(0))
    out = out.withColumn("z", z)
    return out.select("series", "n", "s", (2 * s / F.sqrt(pairs * (pairs - F.col("t2")))).alias("tau"), "z", F.when(few, exact).otherwise(2 * normal_tail(F.abs("z"))).alias("p"))
