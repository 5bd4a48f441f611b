"""Machine performance of processes with several states: outlier screening, tests of widths and locations, type of dispersion, indices.

Screening takes out one extreme value after the other. Only extremes can go, so
each state gives a short list of its lowest and highest values with the ranks
that they take, and its count, mean and sum of squares, which are corrected for
every value that goes. A process whose list runs out is done again with a longer
one; rows are never scanned for a step. The rest is arithmetic on a row per state.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from steadyline.functions.numeric import chi2_cdf, f_sf, grubbs_critical

from .lineage import cut
from .order import ordered_values, quantiles

#: Ranks at either end of a state that are looked at first.
ENDS = 32
#: Share of a process's values that may go as outliers.
REMOVABLE = 1 / 3
#: Factor of the squared resolution that a variance is forced up to, by range in scale marks and number of values; and for no range and over 10 values.
FORCED = {
    0: {3: 0.25, 4: 0.19, 5: 0.16, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.12, 10: 0.11},
    1: {3: 1.0, 4: 0.74, 5: 0.63, 6: 0.56, 7: 0.52, 8: 0.49},
    2: {3: 2.25, 4: 1.67, 5: 1.41},
}
FORCED_MANY = 0.10

SCREENED = (
    "series string, state string, planned long, n long, mean double, ss double, low double, high double, low_gone long, high_gone long, step int, value double, g double, critical double, delta double, short boolean"
)


class _Ends:
    """What is left of a state while its extremes go."""

    def __init__(self, rows: pd.DataFrame):
        self.planned = self.n = int(rows.n.iloc[0])
        self.mean, self.ss = float(rows["mean"].iloc[0]), float(rows.ss.iloc[0])
        self.runs = list(rows.sort_values("before")[["value", "count", "before"]].itertuples(index=False, name=None))
        self.gone = [0, 0]

    def end(self, side: int) -> float | None:
        """Lowest (0) or highest (1) value that is left, None beyond the list."""
        rank = self.gone[0] if side == 0 else self.planned - 1 - self.gone[1]
        return next((v for v, k, b in self.runs if b <= rank < b + k), None)

    def drop(self, side: int) -> float | None:
        """Takes a value out; its distance to the mean of the others, if there are others."""
        x, n, mean = self.end(side), self.n, self.mean
        self.n -= 1
        self.gone[side] += 1
        if n == 1:
            return None
        self.mean = (n * mean - x) / (n - 1)
        self.ss = max(0.0, self.ss - (x - mean) * (x - self.mean))
        return x - self.mean


def _far(n: int, mean: float, ss: float, low: float, high: float, alpha: float) -> tuple[float, float, int] | None:
    """(g, critical, side) of the most extreme of n values if it is an outlier."""
    if n < 3 or ss <= 0 or low == high:
        return None
    side = int(high - mean > mean - low)
    g, critical = max(high - mean, mean - low) / math.sqrt(ss / (n - 1)), grubbs_critical(n, alpha)
    return (g, critical, side) if g > critical else None


def _screen(alpha: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states = {name: _Ends(own) for name, own in rows.groupby("state", sort=True)}
        total, removed, short = sum(s.n for s in states.values()), [], False
        while True:
            ends = {k: (s.end(0), s.end(1)) for k, s in states.items() if s.n}
            if any(v is None for pair in ends.values() for v in pair):
                short = True  # beyond the list: once more with a longer one
                break
            found = next(((k, f) for k in ends if (f := _far(states[k].n, states[k].mean, states[k].ss, *ends[k], alpha))), None)
            if found is None:
                n = sum(s.n for s in states.values())
                mean = sum(s.n * s.mean for s in states.values()) / n
                ss = sum(s.ss + s.n * (s.mean - mean) ** 2 for s in states.values())
                low, high = min(e[0] for e in ends.values()), max(e[1] for e in ends.values())
                if f := _far(n, mean, ss, low, high, alpha):
                    found = next(k for k in ends if ends[k][f[2]] == (low, high)[f[2]]), f
            if found is None or len(removed) + 1 > total * REMOVABLE:
                short = None if found else False  # None: too many would go
                break
            name, (g, critical, side) = found
            x = ends[name][side]
            removed.append((name, x, g, critical, states[name].drop(side)))
        flag = {None: None, True: True, False: False}[short]
        out = [(key[0], k, s.planned, s.n, s.mean if s.n else None, 0.0 if s.end(0) == s.end(1) else s.ss, s.end(0) if s.n else None, s.end(1) if s.n else None, s.gone[0], s.gone[1], 0, None, None, None, None, flag) for k, s in states.items()]
        out += [(key[0], k, *[None] * 8, i, x, g, c, d, flag) for i, (k, x, g, c, d) in enumerate(removed, 1)]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCREENED.split(", ")])
        return frame.astype({c: "Int64" for c in ("planned", "n", "low_gone", "high_gone")} | {"short": "boolean"})

    return run


def screened(df: DataFrame, alpha: float = 0.05, ends: int = ENDS) -> tuple[DataFrame, DataFrame]:
    """df: (series, state, value). Grubbs' test in each state and over all, one value at a time, until none is an outlier.

    Two tables. States: (series, state, planned, n, mean, var, low, high,
    low_gone, high_gone, usable), var null for one value. Removed: (series,
    state, step, value, g, critical, delta): delta is the value less the mean of
    the others of its state. Not usable are processes of which over a third
    would go; their states are as they were at that point. States go first, in
    order of their names, then the whole process. Nulls are left out. Infinite
    values lie apart from all others and go before any step: they count among
    the planned and the gone, and have no row among the removed.
    """
    every = df.filter("value is not null").select("series", F.col("state").cast("string").alias("state"), F.col("value").cast("double").alias("value"))
    rows = every.filter(F.abs("value") != math.inf)
    infinite = every.filter(F.abs("value") == math.inf).groupBy("series", "state").agg(F.count_if(F.col("value") < 0).alias("under"), F.count_if(F.col("value") > 0).alias("over"))
    facts = rows.groupBy("series", "state").agg(F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("ss"))
    ordered = cut(ordered_values(rows, "series", "state").join(facts, ["series", "state"]))
    done, left = None, ordered
    while True:
        near = (F.col("before") < ends) | (F.col("before") + F.col("count") > F.col("n") - ends)
        found = cut(left.filter(near).groupBy("series").applyInPandas(_screen(alpha), SCREENED))
        again = found.filter("short").select("series").distinct()
        whole = found.filter("short is null or not short")
        done = whole if done is None else done.union(whole)
        if again.isEmpty():
            break
        left, ends = ordered.join(again, "series", "left_semi"), 8 * ends
    states = done.filter("step = 0").select("series", "state", "planned", "n", "mean", F.when(F.col("n") > 1, F.col("ss") / (F.col("n") - 1)).alias("var"), "low", "high", "low_gone", "high_gone", F.col("short").isNotNull().alias("usable"))
    states = states.join(infinite, ["series", "state"], "left").na.fill(0, ["under", "over"])
    gone = {"planned": F.col("planned") + F.col("under") + F.col("over"), "low_gone": F.col("low_gone") + F.col("under"), "high_gone": F.col("high_gone") + F.col("over")}
    states = states.withColumns(gone).drop("under", "over")
    return states, done.filter("step > 0").select("series", "state", "step", "value", "g", "critical", "delta")


def forced(var: Column, n: Column, spread: Column, resolution: float) -> Column:
    """A variance, or the least that is credible for a range of up to two scale marks, if that is more."""
    marks = F.round(spread / resolution)
    factor = F.coalesce(*(F.when((marks == m) & (n == k), f) for m, row in FORCED.items() for k, f in row.items()), F.when((marks == 0) & (n > 10), FORCED_MANY))
    return F.greatest(var, F.coalesce(factor * resolution**2, F.lit(0.0)))


@pandas_udf(DoubleType())
def f_tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """P(F > f)."""
    return pd.Series([f_sf(x, p, q) if x == x and x is not None else None for x, p, q in zip(f, a, b, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X > x)."""
    return pd.Series([1 - chi2_cdf(v, k) if v == v and v is not None else None for v, k in zip(x, df, strict=True)], dtype=float)


def _some(x: Column) -> Column:
    """Null instead of 0, for a divisor."""
    return F.when(x != 0, x)


def multistate_performance(
    df: DataFrame, lsl: float, usl: float, alpha: float = 0.05, resolution: float | None = None, location: str = "mean", widths_equal: bool | None = None, locations_equal: bool | None = None,
    delta_m_variable: bool = False, delta_m_star: float | None = None, outlier_physical: bool = False, outlier_direction: str = "both",
) -> DataFrame:
    """df: (series, state, value). One row per process: its type of dispersion, 0 to 5, and Pm and Pmk.

    Columns: series, states, removed, usable, width_statistic, width_p,
    equal_widths, location_statistic, location_p, equal_locations, delta_m,
    sigma, type, pm, pmk_l, pmk_u, pmk. Two states are compared by the ratio of
    their variances and by t, Welch's where the widths differ; more by Bartlett's
    test, with variances forced up where `resolution` is given, and by
    n s_x^2 / s^2 with the planned size n. A decision of the analyst goes before
    a test's. An outlier that is real widens the dispersion by the largest
    distance of one, on the side that `outlier_direction` names. Processes that
    are not usable, of one state, or with a state of one value or (for
    Bartlett's test) without variation have no type and no indices.
    """
    if location not in ("mean", "median"):
        raise ValueError("location must be mean or median")
    if outlier_direction not in ("negative", "positive", "both"):
        raise ValueError("outlier_direction must be negative, positive or both")
    if not lsl < usl or not 0 < alpha < 0.5:
        raise ValueError("lsl must be below usl, and alpha between 0 and 0.5")
    states, removed = screened(df, alpha)
    states = cut(states)
    # Infinite values are gone too, but have no row among the removed.
    gone = states.groupBy("series").agg(F.sum(F.col("low_gone") + F.col("high_gone")).alias("removed")).join(removed.groupBy("series").agg(F.max(F.abs("delta")).alias("amplitude")), "series", "left")
    if location == "median":
        kept = ordered_values(df.withColumn("state", F.col("state").cast("string")), "series", "state").join(states.select("series", "state", "planned", "low_gone", "high_gone"), ["series", "state"])
        own = F.least(F.col("before") + F.col("count"), F.col("planned") - F.col("high_gone")) - F.greatest(F.col("before"), F.col("low_gone"))
        kept = cut(kept.select("series", "state", "value", own.alias("own")).filter("own > 0"))
        centres = quantiles(kept, {"centre": 0.5}, "series", "state", weight="own").drop("n")
        overall = quantiles(kept, {"overall": 0.5}, "series", weight="own").drop("n")
    else:
        centres = states.select("series", "state", F.col("mean").alias("centre"))
        overall = states.groupBy("series").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("overall"))
    v = F.col("var") if resolution is None else forced(F.col("var"), F.col("n"), F.col("high") - F.col("low"), resolution)
    s = states.join(centres, ["series", "state"]).withColumns({"v": v, "dof": F.when(F.col("n") > 1, F.col("n") - 1)})
    first = F.row_number().over(Window.partitionBy("series").orderBy("state"))  # states are few by nature
    s = s.withColumn("nth", first)
    at = lambda c, i: F.max(F.when(F.col("nth") == i, F.col(c)))
    t = s.groupBy("series").agg(
        F.count("*").alias("states"), F.min("usable").alias("usable"), F.max("planned").alias("plan"), F.min("n").alias("least"), F.sum("dof").alias("dof"), F.min("v").alias("v_least"),
        F.sum(F.col("dof") * F.col("var")).alias("ss"), F.sum(F.col("dof") * F.col("v")).alias("ss_forced"), F.sum(F.col("dof") * F.log("v")).alias("logs"), F.sum(1 / F.col("dof")).alias("inverse"),
        F.var_samp("mean").alias("of_means"), F.min("centre").alias("low"), F.max("centre").alias("high"), *(at(c, i).alias(f"{c}{i}") for c in ("n", "mean", "var") for i in (1, 2)),
    )
    k, dof, two = F.col("states"), F.col("dof"), F.col("states") == 2
    more, n1, n2 = _some(k - 1), _some(F.col("n1")), _some(F.col("n2"))
    pooled = F.col("ss") / dof
    bartlett = (dof * F.log(F.col("ss_forced") / dof) - F.col("logs")) / (1 + (F.col("inverse") - 1 / dof) / (3 * more))
    able = F.col("usable") & (k >= 2) & (F.col("least") >= 2) & (F.col("v_least") > 0)
    t = t.join(gone, "series", "left").join(overall, "series").withColumn("able", F.coalesce(able, F.lit(False)))
    t = t.withColumn("width_statistic", F.when(F.col("able"), F.when(two, F.col("var1") / _some(F.col("var2"))).otherwise(bartlett)))
    upper = f_tail("width_statistic", F.col("n1") - 1, F.col("n2") - 1)
    t = t.withColumn("width_p", F.when(two, F.least(F.lit(1.0), 2 * F.least(upper, 1 - upper))).otherwise(chi2_tail("width_statistic", k - 1)))
    t = t.withColumn("equal_widths", F.col("width_p") >= alpha if widths_equal is None else F.lit(widths_equal))
    e1, e2 = F.col("var1") / n1, F.col("var2") / n2
    apart = F.col("mean1") - F.col("mean2")
    error = F.when(F.col("equal_widths"), pooled * (1 / n1 + 1 / n2)).otherwise(e1 + e2)
    welch = (e1 + e2) * (e1 + e2) / _some(e1 * e1 / _some(n1 - 1) + e2 * e2 / _some(n2 - 1))
    t = t.withColumns({"location_statistic": F.when(F.col("able"), F.when(two, apart / F.sqrt(_some(error))).otherwise(F.col("plan") * F.col("of_means") / _some(pooled))), "t_dof": F.when(F.col("equal_widths"), dof.cast("double")).otherwise(welch)})
    x = F.col("location_statistic")
    t = t.withColumn("location_p", F.when(two, f_tail(x * x, F.lit(1.0), "t_dof")).otherwise(f_tail(x, k - 1, F.col("plan") * k - k)))
    t = t.withColumn("equal_locations", F.col("location_p") >= alpha if locations_equal is None else F.lit(locations_equal))
    t = t.withColumns({"sigma": F.sqrt(pooled), "delta_m": F.col("high") - F.col("low"), "amplitude": F.coalesce("amplitude", F.lit(0.0)) if outlier_physical else F.lit(0.0)})

    deviation = F.when(F.col("equal_widths"), F.col("sigma")).otherwise(F.sqrt("var"))
    below, above = (F.col("amplitude") if outlier_direction in (side, "both") else F.lit(0.0) for side in ("negative", "positive"))
    each = s.join(t.select("series", "equal_widths", "sigma", "amplitude"), "series").withColumns({"d": 3 * deviation, "dl": 3 * deviation + below, "du": 3 * deviation + above})
    c, dl, du = F.col("centre"), F.col("dl"), F.col("du")
    sides = each.groupBy("series").agg(
        F.max("dl").alias("dl"), F.max("du").alias("du"), F.max(dl + du).alias("widest"), F.min_by("dl", c - F.col("d")).alias("dl_lowest"), F.max_by("du", c + F.col("d")).alias("du_highest"),
        F.min((c - lsl) / _some(dl)).alias("least_l"), F.min((usl - c) / _some(du)).alias("least_u"),
    )
    t = t.join(sides, "series")
    ew, el, room = F.col("equal_widths"), F.col("equal_locations"), usl - lsl
    kind = F.when(ew & el, 0).when(ew, 2 if delta_m_variable else 1).when(el, 3).otherwise(5 if delta_m_variable else 4)
    t = t.withColumn("type", F.when(F.col("able"), kind))
    star = F.col("delta_m") if delta_m_star is None else F.lit(delta_m_star)
    pm = {0: room / (F.col("dl") + F.col("du")), 1: (room - F.col("delta_m")) / (F.col("dl") + F.col("du")), 2: room / (F.col("dl") + F.col("du") + star), 3: room / F.col("widest"),
          4: (room - F.col("delta_m")) / (F.col("dl_lowest") + F.col("du_highest")), 5: room / (F.col("dl") + F.col("du") + star)}
    one = F.col("type").isin(0, 3)
    pml = F.when(F.col("type") == 5, F.col("least_l")).otherwise((F.when(one, F.col("overall")).otherwise(F.col("low")) - lsl) / _some(F.col("dl")))
    pmu = F.when(F.col("type") == 5, F.col("least_u")).otherwise((usl - F.when(one, F.col("overall")).otherwise(F.col("high"))) / _some(F.col("du")))
    only = lambda x: F.when(F.col("able"), x)
    return t.select(
        "series", "states", F.coalesce("removed", F.lit(0)).alias("removed"), "usable", "width_statistic", "width_p", only(ew).alias("equal_widths"), "location_statistic", "location_p", only(el).alias("equal_locations"),
        "delta_m", "sigma", "type", F.coalesce(*(F.when(F.col("type") == i, f) for i, f in pm.items())).alias("pm"), only(pml).alias("pmk_l"), only(pmu).alias("pmk_u"), only(F.least(pml, pmu)).alias("pmk"),
    )
