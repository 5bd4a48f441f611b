"""The retrospective study of many series at once: chart, criteria, stability, indices and verdict.

One aggregate per subgroup, one per series, and one window pass for the
criteria. What comes to the driver is the distinct numbers of checked points
and of values, for quantiles that depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, binom_ppf, chi2_ppf, upper_u

from .counts import by_count
from . import charts
from .estimators import capability, index_intervals, verdict
from .measurements import whole_subgroups, with_position
from .rules import RuleSet, flags

#: Targets of (p, pk) by stage and class, and the sample sizes they are meant for.
TARGETS = {
    "machine": {"critical": (2.33, 2.00), "major": (2.00, 1.67), "minor": (1.67, 1.33), "others": (1.00, 1.00)},
    "preliminary": {"critical": (2.00, 1.67), "major": (1.67, 1.33), "minor": (1.33, 1.00), "others": (1.33, 1.00)},
    "production": {"critical": (1.67, 1.67), "major": (1.33, 1.33), "minor": (1.00, 1.00), "others": (1.00, 1.00)},
}
BASE_SIZE = {"machine": 50, "preliminary": 125, "production": 125}
#: Time models whose level and spread stay as they are.
CONTROL_MODELS = ("A1", "A2")


@lru_cache(maxsize=4096)
def _least_spread(n: int, confidence: float) -> float:
    """The share of its true deviation that n values show at least, with this confidence."""
    return math.sqrt(chi2_ppf(1 - confidence, n - 1) / (n - 1))


def with_targets(studies: DataFrame, confidence: float = 0.9999, bias_term: bool = False, agreed: Mapping[str, Mapping[str, tuple[float, float]]] = TARGETS) -> DataFrame:
    """studies: any columns with (stage, class, n). Adds p_target, pk_target and target_state.

    Targets are meant for a stage's base size. A smaller sample may show a
    smaller deviation by luck, so its targets rise by the ratio of what the two
    sizes show at least. bias_term: the location index's target also rises by
    the ratio of 1 + 1/(2n). agreed: targets agreed on with a customer, by stage
    and class. States: `table`, `raised`, `unknown` (no such stage or class, or
    a null; targets null), `too_few` (under two values, or a critical machine
    study under its base size: no smaller sample will do; targets null).
    """
    rows = [(stage, c, *pair, BASE_SIZE[stage]) for stage, classes in agreed.items() for c, pair in classes.items()]
    table = studies.sparkSession.createDataFrame(rows, "stage string, class string, p_full double, pk_full double, base int")  # a row per stage and class
    n, base = F.col("n"), F.col("base")
    full = n >= base
    alone = (F.col("stage") == "machine") & (F.col("class") == "critical")
    state = F.when(base.isNull() | n.isNull(), "unknown").when(full, "table").when(alone | (n < 2), "too_few").otherwise("raised")
    small = F.when(state == "raised", n)
    ratio = F.lit(None).cast("double")
    for size in sorted({r[-1] for r in rows}):
        ratio = F.when(base == size, _least_spread(size, confidence) / by_count(small, lambda k: _least_spread(k, confidence))).otherwise(ratio)
    for_location = (1 + 1 / (2 * n)) / (1 + 1 / (2 * base)) if bias_term else F.lit(1.0)
    raised = lambda target, more: F.when(full, F.col(target)).otherwise(F.col(target) * ratio * more)
    out = studies.join(F.broadcast(table), ["stage", "class"], "left").withColumns({"target_state": state, "p_target": raised("p_full", F.lit(1.0)), "pk_target": raised("pk_full", for_location)})
    return out.drop("p_full", "pk_full", "base")


def alarm_threshold(k: int, alpha: float, enabled: int, confidence: float = 0.99) -> int:
    """Alarm points that k checked points of a stable process stay within."""
    return binom_ppf(confidence, k, 1 - (1 - alpha) ** max(1, enabled))


def stability_class(stable: Column, model: str | None = None, controlled: bool = False) -> Column:
    if model in CONTROL_MODELS:
        quiet = "statistical_control"
    elif controlled:
        quiet = "in_control"
    else:
        quiet = "unknown" if model is None else "unstable"
    return F.when(stable.isNull(), "unknown").when(~stable, "unstable").otherwise(quiet)


def index_name(stage: str, stability: Column) -> Column:
    """The critical index's name: Cpk needs proven stability."""
    if stage != "production":
        return F.lit({"machine": "Pmk", "preliminary": "Ppk"}[stage])
    return F.when(stability.isin("statistical_control", "in_control"), "Cpk").otherwise("Ppk")


def numbered(points: DataFrame) -> DataFrame:
    """Charts of subgroups as series of their own, gapless in the order of the subgroups' first positions."""
    rows = points.withColumns({"own": F.col("series"), "series": F.concat_ws("|", "series", "chart")})
    return with_position(rows, "series", "ord")


def analyse(df: DataFrame, n: int, lsl: float, usl: float, rules: RuleSet = RuleSet(), alpha: float = ALPHA, stage: str = "production", cls: str = "major", model: str | None = None, bias_term: bool = False) -> DataFrame:
    """One row per series of subgroups of n: alarms, stability, indices with limits, targets for the number of values, and the verdict on pk.

    An X-bar and s chart for five values and more, else X-bar and R. Values of
    incomplete subgroups count nowhere. Criteria that need sigma are for the
    location chart alone.
    """
    groups = whole_subgroups(df, n)
    points = charts.xbar_s(groups, n, alpha) if n >= 5 else charts.xbar_r(groups, n, alpha)
    own = numbered(points)
    sigma = (F.col("ucl") - F.col("center")) / upper_u(alpha)
    plain = RuleSet(rules.beyond_limits, rules.run_length, rules.trend_length, rules.middle_third, middle_third_window=rules.middle_third_window, middle_third_low=rules.middle_third_low, middle_third_high=rules.middle_third_high)
    enabled = [x for x in ("beyond_limits", "run_length", "trend_length", "middle_third", "two_of_three_beyond_2s", "four_of_five_beyond_1s", "fifteen_within_1s") if getattr(rules, x)]

    def alarmed(chart: str, which: RuleSet) -> DataFrame:
        flagged = flags(own.filter(F.col("chart") == chart).withColumn("sigma", sigma).select("series", "pos", "own", "point", "center", "lcl", "ucl", "sigma").withColumnRenamed("own", "name"), which)
        names = [c for c in flagged.columns if c in ("beyond_limits", "run", "trend", "middle_third", "two_of_three_beyond_2s", "four_of_five_beyond_1s", "fifteen_within_1s")]
        hit = F.greatest(*(F.col(c) for c in names)) if len(names) > 1 else F.col(names[0])
        return flagged.groupBy(F.col("name").alias("series")).agg(F.count("*").alias(f"{chart}_points"), F.count_if(hit).alias(f"{chart}_alarms"))

    found = alarmed("location", rules).join(alarmed("variation", plain), "series")
    checked = F.col("location_points") + F.col("variation_points")
    threshold = by_count(checked, lambda k: alarm_threshold(k, alpha, len(enabled))).cast("int")
    found = found.withColumn("threshold", threshold).withColumn("stable", F.col("location_alarms") + F.col("variation_alarms") <= F.col("threshold"))

    whole = groups.select("series", F.col("label").alias("own_label"))
    values = df.withColumn("own_label", (F.floor(F.col("pos") / n) + 1).cast("string")).join(whole, ["series", "own_label"], "left_semi")
    indices = index_intervals(capability(values, lsl, usl))
    stability = stability_class(F.col("stable"), model)
    joined = with_targets(found.join(indices, "series").withColumns({"stability": stability, "stage": F.lit(stage), "class": F.lit(cls)}), bias_term=bias_term)
    judged = F.when(F.col("pk_target").isNull(), F.col("target_state")).otherwise(verdict(F.col("pk"), F.col("pk_low"), F.col("pk_target")))
    return joined.select(
        "series", "location_alarms", "variation_alarms", "threshold", "stable", "stability", index_name(stage, F.col("stability")).alias("index_name"), "n", "p", "pk", "pk_low", "pk_high", "p_target", "pk_target", "target_state", judged.alias("verdict")
    )
