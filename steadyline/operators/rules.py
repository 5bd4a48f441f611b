"""Stability criteria over plotted points, as bounded windows.

A run or a trend that is long enough at a point shows in the last few points
alone, so every criterion looks at a frame of fixed length. Series are cut in
chunks that repeat as many rows of the chunk before; no criterion needs a
whole series in one task. Runs and trends do not cross a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measurements import chunked


@dataclass(frozen=True)
class RuleSet:
    """Which criteria apply, and their lengths; only the limits by default."""

    beyond_limits: bool = True
    run_length: int | None = None
    trend_length: int | None = None
    middle_third: bool = False
    two_of_three_beyond_2s: bool = False
    four_of_five_beyond_1s: bool = False
    fifteen_within_1s: bool = False
    middle_third_window: int = 25
    middle_third_low: int = 11
    middle_third_high: int = 23

    def __post_init__(self):
        if any(n is not None and n < 2 for n in (self.run_length, self.trend_length)):
            raise ValueError("runs and trends have at least 2 points")

    @property
    def reach(self) -> int:
        """How many points before its own a criterion looks at."""
        return max(1, self.run_length or 1, self.trend_length or 1, self.middle_third_window if self.middle_third else 1, 15 if self.fifteen_within_1s else 5) - 1


ALL = RuleSet(True, 7, 7, True, True, True, True)


def rules_from(settings: dict) -> RuleSet:
    """A rule set from settings; an unknown name is an error."""
    try:
        return RuleSet(**settings)
    except TypeError as e:
        raise ValueError(f"unknown rule setting: {e}") from None


def flags(points: DataFrame, rules: RuleSet = ALL) -> DataFrame:
    """points: (series, pos, point, center, lcl, ucl[, sigma][, segment]). Adds a boolean column per enabled criterion.

    `pos` is gapless in its series. sigma is the plotted statistic's standard
    deviation, needed for the last three criteria.
    """
    if "segment" not in points.columns:
        points = points.withColumn("segment", F.lit(0))
    rows = chunked(points, rules.reach)
    order = Window.partitionBy("series", "chunk", "segment").orderBy("pos")
    rows = rows.withColumns(
        {
            "side": F.signum(F.col("point") - F.col("center")).cast("int"),
            "step": F.signum(F.col("point") - F.lag("point").over(order)).cast("int"),
        }
    )

    def count(which: Column, n: int) -> Column:
        return F.coalesce(F.sum(which.cast("int")).over(order.rowsBetween(-(n - 1), 0)), F.lit(0))

    full = lambda n: F.count("*").over(order.rowsBetween(-(n - 1), 0)) == n
    out: dict[str, Column] = {}
    if rules.beyond_limits:
        out["beyond_limits"] = (F.col("point") > F.col("ucl")) | (F.col("point") < F.col("lcl"))
    if rules.run_length:
        n = rules.run_length
        out["run"] = (count(F.col("side") == 1, n) == n) | (count(F.col("side") == -1, n) == n)
    if rules.trend_length:
        n = rules.trend_length - 1  # steps
        out["trend"] = (count(F.col("step") == 1, n) == n) | (count(F.col("step") == -1, n) == n)
    if rules.middle_third:
        w = rules.middle_third_window
        inside = F.abs(F.col("point") - (F.col("ucl") + F.col("lcl")) / 2) <= (F.col("ucl") - F.col("lcl")) / 6
        out["middle_third"] = full(w) & ~count(inside, w).between(rules.middle_third_low, rules.middle_third_high)
    if rules.two_of_three_beyond_2s or rules.four_of_five_beyond_1s or rules.fifteen_within_1s:
        rows = rows.withColumn("z", (F.col("point") - F.col("center")) / F.col("sigma"))
    z = F.col("z")
    if rules.two_of_three_beyond_2s:
        out["two_of_three_beyond_2s"] = full(3) & ((count(z > 2, 3) >= 2) | (count(z < -2, 3) >= 2))
    if rules.four_of_five_beyond_1s:
        out["four_of_five_beyond_1s"] = full(5) & ((count(z > 1, 5) >= 4) | (count(z < -1, 5) >= 4))
    if rules.fifteen_within_1s:
        out["fifteen_within_1s"] = count(F.abs(z) < 1, 15) == 15
    return rows.withColumns(out).filter("own").select(*points.columns, *out)


def violations(points: DataFrame, rules: RuleSet = ALL) -> DataFrame:
    """(series, pos, rule): a row for each criterion that a point completes."""
    flagged = flags(points, rules)
    names = [c for c in flagged.columns if c not in points.columns and c != "segment"]
    each = F.explode(F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in names)), lambda x: x.isNotNull()))
    return flagged.select("series", "pos", each.alias("rule"))
