"""The analytic method for attribute gauges: bias and repeatability from counts of accepts on parts of known size."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the method, for 20 trials of each part: correction of the range, factor and limit of t, least parts in all and between the ends.
TRIALS, RANGE_BIAS, T_FACTOR, T_LIMIT, PARTS, BETWEEN = 20, 1.08, 6.078, 2.093, 8, 6
#: Fixed value: deviations in the span of 0.99.
SPAN = 5.15


def analytic_method(counts: DataFrame, limit: float, side: str = "lower") -> DataFrame:
    """counts: (gauge, reference, accepts), a row per part, accepts of 20 trials. A row per gauge: parts, between_ends, refused, x50, bias, repeatability, t, biased.

    Reference values are regressed on the normal quantiles of the corrected
    shares of accepts; of the parts with none or all accepts only the two next
    to the rest count. At the upper limit acceptance falls, so values are
    negated. A gauge is refused (with the reason, other columns null) for
    counts that are null or beyond 0 to 20, a null gauge's parts included,
    repeated or null references, fewer than 8 parts, ends that are not none and
    all accepts, fewer than 6 parts between, or a line that does not rise.
    No part is held in a task: all is aggregates per gauge and one join with
    them. An empty table gives no rows; further columns are not read.
    """
    if side not in ("lower", "upper"):
        raise ValueError(f"side is lower or upper, not {side}")
    sign = 1.0 if side == "lower" else -1.0
    rows = counts.select("gauge", (sign * F.col("reference").cast("double")).alias("x"), F.col("accepts").cast("long").alias("a"))
    none, every, between = F.col("a") == 0, F.col("a") == TRIALS, F.col("a").between(1, TRIALS - 1)
    facts = rows.groupBy("gauge").agg(
        F.count("*").alias("parts"), F.count_if(between).alias("between_ends"),
        F.max(F.when(none, F.col("x"))).alias("low"), F.min(F.when(every, F.col("x"))).alias("high"),
        F.min_by("a", "x").alias("first"), F.max_by("a", "x").alias("last"),
        F.count_if(F.col("x").isNull() | F.isnan("x") | F.coalesce(~F.col("a").between(0, TRIALS), F.lit(True))).alias("wrong"), F.count_distinct("x").alias("sizes"),
    )
    # z of each possible count: half a trial towards the middle.
    z = [NormalDist().inv_cdf((a + (0.5 if 2 * a < TRIALS else -0.5 if 2 * a > TRIALS else 0.0)) / TRIALS) for a in range(TRIALS + 1)]
    known = rows.join(facts.select(F.col("gauge").alias("own"), "low", "high"), F.col("gauge").eqNullSafe(F.col("own")))
    used = known.filter(between | none & (F.col("x") == F.col("low")) | every & (F.col("x") == F.col("high")))
    used = used.withColumn("z", F.array(*map(F.lit, z))[F.col("a").cast("int")])
    lines = used.groupBy("own").agg(F.regr_slope("x", "z").alias("slope"), F.regr_intercept("x", "z").alias("middle"))
    out = facts.join(lines, F.col("gauge").eqNullSafe(F.col("own")), "left")
    refused = (
        F.when(F.col("wrong") > 0, "counts")
        .when(F.col("sizes") < F.col("parts"), "repeated references")
        .when(F.col("parts") < PARTS, "too few parts")
        .when((F.col("first") != 0) | (F.col("last") != TRIALS), "ends")
        .when(F.col("between_ends") < BETWEEN, "too few between the ends")
        .when(F.coalesce(F.col("slope") <= 0, F.lit(True)), "not rising")
    )
    out = out.withColumn("refused", refused)
    value = lambda c: F.when(F.col("refused").isNull(), c)
    bias = F.lit(sign * limit) - F.col("middle")
    spread = 2 * NormalDist().inv_cdf(0.995) * F.col("slope") / (RANGE_BIAS * SPAN)
    out = out.select("gauge", "parts", "between_ends", "refused", value(sign * F.col("middle")).alias("x50"), value(bias).alias("bias"), value(spread).alias("repeatability"), value(T_FACTOR * F.abs(bias) / spread).alias("t"))
    return out.withColumn("biased", F.col("t") > T_LIMIT)
