"""Health check of existing charts: facts per characteristic, and findings in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, f_ppf, upper_u

from .counts import by_count
from .estimators import best_split
from .measurements import longest_run, resolution

#: Severities from the worst.
SEVERITIES = ("high", "medium", "low", "info")


def facts(df: DataFrame, groups: DataFrame, n: int, limits: DataFrame) -> DataFrame:
    """One row per series. groups: whole subgroups of n. limits: (series, lsl, usl, lcl, ucl) as in use, each may be null."""
    overall = df.groupBy("series").agg(F.count("*").alias("n_values"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd_total"))
    inner = groups.groupBy("series").agg(F.count("*").alias("k"), F.avg("mean").alias("centre"), F.sqrt(F.avg("var")).alias("sigma_in"), F.var_samp("mean").alias("var_means"))
    split = best_split(groups, 5)
    used = groups.join(limits.select("series", "lcl", "ucl"), "series").groupBy("series").agg(F.count_if((F.col("mean") < F.col("lcl")) | (F.col("mean") > F.col("ucl"))).alias("used_alarms"))
    rows = overall.join(inner, "series").join(split, "series", "left").join(resolution(df), "series", "left").join(longest_run(df), "series").join(limits, "series", "left").join(used, "series", "left")
    half = upper_u(ALPHA) * F.col("sigma_in") / n**0.5
    rows = rows.withColumns({"ratio": F.sqrt("var_means") * n**0.5 / F.col("sigma_in"), "ref_lcl": F.col("centre") - half, "ref_ucl": F.col("centre") + half})
    # F of the analysis of variance is the ratio squared. After the split's levels are taken out, their sum of squares leaves the means'.
    rest = F.greatest(F.lit(0.0), F.col("var_means") * (F.col("k") - 1) - F.col("score")) / (F.col("k") - 1)
    rows = rows.withColumn("ratio_split", F.sqrt(rest) * n**0.5 / F.col("sigma_in"))
    return rows.withColumn("f_critical", by_count(F.col("k"), lambda k: f_ppf(0.999, k - 1, k * (n - 1)) if k > 1 else None))


def findings(rows: DataFrame, min_subgroups: int = 20) -> DataFrame:
    """(series, code, severity, place): what `facts` shows, the worst first."""
    c = F.col
    tolerance = c("usl") - c("lsl")
    coarse = c("resolution") / c("sd_total") > 1
    enough = c("k") >= min_subgroups
    between_all = enough & (c("ratio") >= 1.5) & (c("ratio") * c("ratio") > c("f_critical"))
    still = (c("ratio_split") >= 1.5) & (c("ratio_split") * c("ratio_split") > c("f_critical"))
    shift, between = between_all & ~still, between_all & still
    limits = c("lcl").isNotNull() & c("ucl").isNotNull()
    width = (c("ucl") - c("lcl")) / (c("ref_ucl") - c("ref_lcl"))
    off = F.abs((c("lcl") + c("ucl")) / 2 - c("centre")) / ((c("ref_ucl") - c("centre")) / upper_u(ALPHA))
    copied = F.coalesce((F.abs(c("ucl") - c("usl")) <= 0.02 * tolerance) & (F.abs(c("lcl") - c("lsl")) <= 0.02 * tolerance), F.lit(False))
    narrow = limits & enough & (width <= 0.67) & ~between
    share = c("used_alarms") / c("k")
    pk = F.least((c("mean") - c("lsl")) / (3 * c("sd_total")), (c("usl") - c("mean")) / (3 * c("sd_total")))
    unsteady = between | shift
    checks: list[tuple[str, Column | str, Column]] = [
        ("resolution_vs_tolerance", "high", c("resolution") / tolerance > 0.05),
        ("resolution_vs_variation", "medium", coarse),
        ("repeated_values", "medium", (c("longest") >= 8) & ~F.coalesce(coarse, F.lit(False))),
        ("level_shift", "medium", shift),
        ("between_subgroups", F.when(share >= 0.05, "high").otherwise("medium"), between),
        ("too_few_data", "info", ~enough),
        ("limits_are_spec", "high", limits & copied),
        ("limits_too_wide", F.when(width >= 2, "high").otherwise("medium"), limits & enough & ~copied & (width >= 1.5)),
        ("limits_too_narrow", "medium", narrow),
        ("limits_off_centre", "medium", limits & enough & ~copied & (off >= 1.5)),
        ("too_many_alarms", "high", limits & (share >= 0.05) & ~unsteady & ~narrow),
        ("limits_incomplete", "low", c("lcl").isNull() != c("ucl").isNull()),
        ("no_limits_in_file", "info", c("lcl").isNull() & c("ucl").isNull()),
        ("index_from_unstable_process", "medium", enough & unsteady & pk.isNotNull()),
        ("capability_poor", "high", enough & (pk < 1.0)),
        ("capability_below_target", "medium", enough & (pk >= 1.0) & (pk < 1.33)),
        ("no_specification", "info", c("lsl").isNull() & c("usl").isNull()),
    ]
    each = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"), F.lit(i).alias("place"))) for i, (code, sev, when) in enumerate(checks)))
    found = rows.select("series", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"))
    return found.select("series", "f.code", "f.severity", "f.place")


def health_summary(found: DataFrame) -> DataFrame:
    """Findings per severity, and characteristics with any."""
    return found.groupBy("severity").agg(F.count("*").alias("findings"), F.count_distinct("series").alias("series"))
