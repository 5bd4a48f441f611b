"""Studies of grouped data: states, nested levels, factor combinations, measurement systems, designed experiments.

Every sum of squares comes from counts, sums and means of groups. Critical
values are found on the driver from degrees of freedom, which are counts of
groups, never rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadyline.functions.numeric import chi2_cdf, chi2_ppf, d2, f_ppf, f_sf, grubbs_critical, t_ppf

from .counts import by_count
from .lineage import cut
from .order import medians


# -- States and combinations ---------------------------------------------------


def state_stats(df: DataFrame, *by: str) -> DataFrame:
    """n, mean, sd and var of each state or combination."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("var"))


def bartlett(states: DataFrame) -> DataFrame:
    """states: `state_stats`. Bartlett's statistic for equal variances, its degrees of freedom; states with no variance are left out."""
    s = states.filter("n > 1 and var > 0")
    a = s.agg(
        F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("f"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss"), F.sum((F.col("n") - 1) * F.log("var")).alias("logs"), F.sum(1 / (F.col("n") - 1)).alias("inverse")
    )
    f, k = F.col("f"), F.col("k")
    statistic = (f * F.log(F.col("ss") / f) - F.col("logs")) / (1 + (F.col("inverse") - 1 / f) / (3 * (k - 1)))
    return a.filter("k > 1").select(statistic.alias("statistic"), (k - 1).alias("df"))


def anova(states: DataFrame) -> DataFrame:
    """One-way analysis: between and within sums of squares, degrees of freedom, F and eta squared."""
    a = states.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0)).alias("ss_within")
    )
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    return a.select(between.alias("ss_between"), "ss_within", dfb.alias("df_between"), dfw.alias("df_within"), ((between / dfb) / (F.col("ss_within") / dfw)).alias("f"), (between / (between + F.col("ss_within"))).alias("eta2"))


def judged(test: DataFrame, alpha: float = 0.05) -> DataFrame:
    """`anova` with its critical value and probability: one row, so its two counts come to the driver."""
    row = test.select("df_between", "df_within", "f").first()
    if row is None or row["f"] is None:
        return test.select("*", F.lit(None).cast("double").alias("critical"), F.lit(None).cast("double").alias("p"))
    a, b = row["df_between"], row["df_within"]
    return test.select("*", F.lit(f_ppf(1 - alpha, a, b)).alias("critical"), F.lit(f_sf(row["f"], a, b)).alias("p"))


def state_tests(states: DataFrame) -> DataFrame:
    """Equal variances (Bartlett) and equal means (analysis of variance) of the states of over two values that vary: (test, statistic, df, p), two rows.

    The statistics are one row each, so they come to the driver.
    """
    s = states.filter("n > 2 and var > 0")
    b, a = bartlett(s).first(), anova(s).first()
    rows = [] if b is None else [("variances", b["statistic"], float(b["df"]), 1 - chi2_cdf(b["statistic"], b["df"]))]
    if a is not None and a["f"] is not None:
        rows.append(("means", a["f"], float(a["df_between"]), f_sf(a["f"], a["df_between"], a["df_within"])))
    return states.sparkSession.createDataFrame(rows, "test string, statistic double, df double, p double")


def two_states(states: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Two states by name: variance ratio, pooled t and Welch's t with its degrees of freedom."""
    x = states.filter(F.col(key) == a).select(F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    y = states.filter(F.col(key) == b).select(F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    r = x.join(F.broadcast(y))  # one row each
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    e1, e2 = v1 / n1, v2 / n2
    welch_df = F.pow(e1 + e2, F.lit(2)) / (F.pow(e1, F.lit(2)) / (n1 - 1) + F.pow(e2, F.lit(2)) / (n2 - 1))
    diff = F.col("m1") - F.col("m2")
    return r.select((F.greatest(v1, v2) / F.least(v1, v2)).alias("f"), (diff / F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), (diff / F.sqrt(e1 + e2)).alias("welch_t"), welch_df.alias("welch_df"))


def state_extremes(df: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """The most extreme value of each state with Grubbs' statistic and critical value."""
    s = state_stats(df, key).filter("n > 2 and sd > 0")
    g = df.join(s.select(key, "mean", "sd", "n"), key).groupBy(key).agg(F.max(F.abs(F.col("value") - F.col("mean")) / F.col("sd")).alias("g"), F.first("n").alias("n"))
    return g.withColumn("critical", by_count(F.col("n"), lambda n: grubbs_critical(n, alpha))).withColumn("outlier", F.col("g") > F.col("critical"))


def pooled_capability(states: DataFrame, lsl: float, usl: float) -> DataFrame:
    """Index from the pooled deviation and the extreme state means."""
    a = states.agg((F.sum((F.col("n") - 1) * F.col("var")) / F.sum(F.col("n") - 1)).alias("v"), F.min("mean").alias("low"), F.max("mean").alias("high"))
    s = F.sqrt("v")
    pl, pu = (F.col("low") - lsl) / (3 * s), (usl - F.col("high")) / (3 * s)
    return a.select(s.alias("sigma"), (F.col("high") - F.col("low")).alias("delta_m"), ((usl - lsl - (F.col("high") - F.col("low"))) / (6 * s)).alias("pm"), F.least(pl, pu).alias("pmk"))


def combinations_against_rest(df: DataFrame, *factors: str) -> DataFrame:
    """Each factor combination against all other values: difference, Welch's t and degrees of freedom.

    The rest's count, sum and squares are the totals less the combination's own.
    """
    g = df.groupBy(*factors).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    t = g.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("q").alias("q_all"))
    r = g.join(F.broadcast(t))  # one row
    n, m = F.col("n"), F.col("n_all") - F.col("n")
    mean, rest = F.col("s") / n, (F.col("s_all") - F.col("s")) / m
    v = (F.col("q") - n * mean * mean) / (n - 1)
    w = (F.col("q_all") - F.col("q") - m * rest * rest) / (m - 1)
    e1, e2 = v / n, w / m
    df_ = F.pow(e1 + e2, F.lit(2)) / (F.pow(e1, F.lit(2)) / (n - 1) + F.pow(e2, F.lit(2)) / (m - 1))
    return r.filter("n > 1 and n_all - n > 1").select(*factors, "n", mean.alias("mean"), F.sqrt(v).alias("sd"), (mean - rest).alias("difference"), ((mean - rest) / F.sqrt(e1 + e2)).alias("t"), df_.alias("df"))


def missing_combinations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of two factors' levels that no row has: levels are few by nature."""
    seen = df.select(a, b).distinct()
    every = seen.select(a).distinct().join(F.broadcast(seen.select(b).distinct()))
    return every.join(seen, [a, b], "left_anti")


def brown_forsythe(df: DataFrame, *factors: str) -> DataFrame:
    """Analysis of the distances to each combination's median."""
    middle = medians(df, *factors).withColumnRenamed("median", "middle")
    return anova(state_stats(df.join(middle, list(factors)).withColumn("value", F.abs(F.col("value") - F.col("middle"))), *factors))


def nested_anova(df: DataFrame, *levels: str) -> DataFrame:
    """Nested random effects, coarse levels first: one row per level and one for the error, with sum of squares, degrees of freedom, mean square and variance.

    Unequal group sizes are allowed: each mean square's expectation has the
    coefficients that group sizes give, and variances are solved from below,
    negative ones set to 0. One pass over the rows, and one job over the finest
    groups' sums. An empty table gives no rows.
    """
    k = len(levels)
    # Values about the grand mean, so that no two large squares are subtracted.
    grand = df.agg(F.avg("value")).first()[0] or 0.0
    x = F.col("value") - grand
    finest = cut(df.groupBy(*levels).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")))
    at = [finest.groupBy(*levels[:i]).agg(F.sum("n").alias("n"), F.sum("s").alias("s")) for i in range(k + 1)]
    facts = [g.select(F.lit("t").alias("what"), F.lit(i).alias("i"), F.lit(0).alias("j"), (F.col("s") * F.col("s") / F.col("n")).alias("value")) for i, g in enumerate(at)]
    # Of each group at a coarse level, the squared sizes of the groups inside it, over its own size.
    for i in range(k):
        for j in range(i + 1, k + 1):
            inside = at[j].groupBy(*levels[:i]).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("value"))
            facts.append(inside.select(F.lit("q").alias("what"), F.lit(i).alias("i"), F.lit(j).alias("j"), "value"))
    facts.append(finest.select(F.lit("all").alias("what"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("q").alias("value")))
    facts.append(finest.select(F.lit("n").alias("what"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("n").cast("double").alias("value")))
    found = {(r["what"], r["i"], r["j"]): (r["sum"], r["rows"]) for r in reduce(DataFrame.union, facts).groupBy("what", "i", "j").agg(F.sum("value").alias("sum"), F.count("*").alias("rows")).collect()}
    if ("t", k, 0) not in found:
        return df.sparkSession.createDataFrame([], "level string, ss double, df long, ms double, variance double")
    T, counts = [found["t", i, 0][0] for i in range(k + 1)], [found["t", i, 0][1] for i in range(k + 1)]
    total = found["all", 0, 0][0], int(found["n", 0, 0][0])
    Q = [[float(total[1]) if j <= i else found["q", i, j][0] for j in range(1, k + 1)] for i in range(k + 1)]
    ss = [T[i] - T[i - 1] for i in range(1, k + 1)] + [total[0] - T[k]]
    dof = [counts[i] - counts[i - 1] for i in range(1, k + 1)] + [total[1] - counts[k]]
    ms = [s / d if d else float("nan") for s, d in zip(ss, dof, strict=True)]
    variance = [0.0] * (k + 1)
    variance[k] = ms[k]
    for i in range(k, 0, -1):
        coefficient = [(Q[i][j] - Q[i - 1][j]) / dof[i - 1] for j in range(k)]
        below = variance[k] + sum(coefficient[j] * variance[j] for j in range(i, k))
        variance[i - 1] = max(0.0, (ms[i - 1] - below) / coefficient[i - 1])
    rows = [(name, float(s), int(d), float(m), float(v)) for name, s, d, m, v in zip((*levels, "error"), ss, dof, ms, variance, strict=True)]
    return df.sparkSession.createDataFrame(rows, "level string, ss double, df long, ms double, variance double")


# -- Measurement systems -------------------------------------------------------


def gauge_type1(df: DataFrame, reference: float, tolerance: float, spread: float = 4.0) -> DataFrame:
    """Cg and Cgk per series, bias and its t value."""
    s = df.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s"))
    bias = F.col("mean") - reference
    cg, cgk = 0.2 * tolerance / (spread * F.col("s")), (0.1 * tolerance - F.abs(bias)) / (spread / 2 * F.col("s"))
    return s.select("series", "n", "mean", "s", bias.alias("bias"), cg.alias("cg"), cgk.alias("cgk"), (bias / (F.col("s") / F.sqrt("n"))).alias("t"))


def crossed_grr(df: DataFrame, part: str, operator: str) -> DataFrame:
    """Crossed study: sums of squares of parts, operators, interaction and repeats, in one pass of grouping sets over the cells.

    Balanced cells are meant; with unequal ones the cells' means count alike. One
    row: counts, the four sums and mean squares, and the variance components with
    the interaction kept.
    """
    cells = df.groupBy(part, operator).agg(F.count("*").alias("r"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    sets = cells.groupingSets([[part], [operator], []], part, operator).agg(F.avg("m").alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("gid"), F.avg("r").alias("r"), F.sum((F.col("r") - 1) * F.col("v")).alias("sse"), F.sum("r").alias("rows"))
    of = lambda g, c: F.when(F.col("gid") == g, F.col(c))
    a = sets.agg(
        F.count(of(1, "mean")).alias("p"), F.count(of(2, "mean")).alias("o"), F.max(of(3, "mean")).alias("grand"), F.max(of(3, "r")).alias("r"), F.max(of(3, "sse")).alias("ss_repeat"), F.max(of(3, "rows")).alias("rows"), F.var_pop(of(1, "mean")).alias("vp"), F.var_pop(of(2, "mean")).alias("vo")
    )
    all_cells = cells.agg(F.var_pop("m").alias("vc"), F.count("*").alias("cells"))
    x = a.join(F.broadcast(all_cells))  # one row each
    p, o, r = F.col("p"), F.col("o"), F.col("r")
    ss_p, ss_o = F.col("vp") * p * o * r, F.col("vo") * p * o * r
    ss_i = F.col("vc") * F.col("cells") * r - ss_p - ss_o
    ms_p, ms_o, ms_i = ss_p / (p - 1), ss_o / (o - 1), ss_i / ((p - 1) * (o - 1))
    ms_e = F.col("ss_repeat") / (F.col("rows") - F.col("cells"))
    zero = F.lit(0.0)
    inter = F.greatest(zero, (ms_i - ms_e) / r)
    return x.select(
        p.alias("parts"), o.alias("operators"), ss_p.alias("ss_part"), ss_o.alias("ss_operator"), ss_i.alias("ss_interaction"), F.col("ss_repeat"), ms_e.alias("var_repeat"), inter.alias("var_interaction"), F.greatest(zero, (ms_o - ms_i) / (p * r)).alias("var_operator"), F.greatest(zero, (ms_p - ms_i) / (o * r)).alias("var_part")
    )


def pooled_sd_grr(df: DataFrame, part: str, operator: str) -> DataFrame:
    """Per operator: pooled repeat deviation and mean, with the consistency ratios k (deviation over the pooled one of all) and h (distance of the mean in deviations of operator means)."""
    cells = df.groupBy(part, operator).agg(F.var_samp("value").alias("v"), F.avg("value").alias("m"))
    ops = cells.groupBy(operator).agg(F.sqrt(F.avg("v")).alias("sd"), F.avg("m").alias("mean"))
    allv = ops.agg(F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("pooled"), F.avg("mean").alias("grand"), F.stddev_samp("mean").alias("between"))
    return ops.join(F.broadcast(allv)).select(operator, "sd", "mean", (F.col("sd") / F.col("pooled")).alias("k"), ((F.col("mean") - F.col("grand")) / F.col("between")).alias("h"))


def range_method(df: DataFrame, part: str, a: str, b: str) -> DataFrame:
    """Two appraisers' one reading per part: mean range and the deviation from it. df has the columns a and b."""
    r = df.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("r_bar"), F.count("*").alias("parts"))
    return r.select("parts", "r_bar", (F.col("r_bar") / d2(2)).alias("sigma"))


def linearity(df: DataFrame, reference: str, value: str) -> DataFrame:
    """Bias regressed on the reference: slope, intercept, r2, residual deviation, and the standard errors' t values."""
    rows = df.select(F.col(reference).cast("double").alias("x"), (F.col(value) - F.col(reference)).cast("double").alias("y"))
    a = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"), F.avg("x").alias("xm"))
    s = F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    return a.select("n", "slope", "intercept", "r2", s.alias("s"), (F.col("slope") / (s / F.sqrt("sxx"))).alias("t_slope"), (F.col("intercept") / (s * F.sqrt(1 / F.col("n") + F.col("xm") * F.col("xm") / F.col("sxx")))).alias("t_intercept"))


def lack_of_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line through repeated readings: pure error, lack of fit and its F ratio."""
    g = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"))
    pure = g.agg(F.sum((F.col("n") - 1) * F.col("v")).alias("ss_pure"), F.sum(F.col("n") - 1).alias("df_pure"), (F.count("*") - 2).alias("df_lack"))
    line = df.agg((F.regr_syy(F.col(y).cast("double"), F.col(x).cast("double")) - F.pow(F.regr_sxy(F.col(y).cast("double"), F.col(x).cast("double")), F.lit(2)) / F.regr_sxx(F.col(y).cast("double"), F.col(x).cast("double"))).alias("ss_residual"))
    r = pure.join(F.broadcast(line))
    lack = F.col("ss_residual") - F.col("ss_pure")
    return r.select("ss_residual", "ss_pure", lack.alias("ss_lack"), "df_pure", "df_lack", ((lack / F.col("df_lack")) / (F.col("ss_pure") / F.col("df_pure"))).alias("f"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters' 0/1 judgements of the same items; null where chance agreement is sure."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.filter(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.col("po").alias("agreement"), pe.alias("by_chance"), F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, category: str) -> DataFrame:
    """df: a row per judgement. Items must have as many judgements each; kappa over all categories."""
    cells = df.groupBy(item, category).agg(F.count("*").alias("votes"))
    items = cells.groupBy(item).agg(F.sum("votes").alias("m"), F.sum(F.col("votes") * F.col("votes")).alias("q"))
    agree = items.agg(F.count("*").alias("items"), F.avg((F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("all"))
    shares = cells.groupBy(category).agg(F.sum("votes").alias("votes")).agg(F.sum(F.col("votes").cast("double") * F.col("votes")).alias("q"))
    r = agree.join(F.broadcast(shares))
    pe = F.col("q") / (F.col("all") * F.col("all").cast("double"))
    return r.select("items", "po", pe.alias("pe"), ((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def attribute_agreement(df: DataFrame, appraiser: str, part: str, decision: str, reference: str) -> DataFrame:
    """Per appraiser: parts judged alike in all trials, and alike as well as right; misses and false alarms over single judgements (0 is a reject)."""
    per = df.groupBy(appraiser, part).agg(F.min(decision).alias("lo"), F.max(decision).alias("hi"), F.max(reference).alias("ref"), F.count("*").alias("trials"), F.sum(F.when((F.col(decision) == 1) & (F.col(reference) == 0), 1).otherwise(0)).alias("miss"), F.sum(F.when((F.col(decision) == 0) & (F.col(reference) == 1), 1).otherwise(0)).alias("false"))
    alike = (F.col("lo") == F.col("hi")).cast("double")
    right = ((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("ref"))).cast("double")
    return per.groupBy(appraiser).agg(
        F.count("*").alias("parts"), F.avg(alike).alias("within"), F.avg(right).alias("effectiveness"), (F.sum("miss") / F.sum(F.when(F.col("ref") == 0, F.col("trials")))).alias("miss_rate"), (F.sum("false") / F.sum(F.when(F.col("ref") == 1, F.col("trials")))).alias("false_alarm_rate")
    )


def bowker(df: DataFrame, part: str, a: str, b: str) -> DataFrame:
    """Symmetry of two operators' classes over the same parts: statistic and degrees of freedom."""
    t = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n")).filter("x != y")
    pairs = t.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.sum(F.when(F.col("x") < F.col("y"), F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(F.col("x") > F.col("y"), F.col("n")).otherwise(0)).alias("down"))
    return pairs.agg(F.coalesce(F.sum(F.pow(F.col("up") - F.col("down"), F.lit(2)) / (F.col("up") + F.col("down"))), F.lit(0.0)).alias("statistic"), F.count("*").alias("df"))


def signal_detection(df: DataFrame, part: str, reference: str, accepted: str) -> DataFrame:
    """Grey zone between parts that all judgements reject and those that all accept: width from the last sure reject to the first sure accept above it."""
    per = df.groupBy(part).agg(F.max(reference).alias("ref"), F.min(accepted).alias("lo"), F.max(accepted).alias("hi"))
    return per.agg(F.max(F.when(F.col("hi") == 0, F.col("ref"))).alias("last_reject"), F.min(F.when(F.col("lo") == 1, F.col("ref"))).alias("first_accept"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("grey_parts"))


def gate(studies: DataFrame, today: str) -> DataFrame:
    """studies: (system, kind, id, date, verdict, months, voided). pass, conditional or block from each kind's latest valid study."""
    last = studies.filter(~F.col("voided")).groupBy("system", "kind").agg(F.max_by(F.struct("date", "verdict", "months"), F.struct("date", "id")).alias("s"))
    state = F.when(F.add_months("s.date", F.col("s.months")) < F.lit(today).cast("date"), "block").otherwise(F.col("s.verdict"))
    each = last.select("system", state.alias("state"))
    return each.groupBy("system").agg(F.when(F.max((F.col("state") == "block").cast("int")) == 1, "block").when(F.max((F.col("state") == "conditional").cast("int")) == 1, "conditional").otherwise("pass").alias("gate"))


# -- Designed experiments ------------------------------------------------------


def cross_products(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y (constant first), y'y and n, in one aggregate."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    target = F.col(y).cast("double")
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(cols[i] * cols[j]) for i, j in pairs), *(F.sum(c * target) for c in cols), F.sum(target * target), F.count("*")).first()
    xtx = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=False):
        xtx[i, j] = xtx[j, i] = v
    return xtx, np.array(row[len(pairs) : len(pairs) + k]), row[-2], row[-1]


def regression(df: DataFrame, y: str, xs: list[str], alpha: float = 0.05) -> DataFrame:
    """Least squares: a row per term with estimate, standard error, t, confidence limits and variance inflation."""
    xtx, xty, yty, n = cross_products(df, y, xs)
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    dof = n - len(beta)
    s2 = (yty - beta @ xty) / dof
    se = np.sqrt(s2 * np.diag(inverse))
    t = t_ppf(1 - alpha / 2, dof)
    centred = np.diag(xtx) - xtx[0] ** 2 / n
    rows = [(name, float(b), float(e), float(b / e), float(b - t * e), float(b + t * e), None if not i else float(inverse[i, i] * centred[i])) for i, (name, b, e) in enumerate(zip(["constant", *xs], beta, se, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, t double, low double, high double, vif double")


def factorial_effects(df: DataFrame, y: str, factors: list[str], max_order: int | None = None) -> DataFrame:
    """Effects of a two-level design (factors of -1 and 1): mean at high less mean at low for each product of factors, in one aggregate."""
    terms = [c for r in range(1, (max_order or len(factors)) + 1) for c in combinations(factors, r)]

    def sign(term: tuple[str, ...]) -> Column:
        out = F.col(term[0])
        for x in term[1:]:
            out = out * F.col(x)
        return out

    wide = df.agg(*((F.avg(F.when(sign(t) > 0, F.col(y))) - F.avg(F.when(sign(t) < 0, F.col(y)))).alias(":".join(t)) for t in terms))
    return wide.unpivot([], [f"`{':'.join(t)}`" for t in terms], "term", "effect").select(F.translate("term", "`", "").alias("term"), "effect")


def lenth(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Lenth's pseudo standard error and margin; effects are few by nature."""
    first = effects.agg((1.5 * F.median(F.abs("effect"))).alias("s0"), F.count("*").alias("m"))
    m = first.first()["m"]
    kept = effects.join(F.broadcast(first)).filter(F.abs("effect") < 2.5 * F.col("s0")).agg((1.5 * F.median(F.abs("effect"))).alias("pse"))
    return kept.select("pse", (t_ppf(1 - alpha / 2, m / 3) * F.col("pse")).alias("margin"))


def bartlett_critical(df: int, alpha: float = 0.05) -> float:
    return chi2_ppf(1 - alpha, df)
