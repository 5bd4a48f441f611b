"""Whole verdicts: gauge studies, agreement of appraisers, streams measured together, samples and their checks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from steadyline.functions.numeric import f_sf, sidak, upper_u

from .measurements import chunked, within_chunk
from .sequential import vector_moments

#: Fixed value: an interaction less sure than this is pooled with the repeats.
POOLED_ABOVE = 0.25
#: Quantiles that span 99.73 % of a distribution, in deviations of a normal one.
SPAN = upper_u(0.0027)
#: Fixed value: distances beyond this cannot be told from it.
FARTHEST = 37.0


# -- Measurement systems -----------------------------------------------------------


def gauge_verdict(df: DataFrame, part: str, operator: str, tolerance: float | None = None, passes: float = 10.0, conditional: float = 30.0, classes: float = 5.0) -> DataFrame:
    """Crossed study with its verdict, one row.

    Cells of unequal size count by their means, with the harmonic mean of the
    sizes for the number of trials (the method of unweighted means); with equal
    sizes this is the usual analysis. An interaction whose probability is over
    0.25 is pooled with the repeats. Fewer than 5 parts, 2 operators or 2 trials,
    an empty cell, and repeats that do not vary are refused.
    """
    cells = df.groupBy(part, operator).agg(F.count("*").alias("r"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    parts, operators = (cells.groupBy(c).agg(F.avg("m").alias("m")).agg(F.var_pop("m").alias(f"v_{name}"), F.count("*").alias(name)) for c, name in ((part, "p"), (operator, "o")))
    whole = cells.agg(F.var_pop("m").alias("v_cell"), F.count("*").alias("cells"), F.min("r").alias("least"), (F.count("*") / F.sum(1 / F.col("r"))).alias("r"), F.sum("r").alias("rows"), F.sum((F.col("r") - 1) * F.col("v")).alias("sse"))
    x = whole.join(F.broadcast(parts)).join(F.broadcast(operators)).first()  # one row each
    p, o, r = x["p"], x["o"], x["r"]
    if p < 5 or o < 2 or not x["least"] or x["least"] < 2 or x["cells"] < p * o:
        raise ValueError("a crossed study needs 5 parts, 2 operators and 2 trials in every cell at least")
    # Layers of the study: sum of squares, degrees of freedom, readings behind one of its levels.
    layers = {
        "part": (x["v_p"] * p * o * r, p - 1, o * r),
        "operator": (x["v_o"] * p * o * r, o - 1, p * r),
        "interaction": (max(0.0, (x["v_cell"] - x["v_p"] - x["v_o"]) * p * o * r), (p - 1) * (o - 1), r),
        "repeat": (x["sse"], x["rows"] - x["cells"], 1),
    }
    squares = {name: ss / df for name, (ss, df, _) in layers.items()}
    if not squares["repeat"] > 0:
        raise ValueError("all trials of every cell agree, so their spread cannot be told")
    chance = f_sf(squares["interaction"] / squares["repeat"], layers["interaction"][1], layers["repeat"][1])
    pooled = chance > POOLED_ABOVE
    # What lies under parts and operators: the interaction, or with it pooled, all that is left.
    joint = (layers["interaction"][0] + layers["repeat"][0]) / (layers["interaction"][1] + layers["repeat"][1])
    under = joint if pooled else squares["interaction"]
    excess = lambda name, floor: max(0.0, (squares[name] - floor) / layers[name][2])
    gauge = [joint if pooled else squares["repeat"], excess("operator", under), 0.0 if pooled else excess("interaction", squares["repeat"])]
    products = excess("part", under)
    spreads = np.sqrt([*gauge, sum(gauge), products, sum(gauge) + products])
    own, made, total = map(float, spreads[3:])
    shares = [100 * own / total, None if tolerance is None else 600 * own / tolerance]
    told_apart = 1.41 * made / own
    # Each criterion names a grade; the worst counts.
    grade = max(sum((shares[0] if tolerance is None else shares[1]) > limit for limit in (passes, conditional)), sum(told_apart < limit for limit in (2, classes)))
    row = (p, o, float(r), pooled, chance, *squares.values(), *map(float, spreads), *shares, told_apart, ("pass", "conditional", "fail")[grade])
    names = "parts long, operators long, trials double, pooled boolean, interaction_p double, ms_parts double, ms_operators double, ms_interaction double, ms_error double"
    return df.sparkSession.createDataFrame([row], f"{names}, ev double, av double, interaction double, grr double, pv double, tv double, pct_tv double, pct_tol double, ndc double, verdict string")


def appraiser_kappas(df: DataFrame, good: float = 0.75, fair: float = 0.4) -> DataFrame:
    """df: (appraiser, part, trial, decision 0/1, reference 0/1). Kappa of every pair of appraisers, and of each with the reference.

    The decisions of a part and trial stand beside each other, one per appraiser,
    so a pair costs a column and no join. Null where chance alone would agree.
    """
    names = [r[0] for r in df.select("appraiser").distinct().orderBy("appraiser").collect()]  # appraisers, not decisions
    wide = df.groupBy("part", "trial").agg(F.max("reference").alias("reference"), *(F.max(F.when(F.col("appraiser") == a, F.col("decision"))).alias(f"a{i}") for i, a in enumerate(names)))
    pairs = [(f"a{i}", f"a{j}", names[i], names[j]) for i, j in combinations(range(len(names)), 2)] + [(f"a{i}", "reference", a, "reference") for i, a in enumerate(names)]
    every = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y, a, b in pairs))).alias("e")
    s = wide.select(every).select("e.*").filter("x is not null and y is not null").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"), F.avg("x").alias("px"), F.avg("y").alias("py"))
    chance = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    kappa = F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance))
    return s.select("a", "b", "n", "agreement", kappa.alias("kappa"), F.when(kappa >= good, "pass").when(kappa >= fair, "conditional").otherwise("fail").alias("grade"))


def gate_of_required(studies: DataFrame, systems: DataFrame, required: Sequence[str], waivers: DataFrame, today: str) -> DataFrame:
    """(system, gate, missing, waived): pass, conditional or block from the latest valid study of every required kind.

    studies: (system, kind, id, date, verdict, months, voided). waivers: (system,
    kind, until). A kind without a study, failed or out of date blocks the
    system, unless a waiver that still holds makes it conditional. A system
    without any study is there too.
    """
    day = F.lit(today).cast("date")
    last = studies.filter(~F.col("voided")).groupBy("system", "kind").agg(F.max_by(F.struct("date", "verdict", "months"), F.struct("date", "id")).alias("s"))
    allowed = waivers.groupBy("system", "kind").agg(F.max("until").alias("until"))
    each = systems.select("system").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, required)))).join(last, ["system", "kind"], "left").join(allowed, ["system", "kind"], "left")
    state = F.when(F.col("s").isNull() | (F.add_months("s.date", F.col("s.months")) < day), "block").otherwise(F.col("s.verdict"))
    state = F.when((state == "block") & (F.col("until") >= day), "waived").otherwise(state)
    each = each.select("system", F.col("s").isNull().alias("missing"), state.alias("state"))
    some = lambda *of: F.max(F.col("state").isin(*of).cast("int")) == 1
    gate = F.when(some("block"), "block").when(some("waived", "conditional"), "conditional").otherwise("pass")
    return each.groupBy("system").agg(gate.alias("gate"), F.count_if("missing").alias("missing"), F.count_if(F.col("state") == "waived").alias("waived"))


def repeated_standards(df: DataFrame) -> DataFrame:
    """df: (standard, reference, value). One row: repeatability from the mean variance, and the largest deviation of a standard's mean as the bias.

    u_bi is the bias over the root of 3; variances differ where the largest is over four times the smallest.
    """
    s = df.groupBy("standard").agg(F.max("reference").alias("reference"), F.count("*").alias("n"), (F.avg("value") - F.max("reference")).alias("off"), F.var_samp("value").alias("v"))
    worst = F.max_by(F.struct("off", "reference"), F.struct(F.abs("off"), -F.col("standard").cast("double")))
    a = s.agg(F.count("*").alias("standards"), F.sum("n").alias("n"), F.sqrt(F.avg("v")).alias("u_evr"), worst.alias("w"), (F.max("v") > 4 * F.min("v")).alias("variances_differ"))
    return a.select("standards", "n", "u_evr", F.col("w.off").alias("bias"), F.col("w.reference").alias("bias_standard"), (F.abs("w.off") / math.sqrt(3)).alias("u_bi"), "variances_differ")


# -- Streams measured together ---------------------------------------------------------


def multistream_points(df: DataFrame, time: str, stream: str, limits: DataFrame, offsets: DataFrame, alpha: float = 0.0027) -> DataFrame:
    """A row per time at which every stream was measured: mean over the streams, the largest score of a stream, and their alarms.

    limits: one row (k, mu, sigma_within, sigma_time), as `stream_anova` gives.
    offsets: (stream, offset), which add up to zero. A stream's score is its
    distance from the time's mean and its offset, in deviations; its limit is
    Šidák's for k streams.
    """
    row = limits.first()  # one row
    k, mu, within, between = row["k"], row["mu"], row["sigma_within"], row["sigma_time"]
    half, h, sd = upper_u(alpha) * math.sqrt(within**2 / k + between**2), sidak(alpha, k), within * math.sqrt((k - 1) / k)
    cells = df.groupBy(time, stream).agg(F.avg("value").alias("value")).join(offsets, stream)
    times = cells.groupBy(time).agg(F.avg("value").alias("mean"), F.count("*").alias("streams")).filter(F.col("streams") == k)
    scored = cells.join(times, time).withColumn("z", (F.col("value") - F.col("mean") - F.col("offset")) / sd)
    top = scored.groupBy(time, "mean").agg(F.max(F.abs("z")).alias("top"), F.max_by(F.col(stream), F.struct(F.abs("z"), F.col(stream))).alias("stream"))
    return top.select(time, "mean", "top", "stream", (F.abs(F.col("mean") - mu) > half).alias("level_alarm"), (F.col("top") > h).alias("stream_alarm"))


# -- Samples ---------------------------------------------------------------------------

PAIRS, COUNTS, SUBGROUPS = ("p", "u"), ("p", "np", "c", "u"), ("xbar-s", "xbar-r", "median-r")


def sample_check(kind: Column, n: Column, values: Column) -> Column:
    """Null for a sample that fits its monitor, else `wrong_value_count` or `bad_count`. n: the monitor's sample size; values: an array of doubles."""
    need = F.when(kind.isin(*PAIRS), 2).when(kind.isin(*SUBGROUPS), n).otherwise(1)
    sound = F.coalesce((F.size(values) == need) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    count, size = values[0], F.try_element_at(values, F.lit(2))
    bad = (count < 0) | (count != F.floor(count)) | kind.isin(*PAIRS) & (size <= 0) | (kind == "p") & ((size != F.floor(size)) | (count > size)) | (kind == "np") & (count > n)
    return F.when(~sound, "wrong_value_count").when(kind.isin(*COUNTS) & F.coalesce(bad, F.lit(False)), "bad_count")


def sample_statistics(df: DataFrame) -> DataFrame:
    """df: (kind, n, values, previous, ...). Adds `problem`, and for sound samples `location` and `variation`.

    Counts plot the count or the share and have no variation; single values plot
    the range to `previous`, the valid value before them, where there is one.
    """
    kind, v = F.col("kind"), F.col("values")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.size(v)
    squares = F.aggregate(F.transform(v, lambda x: F.pow(x - mean, F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    ordered = F.array_sort(v)
    half = F.floor((F.size(v) - 1) / 2).cast("int")
    median = (F.get(ordered, half) + F.get(ordered, F.size(v) - 1 - half)) / 2
    spread = F.array_max(v) - F.array_min(v)
    location = F.when(kind.isin(*PAIRS), v[0] / F.try_element_at(v, F.lit(2))).when(kind == "median-r", median).when(kind.isin(*SUBGROUPS), mean).otherwise(v[0])
    variation = F.when(kind == "imr", F.abs(v[0] - F.col("previous"))).when(kind == "xbar-s", F.sqrt(squares / (F.size(v) - 1))).when(kind.isin("xbar-r", "median-r"), spread)
    df = df.withColumn("problem", sample_check(kind, F.col("n"), v))
    return df.withColumns({"location": F.when(F.col("problem").isNull(), location), "variation": F.when(F.col("problem").isNull(), variation)})


def first_articles(lots: DataFrame, approvals: DataFrame) -> DataFrame:
    """lots: (series, pos, lot), a row where a lot begins. approvals: (series, pos). (series, pos, lot, approved_at, state): `released` by the first approval before the next lot begins, else `pending` for the latest lot and `missed` for others.

    Lots and approvals meet as one ordered list of events, so no pairs arise.
    """
    events = lots.select("series", "pos", "lot", F.lit(0).alias("kind")).unionByName(approvals.select("series", "pos", F.lit(None).cast("string").alias("lot"), F.lit(1).alias("kind")))
    upto = Window.partitionBy("series").orderBy("pos", "kind")
    events = events.withColumn("nth", F.sum((F.col("kind") == 0).cast("int")).over(upto)).filter("nth > 0")
    each = events.groupBy("series", "nth").agg(F.min(F.when(F.col("kind") == 0, F.col("pos"))).alias("pos"), F.max("lot").alias("lot"), F.min(F.when(F.col("kind") == 1, F.col("pos"))).alias("approved_at"))
    latest = F.col("nth") == F.max("nth").over(Window.partitionBy("series"))
    return each.select("series", "pos", "lot", "approved_at", F.when(F.col("approved_at").isNotNull(), "released").when(latest, "pending").otherwise("missed").alias("state"))


def after_improvement(points: DataFrame, changes: DataFrame, lsl: float, usl: float, target: float, least: int = 25) -> DataFrame:
    """points: (series, pos, value, alarm). changes: (series, after_pos). Pp and Ppk of what came after the change, alarms, and whether the target is met.

    Under `least` points the state is `too_few`; with alarms it is `unstable`.
    """
    s = points.join(changes, "series").filter("pos > after_pos").groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if("alarm").alias("alarms"))
    p, pk = (usl - lsl) / (6 * F.col("sd")), F.least((F.col("mean") - lsl) / (3 * F.col("sd")), (usl - F.col("mean")) / (3 * F.col("sd")))
    state = F.when(F.col("n") < least, "too_few").when(F.col("alarms") > 0, "unstable").when(pk >= target, "met").otherwise("not_met")
    return s.select("series", "n", p.alias("pp"), pk.alias("ppk"), "alarms", state.alias("state"))


# -- Characteristics of another system ---------------------------------------------------


def wide_series(df: DataFrame, characteristic: str, line: str, values: Sequence[str]) -> DataFrame:
    """Rows with several value columns as long form: (characteristic, line, subgroup, j, value); a row is a subgroup, empty cells are left out."""
    each = F.posexplode(F.array(*(F.col(c).cast("double") for c in values))).alias("j", "value")
    return df.select(F.col(characteristic).alias("characteristic"), F.col(line).alias("line"), F.concat(F.lit("row "), F.col(line).cast("string")).alias("subgroup"), each).filter("value is not null and not isnan(value)")


def series_facts(df: DataFrame, characteristic: str, line: str, values: Sequence[str], limits: Mapping[str, str]) -> DataFrame:
    """Per characteristic: rows, values, rows skipped for want of any, and for each limit column its last value and how many different ones it had."""
    filled = sum((F.col(c).isNotNull().cast("long") for c in values[1:]), F.col(values[0]).isNotNull().cast("long"))
    last = lambda c: F.max_by(F.col(c).cast("double"), F.when(F.col(c).isNotNull(), F.col(line)))
    return df.groupBy(F.col(characteristic).alias("characteristic")).agg(
        F.count("*").alias("lines"), F.sum(filled).alias("values"), F.count_if(filled == 0).alias("skipped"), *(x.alias(name) for k, c in limits.items() for name, x in ((k, last(c)), (f"{k}_changes", F.count_distinct(c))))
    )


# -- Indices of fitted families ----------------------------------------------------------


@pandas_udf(DoubleType())
def normal_beyond(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return z.map(lambda x: None if x is None or math.isnan(x) else 0.5 * math.erfc(x / math.sqrt(2)))


def family_indices(df: DataFrame, lsl: float, usl: float) -> DataFrame:
    """Indices of the fitted normal and lognormal family of each series: geometric (from three quantiles), by z values, and parts per million beyond the limits.

    The normal family has the deviation with n for divisor. The lognormal needs
    values and limits over zero; a series with others has no such row.
    """
    own = df.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    logs = df.groupBy("series").agg(F.avg(F.log("value")).alias("m"), F.stddev_pop(F.log("value")).alias("s"), F.min("value").alias("least")).filter("least > 0").drop("least")
    out = None
    for family, fit, low, high, x in (("normal", own, lsl, usl, lambda z: F.col("m") + z * F.col("s")), ("lognormal", logs, math.log(lsl) if lsl > 0 else None, math.log(usl), lambda z: F.exp(F.col("m") + z * F.col("s")))):
        if low is None:
            continue
        zl, zu = (F.col("m") - low) / F.col("s"), (high - F.col("m")) / F.col("s")
        first, middle, last = x(-SPAN), x(0.0), x(SPAN)
        capped = [F.least(z, F.lit(FARTHEST)) for z in (zl, zu)]
        row = fit.filter("s > 0").select(
            "series", F.lit(family).alias("family"), ((usl - lsl) / (last - first)).alias("p_g"), F.least((usl - middle) / (last - middle), (middle - lsl) / (middle - first)).alias("pk_g"),
            ((capped[0] + capped[1]) / 6).alias("p_z"), (F.least(*capped) / 3).alias("pk_z"), (1e6 * (normal_beyond(zl) + normal_beyond(zu))).alias("ppm"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# -- Designed experiments ---------------------------------------------------------------


def replicated_effects(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Effects of a full two-level design with replicates, by cell means, with the F ratio to the pure error and its probability.

    Every combination needs a row; cells may differ in size. Cells are 2 to the
    power of the factors, so their statistics come to the driver.
    """
    cells = df.groupBy(*factors).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")).collect()
    if len(cells) != 2 ** len(factors):
        raise ValueError("a combination of the factors has no row")
    n, m = np.array([c["n"] for c in cells], float), np.array([c["m"] for c in cells])
    dof = int(n.sum()) - len(cells)
    s2 = sum((c["n"] - 1) * c["v"] for c in cells if c["n"] > 1) / dof
    rows = []
    for k in range(1, len(factors) + 1):
        for term in combinations(factors, k):
            sign = np.prod([[c[f] for c in cells] for f in term], axis=0)
            effect = float(2 * (sign * m).mean())
            f = effect**2 / (4 * s2 * float((1 / n).sum()) / len(cells) ** 2)
            rows.append((":".join(term), effect, f, f_sf(f, 1, dof)))
    return df.sparkSession.createDataFrame(rows, "term string, effect double, f double, p double")


def unit_root_t(df: DataFrame) -> DataFrame:
    """df: (series, pos, value). t value of the lagged level in the regression of a series' steps on it, and whether it stays over -2.86 (a unit root is not refused)."""
    rows = chunked(df, 1).withColumn("before", F.lag("value").over(within_chunk())).filter("own and before is not null")
    rows = rows.withColumn("step", F.col("value") - F.col("before"))
    s = rows.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("step", "before").alias("b"), F.regr_sxx("step", "before").alias("sxx"), F.regr_syy("step", "before").alias("syy"), F.regr_sxy("step", "before").alias("sxy"))
    t = F.col("b") / F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return s.select("series", "n", F.col("b").alias("gamma"), t.alias("t"), (t > -2.86).alias("unit_root"))


def mardia_skewness(df: DataFrame, p: int, vector: str = "vec") -> DataFrame:
    """Mardia's skewness and its chi-square: the squared third moments of whitened coordinates add up to the mean over all pairs, so no pair is formed."""
    n, mean, cov = vector_moments(df, p, vector)
    white = np.linalg.inv(np.linalg.cholesky(cov * (n - 1) / n))
    d = [F.col(vector)[i].cast("double") - float(mean[i]) for i in range(p)]
    z = [sum((float(white[i, j]) * d[j] for j in range(1, i + 1)), float(white[i, 0]) * d[0]) for i in range(p)]
    rows = df.select(*(x.alias(f"z{i}") for i, x in enumerate(z)))
    third = [(a, b, c) for a in range(p) for b in range(a, p) for c in range(b, p)]
    ways = lambda t: math.factorial(3) / math.prod(math.factorial(t.count(x)) for x in set(t))
    sums = rows.agg(*(F.avg(F.col(f"z{a}") * F.col(f"z{b}") * F.col(f"z{c}")).alias(f"m{k}") for k, (a, b, c) in enumerate(third)))
    b1 = sum(ways(t) * F.col(f"m{k}") * F.col(f"m{k}") for k, t in enumerate(third))
    return sums.select(F.lit(n).alias("n"), b1.alias("b1"), (n * b1 / 6).alias("chi2"), F.lit(p * (p + 1) * (p + 2) // 6).alias("df"))
