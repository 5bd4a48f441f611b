"""Queries over measurements, their validity, subgroups, estimators and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyline.functions.numeric import c4, d2
from steadyline.operators import estimators as E
from steadyline.operators import measurements as X

from .inputs import LOG, G, M, groups, mark_log, measurements, query, r, rounded, table
from .tail_sql import f_tail, solved

LSL, USL = 5.0, 150.0


@query(f"WITH {M} SELECT series, pos, event_id, value FROM m")
def positions(spark, sf_dir):
    return measurements(spark, sf_dir).select("series", "pos", "event_id", "value")


@query(f"WITH {LOG} SELECT m.series, m.pos, value FROM m ANTI JOIN bad USING (series, pos)")
def valid_values(spark, sf_dir):
    return X.valid_rows(measurements(spark, sf_dir), mark_log(spark, sf_dir)).select("series", "pos", "value")


@query(f"WITH {LOG} SELECT series, pos, 'mark_invalid' AS action, 'checked' AS reason, 'qa' AS \"by\" FROM bad")
def invalid_marks(spark, sf_dir):
    return X.invalid_positions(mark_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT series, pos, new_phase FROM cuts")
def restart_marks(spark, sf_dir):
    return X.restarts(mark_log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT m.series, m.pos, count(c.pos) AS segment, CAST(count(c.pos) FILTER (WHERE c.new_phase) AS BIGINT) AS phase
FROM m LEFT JOIN cuts c ON m.series = c.series AND c.pos <= m.pos GROUP BY m.series, m.pos""")
def segments(spark, sf_dir):
    out = X.with_segments(measurements(spark, sf_dir), X.restarts(mark_log(spark, sf_dir)))
    return out.select("series", "pos", F.col("segment").cast("long").alias("segment"), F.col("phase").cast("long").alias("phase"))


@query(f"""WITH {LOG} SELECT series, count(*) AS n_total, count(b.pos) AS n_invalid, count(*) - count(b.pos) AS n_effective,
(SELECT count(*) FROM cuts WHERE cuts.series = m.series) AS n_restarts FROM m LEFT JOIN bad b USING (series, pos) GROUP BY series""")
def dataset_summary(spark, sf_dir):
    return X.summary(measurements(spark, sf_dir), mark_log(spark, sf_dir))


@query(f"""WITH {LOG}, raw AS (SELECT m.series, CAST(m.user_id % 40 AS VARCHAR) AS label, count(*) AS raw, count(*) FILTER (WHERE b.pos IS NULL) AS n, min(m.pos) AS ord,
avg(value) FILTER (WHERE b.pos IS NULL) AS mean FROM m LEFT JOIN bad b USING (series, pos) GROUP BY 1, 2)
SELECT series, label, raw, n, ord, {r("mean")}, max(raw) OVER (PARTITION BY series) AS nominal, n = max(raw) OVER (PARTITION BY series) AS whole FROM raw""")
def labelled_subgroups(spark, sf_dir):
    m = measurements(spark, sf_dir).join(X.invalid_positions(mark_log(spark, sf_dir)).select("series", "pos", F.lit(True).alias("bad")), ["series", "pos"], "left")
    out = X.subgroup_stats(m, F.col("user_id") % 40, F.col("bad").isNull())
    return rounded(out.select("series", "label", "raw", "n", "ord", "mean", "nominal", "whole"))


@query(f"WITH {G} SELECT series, label, ord, {r('mean')}, {r('sd')}, {r('rng', 'range')}, {r('med', 'median')} FROM g")
def subgroups_of_five(spark, sf_dir):
    return rounded(groups(spark, sf_dir).select("series", "label", "ord", "mean", "sd", "range", "median"))


@query(f"""WITH {M}, wanted AS (SELECT event_type AS series, event_id FROM events WHERE event_id % 1000 = 7 UNION ALL SELECT 'click', -1)
SELECT w.series, w.event_id AS source_row, pos FROM wanted w LEFT JOIN m ON m.series = w.series AND m.event_id = w.event_id""")
def source_row_positions(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("source_row", F.col("event_id"))
    wanted = m.filter("source_row % 1000 = 7").select("series", "source_row").union(spark.sql("select 'click', -1L"))
    return X.positions_of_rows(m, wanted)


@query(f"""WITH {M}, a AS (SELECT series, median(value) AS md FROM m GROUP BY 1), o AS (SELECT m.*, value - md AS off FROM m JOIN a USING (series)),
s AS (SELECT series, median(abs(off)) AS mad FROM o GROUP BY 1)
SELECT series, pos, value, {r("0.6745 * off / mad", "z")} FROM o JOIN s USING (series) WHERE mad > 0 AND abs(0.6745 * off / mad) > 3.5""")
def outliers_mad(spark, sf_dir):
    return rounded(X.suspects_mad(measurements(spark, sf_dir)))


@query(f"""WITH {M}, q AS (SELECT series, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY 1)
SELECT series, pos, value, {r("q1 - 3 * (q3 - q1)", "low")}, {r("q3 + 3 * (q3 - q1)", "high")} FROM m JOIN q USING (series) WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)""")
def outliers_tukey(spark, sf_dir):
    return rounded(X.suspects_tukey(measurements(spark, sf_dir)))


@query(f"""WITH RECURSIVE {M}, s AS (SELECT series, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 2 AND stddev_samp(value) > 0),
g AS (SELECT m.series, pos, value, abs(value - mean) / sd AS g, n FROM m JOIN s USING (series) QUALIFY row_number() OVER (PARTITION BY m.series ORDER BY abs(value - mean) / sd DESC, pos) = 1),
c AS (SELECT DISTINCT n, 0.05 / n AS target FROM g), {solved("c", "n", f_tail("(x * x)", "1", "(n - 2)"), 0.5, 40.0, 50)},
k AS (SELECT g.*, (g.n - 1) / sqrt(g.n) * sqrt(x * x / (g.n - 2 + x * x)) AS critical FROM g JOIN solved USING (n)) SELECT series, pos, {r("value")}, {r("g")}, {r("critical")} FROM k WHERE g > critical""")
def outliers_grubbs(spark, sf_dir):
    return rounded(X.suspects_grubbs(measurements(spark, sf_dir)))


@query(f"""WITH {M}, i AS (SELECT series, pos - row_number() OVER (PARTITION BY series, floor(value / 40) ORDER BY pos) AS island, floor(value / 40) AS v FROM m)
SELECT series, max(n) AS longest FROM (SELECT series, v, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY series""")
def longest_equal_run(spark, sf_dir):
    return X.longest_run(measurements(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 40)))


_GCD = "list_reduce(list(DISTINCT step) FILTER (WHERE step > 0), lambda a, b: gcd(a, b))"


@query(f"""SELECT 'retail' AS series, {_GCD} / 100.0::DOUBLE AS resolution FROM (SELECT CAST(round((p_retailprice - min(p_retailprice) OVER ()) * 100) AS BIGINT) AS step FROM part)
UNION ALL SELECT 'size', {_GCD} / 1.0::DOUBLE FROM (SELECT CAST(p_size - min(p_size) OVER () AS BIGINT) AS step FROM part)""")
def grid_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.lit("size").alias("series"), F.col("p_size").cast("double").alias("value")).union(part.select(F.lit("retail"), F.col("p_retailprice").cast("double")))
    return rounded(X.resolution(rows))


@query(f"WITH {G} SELECT series, {r('avg(mean)', 'l3')}, {r('avg(med)', 'l4')} FROM g GROUP BY series")
def location_estimates(spark, sf_dir):
    return rounded(E.location(groups(spark, sf_dir)))


@query(f"WITH {M} SELECT series, {r('avg(value)', 'l1')}, {r('median(value)', 'l2')}, {r('stddev_samp(value)', 'd5')}, {r('max(value) - min(value)', 'total_range')}, count(*) AS n FROM m GROUP BY series")
def overall_estimates(spark, sf_dir):
    return rounded(E.overall(measurements(spark, sf_dir)))


@query(f"WITH {G} SELECT series, {r('sqrt(avg(var))', 'sigma_var')}, {r(f'avg(sd) / {c4(5)!r}', 'sigma_s')}, {r(f'avg(rng) / {d2(5)!r}', 'sigma_r')}, {r('avg(sd)', 's_bar')}, {r('avg(rng)', 'r_bar')} FROM g GROUP BY series")
def dispersion_estimates(spark, sf_dir):
    return rounded(E.dispersion(groups(spark, sf_dir), 5))


@query(f"WITH {G} SELECT series, {r('avg(mean)', 'mu')}, {r('sqrt(avg(var))', 'sigma_in')}, {r('sqrt(greatest(0, var_samp(mean) - avg(var) / 5))', 'sigma_out')}, count(*) AS k FROM g GROUP BY series")
def within_between(spark, sf_dir):
    return rounded(E.within_between(groups(spark, sf_dir), 5))


@query(f"""WITH {G}, a AS (SELECT series, mean, row_number() OVER (PARTITION BY series ORDER BY mean DESC, ord) AS hi, row_number() OVER (PARTITION BY series ORDER BY mean, ord) AS lo FROM g)
SELECT series, {r("avg(mean) FILTER (WHERE hi <= 3)", "mu_max")}, {r("avg(mean) FILTER (WHERE lo <= 3)", "mu_min")} FROM a GROUP BY series""")
def extreme_means(spark, sf_dir):
    return rounded(E.extremes(groups(spark, sf_dir)))


@query(f"WITH {M} SELECT series, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 's')}, {r('skewness(value)', 'skewness')}, {r('kurtosis(value) + 3', 'kurtosis')} FROM m GROUP BY series")
def bias_corrected_moments(spark, sf_dir):
    return rounded(E.moments(measurements(spark, sf_dir)))


_C = f"""WITH {M}, s AS (SELECT series, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM m GROUP BY series),
i AS (SELECT *, ({USL} - {LSL}) / (6 * s) AS p, least((mean - {LSL}) / (3 * s), ({USL} - mean) / (3 * s)) AS pk FROM s)"""


@query(f"{_C} SELECT series, n, {r('mean')}, {r('s')}, {r('p')}, {r('pk')}, {r(f'(mean - {LSL}) / (3 * s)', 'pl')}, {r(f'({USL} - mean) / (3 * s)', 'pu')} FROM i")
def overall_capability(spark, sf_dir):
    return rounded(E.capability(measurements(spark, sf_dir), LSL, USL))


@query(f"""WITH {G}, s AS (SELECT series, avg(mean) AS mean, sqrt(avg(var)) AS sigma FROM g GROUP BY series)
SELECT series, {r("mean")}, {r("sigma")}, {r(f"({USL} - {LSL}) / (6 * sigma)", "cw")}, {r(f"least((mean - {LSL}) / (3 * sigma), ({USL} - mean) / (3 * sigma))", "cwk")}, {r(f"(mean - {LSL}) / (3 * sigma)", "cwl")}, {r(f"({USL} - mean) / (3 * sigma)", "cwu")} FROM s""")
def within_capability(spark, sf_dir):
    return rounded(E.within_capability(groups(spark, sf_dir), 5, LSL, USL))


@query(f"""WITH {M}, q AS (SELECT series, quantile_cont(value, 0.00135) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.99865) AS c FROM m GROUP BY series)
SELECT series, {r("a", "x_low")}, {r("b", "x_mid")}, {r("c", "x_high")}, {r(f"({USL} - {LSL}) / (c - a)", "p")}, {r(f"least((b - {LSL}) / (b - a), ({USL} - b) / (c - b))", "pk")} FROM q""")
def quantile_capability(spark, sf_dir):
    return rounded(E.quantile_capability(measurements(spark, sf_dir), LSL, USL))


@query(f"WITH {M} SELECT series, {r(f'1e6 * avg(CASE WHEN value < {LSL} THEN 1.0 ELSE 0.0 END)', 'ppm_below')}, {r(f'1e6 * avg(CASE WHEN value > {USL} THEN 1.0 ELSE 0.0 END)', 'ppm_above')} FROM m GROUP BY series")
def out_of_spec_ppm(spark, sf_dir):
    return rounded(E.out_of_spec(measurements(spark, sf_dir), LSL, USL))


@query(f"""{_C} SELECT series, n, {r("pk")}, {r("pk - 1.959963984540054 * sqrt(1 / (9 * n) + pk ^ 2 / (2 * (n - 1)))", "pk_low")}, {r("pk + 1.959963984540054 * sqrt(1 / (9 * n) + pk ^ 2 / (2 * (n - 1)))", "pk_high")},
CASE WHEN pk < 0.25 THEN 'fails' WHEN pk - 1.959963984540054 * sqrt(1 / (9 * n) + pk ^ 2 / (2 * (n - 1))) >= 0.25 THEN 'meets' ELSE 'meets_estimate_only' END AS verdict FROM i""")
def capability_intervals(spark, sf_dir):
    out = E.index_intervals(E.capability(measurements(spark, sf_dir), LSL, USL))
    return rounded(out.select("series", "n", "pk", "pk_low", "pk_high", E.verdict(F.col("pk"), F.col("pk_low"), 0.25).alias("verdict")))


@query(f"""WITH {G}, u AS (SELECT series, row_number() OVER w AS i, sum(mean) OVER w AS lft FROM g WINDOW w AS (PARTITION BY series ORDER BY ord)),
t AS (SELECT series, sum(mean) AS al, count(*) AS n FROM g GROUP BY series),
s AS (SELECT series, i, lft / i AS a, (al - lft) / (n - i) AS b, (lft / i - (al - lft) / (n - i)) ^ 2 * i * (n - i) / n AS score FROM u JOIN t USING (series) WHERE i >= 8 AND n - i >= 8)
SELECT series, CAST(i AS INT) AS split_after, {r("a", "level_before")}, {r("b", "level_after")}, {r("score")} FROM s QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(score, 9) DESC, i) = 1""")
def level_shift(spark, sf_dir):
    return rounded(E.best_split(groups(spark, sf_dir)))


@query(f"""WITH l AS (SELECT CAST(l_returnflag || l_linestatus AS VARCHAR) AS level, count(*) AS "values", count(DISTINCT l_suppkey) AS subgroups FROM lineitem GROUP BY 1)
SELECT level, "values", subgroups, {r('"values" / sum("values") OVER ()', "share")}, "values" / sum("values") OVER () < 0.5 / count(*) OVER () AS thin FROM l""")
def factor_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("state"), "l_suppkey")
    return rounded(E.coverage(rows, "state", "l_suppkey"))


