"""Queries that draw analysis charts and apply the stability criteria."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, CN, c4, chi2_ppf, d2, d3, upper_u, w_quantile
from steadyline.operators import analysis as A
from steadyline.operators import charts as C
from steadyline.operators import estimators as E
from steadyline.operators import measurements as X
from steadyline.operators import rules as R
from steadyline.operators import sequential as S
from steadyline.operators.measurements import with_position

from .inputs import LOG, D, G, M, daily_errors, groups, mark_log, measurements, query, r, rounded, table
from .tail_sql import chi2_tail_large, f_tail, solved

U = upper_u(ALPHA)


def _points(keys: str, source: str, value: str, center: str, lcl: str, ucl: str) -> str:
    return f"SELECT {keys}, {r(value, 'point')}, {r(center, 'center')}, {r(lcl, 'lcl')}, {r(ucl, 'ucl')}, ({value} > {ucl} OR {value} < {lcl}) AS alarm FROM {source}"


def _pair(est: str, where: str, spread: str, half: str, low: str, high: str, center: str) -> str:
    return f"""WITH {G}, e AS (SELECT series, {est} FROM g GROUP BY series), j AS (SELECT * FROM g JOIN e USING (series))
{_points("series, label, ord, 'location' AS chart", "j", where, "mu", f"mu - {half}", f"mu + {half}")}
UNION ALL {_points("series, label, ord, 'variation' AS chart", "j", spread, center, low, high)}"""


_S = [math.sqrt(chi2_ppf(q, 4) / 4) for q in (ALPHA / 2, 1 - ALPHA / 2)]
_W = [w_quantile(5, q) for q in (ALPHA / 2, 1 - ALPHA / 2)]
_H = U / math.sqrt(5)


@query(_pair("avg(mean) AS mu, avg(sd) AS sb, sqrt(avg(var)) AS sr", "mean", "sd", f"{_H!r} * sr", f"{_S[0]!r} * sr", f"{_S[1]!r} * sr", "sb"))
def xbar_s_chart(spark, sf_dir):
    return rounded(C.xbar_s(groups(spark, sf_dir), 5))


_B = U * math.sqrt(1 - c4(5) ** 2) / c4(5)


@query(_pair("avg(mean) AS mu, avg(sd) AS sb", "mean", "sd", f"{_H / c4(5)!r} * sb", f"greatest(0, sb * {1 - _B!r})", f"sb * {1 + _B!r}", "sb"))
def xbar_s_factor_chart(spark, sf_dir):
    return rounded(C.xbar_s(groups(spark, sf_dir), 5, method="iso7870"))


@query(_pair("avg(mean) AS mu, avg(rng) AS rb", "mean", "rng", f"{_H!r} * rb / {d2(5)!r}", f"{_W[0]!r} * rb / {d2(5)!r}", f"{_W[1]!r} * rb / {d2(5)!r}", "rb"))
def xbar_r_chart(spark, sf_dir):
    return rounded(C.xbar_r(groups(spark, sf_dir), 5))


@query(_pair("avg(mean) AS mu, avg(rng) AS rb", "mean", "rng", f"{_H!r} * rb / {d2(5)!r}", f"greatest(0, rb - {U * d3(5)!r} * rb / {d2(5)!r})", f"rb + {U * d3(5)!r} * rb / {d2(5)!r}", "rb"))
def xbar_r_factor_chart(spark, sf_dir):
    return rounded(C.xbar_r(groups(spark, sf_dir), 5, method="iso7870"))


@query(_pair("avg(med) AS mu, avg(rng) AS rb", "med", "rng", f"{_H * CN[5]!r} * rb / {d2(5)!r}", f"{_W[0]!r} * rb / {d2(5)!r}", f"{_W[1]!r} * rb / {d2(5)!r}", "rb"))
def median_r_chart(spark, sf_dir):
    return rounded(C.median_r(groups(spark, sf_dir), 5))


_W2 = [w_quantile(2, q) for q in (ALPHA / 2, 1 - ALPHA / 2)]
_I = f"""{M}, x AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series ORDER BY pos)) AS mr FROM m),
e AS (SELECT series, avg(value) AS mu, avg(mr) AS mb, avg(mr) / {d2(2)!r} AS sg FROM x GROUP BY series), j AS (SELECT * FROM x JOIN e USING (series))"""


@query(f"""WITH {_I} {_points("series, pos, 'location' AS chart", "j", "value", "mu", f"mu - {U!r} * sg", f"mu + {U!r} * sg")}
UNION ALL {_points("series, pos, 'variation' AS chart", "(SELECT * FROM j WHERE mr IS NOT NULL)", "mr", "mb", f"{_W2[0]!r} * sg", f"{_W2[1]!r} * sg")}""")
def individuals_chart(spark, sf_dir):
    return rounded(C.imr(measurements(spark, sf_dir)))


def _case(q: float, most: int) -> str:
    return "CASE tv " + " ".join(f"WHEN {t} THEN {w_quantile(t, q)!r}" for t in range(2, most + 1)) + " END"


@query(f"""WITH {LOG}, seg AS (SELECT m.series, m.pos, any_value(value) AS value, count(c.pos) AS segment, CAST(count(c.pos) FILTER (WHERE c.new_phase) AS BIGINT) AS phase
FROM m LEFT JOIN cuts c ON m.series = c.series AND c.pos <= m.pos GROUP BY m.series, m.pos),
x AS (SELECT *, avg(value) OVER (w ROWS 2 PRECEDING) AS mean, max(value) OVER (w ROWS 2 PRECEDING) - min(value) OVER (w ROWS 2 PRECEDING) AS rng, least(row_number() OVER w, 3) AS t, least(row_number() OVER w, 3) AS tv
  FROM seg WINDOW w AS (PARTITION BY series, segment ORDER BY pos)),
e AS (SELECT series, phase, avg(value) AS mu, avg(rng) FILTER (WHERE tv = 3) AS rb FROM x GROUP BY ALL), j AS (SELECT *, rb / {d2(3)!r} AS sg FROM x JOIN e USING (series, phase))
{_points("series, pos, segment, phase, 'location' AS chart", "j", "mean", "mu", f"mu - {U!r} * sg / sqrt(t)", f"mu + {U!r} * sg / sqrt(t)")}
UNION ALL {_points("series, pos, segment, phase, 'variation' AS chart", "(SELECT * FROM j WHERE tv >= 2)", "rng", "rb", f"{_case(ALPHA / 2, 3)} * sg", f"{_case(1 - ALPHA / 2, 3)} * sg")}""")
def moving_individuals_chart(spark, sf_dir):
    rows = X.with_segments(measurements(spark, sf_dir), X.restarts(mark_log(spark, sf_dir)))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("segment", "phase")})
    return rounded(C.imr_moving(rows, 3))


def _quantile(kind: str) -> str:
    """SQL of limits by adding up probabilities: (n, lo, hi) per distinct size, counts in units."""
    pmf = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(b) + (n - k) * ln(1 - b))" if kind in ("p", "np") else "exp(k * ln(b * n) - b * n - lgamma(k + 1))"
    top = "n" if kind in ("p", "np") else "CAST(b * n + 20 * sqrt(b * n) + 20 AS BIGINT)"
    return f"""q AS (SELECT n, min(k) FILTER (WHERE cdf >= {ALPHA / 2!r}) AS lo, min(k) FILTER (WHERE cdf >= {1 - ALPHA / 2!r}) AS hi
FROM (SELECT n, k, sum(pmf) OVER (PARTITION BY n ORDER BY k) AS cdf FROM (SELECT n, k, {pmf} AS pmf FROM (SELECT n, b, unnest(generate_series(0, {top})) AS k FROM (SELECT DISTINCT n, b FROM s)))) GROUP BY n)"""


def _counts(kind: str) -> str:
    size = {"np": "400", "c": "1"}.get(kind, "n")
    by = "/ n" if kind in ("p", "u") else ""
    center = "b * n" if kind == "np" else "b"
    return f"""WITH {D}, s AS (SELECT series, pos, x, CAST({size} AS BIGINT) AS n, sum(x) OVER () / sum({size}) OVER () AS b FROM d), {_quantile(kind)}, j AS (SELECT s.*, lo, hi FROM s JOIN q USING (n))
{_points("series, pos", "j", f"x {by} + 0.0::DOUBLE", center, f"lo {by} + 0.0::DOUBLE", f"hi {by} + 0.0::DOUBLE")}"""


@query(_counts("p"))
def p_chart(spark, sf_dir):
    return rounded(C.attribute_chart(daily_errors(spark, sf_dir), "p"))


@query(_counts("u"))
def u_chart(spark, sf_dir):
    return rounded(C.attribute_chart(daily_errors(spark, sf_dir), "u"))


@query(_counts("c"))
def c_chart(spark, sf_dir):
    return rounded(C.attribute_chart(daily_errors(spark, sf_dir), "c"))


@query(_counts("np"))
def np_chart(spark, sf_dir):
    return rounded(C.attribute_chart(daily_errors(spark, sf_dir).withColumn("n", F.lit(400)), "np"))


_Z = f"""WITH {D}, e AS (SELECT series, sum(x) / sum(n) AS c FROM d GROUP BY series),
z AS (SELECT series, pos, x / n AS rate, c, sqrt(c * (1 - c) / n) AS sg, (x / n - c) / sqrt(c * (1 - c) / n) AS z FROM d JOIN e USING (series))"""


@query(f"{_Z} {_points('series, pos', 'z', 'z', '0.0', f'{-U!r}', f'{U!r}')}")
def z_chart(spark, sf_dir):
    return rounded(C.z_chart(daily_errors(spark, sf_dir), "p"))


@query(f"""{_Z}, k AS (SELECT series, avg(abs(dz)) / {d2(2)!r} AS sz FROM (SELECT series, z - lag(z) OVER (PARTITION BY series ORDER BY pos) AS dz FROM z) GROUP BY series),
j AS (SELECT * FROM z JOIN k USING (series))
{_points(f"series, pos, {r('sz', 'sigma_z')}", "j", "rate", "c", f"greatest(0, c - {U!r} * sz * sg)", f"least(1, c + {U!r} * sz * sg)")}""")
def laney_p_chart(spark, sf_dir):
    return rounded(C.laney(daily_errors(spark, sf_dir), "p"))


_GAPS = f"""{M}, hits AS (SELECT series, pos FROM m WHERE value > 100),
gaps AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS pos, pos - lag(pos, 1, -1) OVER (PARTITION BY series ORDER BY pos) - 1 AS value FROM hits)"""


def _geometric(q: float) -> str:
    return f"greatest(0, ceil({math.log1p(-q)!r} / ln(1 - p) - 1e-12) - 1)"


@query(f"""WITH {_GAPS}, e AS (SELECT series, 1 / (avg(value) + 1) AS p FROM gaps GROUP BY series), j AS (SELECT * FROM gaps JOIN e USING (series))
{_points("series, pos", "j", "CAST(value AS DOUBLE)", _geometric(0.5), _geometric(ALPHA / 2), _geometric(1 - ALPHA / 2))}""")
def g_chart(spark, sf_dir):
    hits = X.with_position(measurements(spark, sf_dir).filter("value > 100").select("series", F.col("pos").alias("at")), "series", "at")
    last = X.chunked(hits, 1).withColumn("last", F.lag("at", 1, -1).over(X.within_chunk())).filter("own")
    return rounded(C.g_chart(last.select("series", "pos", (F.col("at") - F.col("last") - 1).alias("value"))))


@query(f"""WITH {M}, e AS (SELECT series, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.995) AS c FROM m GROUP BY series HAVING count(*) >= 540), j AS (SELECT * FROM m JOIN e USING (series))
{_points("series, pos", "j", "value", "b", "a", "c")}""")
def percentile_chart(spark, sf_dir):
    return rounded(C.percentile_chart(measurements(spark, sf_dir), alpha=0.01))


@query(f"""WITH {_I}, a AS (SELECT *, avg(value) OVER (PARTITION BY series ORDER BY pos ROWS 7 PRECEDING) AS ma, {U!r} * sg / sqrt(least(pos + 1, 8)) AS h FROM j)
{_points("series, pos", "a", "ma", "mu", "mu - h", "mu + h")}""")
def uwma_chart(spark, sf_dir):
    return rounded(C.uwma_chart(measurements(spark, sf_dir), 8))


_T = "(VALUES ('u0', 40.0), ('u1', 50.0), ('u2', 60.0))"


@query(f"""WITH {M}, x AS (SELECT series, pos, product, value - target AS v FROM (SELECT *, 'u' || (user_id % 3) AS product FROM m) JOIN (SELECT col0 AS product, CAST(col1 AS DOUBLE) AS target FROM {_T}) USING (product)),
e AS (SELECT series, {U!r} * avg(abs(dv)) / {d2(2)!r} AS h FROM (SELECT series, v - lag(v) OVER (PARTITION BY series ORDER BY pos) AS dv FROM x) GROUP BY series), j AS (SELECT * FROM x JOIN e USING (series))
{_points("series, pos, product", "j", "v", "0.0", "-h", "h")}""")
def delta_target_chart(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("product", F.concat(F.lit("u"), F.col("user_id") % 3))
    targets = spark.createDataFrame([("u0", 40.0), ("u1", 50.0), ("u2", 60.0)], "product string, target double")
    return rounded(C.delta_target_chart(m, targets))


@query(f"""WITH {M}, e AS (SELECT user_id AS stream, avg(value) AS mu, stddev_samp(value) AS sd FROM m GROUP BY 1 HAVING count(*) >= 20), j AS (SELECT user_id AS stream, event_id AS pos, value, mu, {U!r} * sd AS h FROM m JOIN e ON user_id = stream)
{_points("stream, pos", "j", "value", "mu", "mu - h", "mu + h")}""")
def levey_jennings_chart(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), "value")
    return rounded(C.levey_jennings(rows, "stream"))


@query(f"""WITH {M}, x AS (SELECT *, CAST(pos % 50 AS DOUBLE) AS x FROM m), f AS (SELECT series, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy, count(*) AS n FROM x GROUP BY series),
j AS (SELECT x.series, pos, value, b, a + b * x AS l, {U!r} * sqrt((syy - b * sxy) / (n - 2)) AS h FROM x JOIN f USING (series))
{_points(f"series, pos, {r('b', 'slope')}", "j", "value", "l", "l - h", "l + h")}""")
def trend_chart(spark, sf_dir):
    return rounded(C.trend_chart(measurements(spark, sf_dir), cycle=50))


@query(f"""WITH {G}, e AS (SELECT series, avg(mean) AS mu, {_H!r} * sqrt(avg(var)) + 1.5 * sqrt(greatest(0, var_samp(mean) - avg(var) / 5)) AS h FROM g GROUP BY series), j AS (SELECT * FROM g JOIN e USING (series))
{_points("series, label", "j", "mean", "mu", "mu - h", "mu + h")}""")
def extended_limits_chart(spark, sf_dir):
    g = groups(spark, sf_dir)
    return rounded(C.extended_limits(g, E.within_between(g, 5), 5))


# -- Criteria ------------------------------------------------------------------


def _xbar_points(spark, sf_dir):
    g = groups(spark, sf_dir)
    sigma = g.groupBy("series").agg((F.sqrt(F.avg("var")) / math.sqrt(5)).alias("sigma"))
    return C.xbar_s(g, 5).filter("chart = 'location'").join(sigma, "series").select("series", F.floor(F.col("ord") / 5).alias("pos"), "point", "center", "lcl", "ucl", "sigma")


@query(f"""WITH {G}, e AS (SELECT series, avg(mean) AS mu, sqrt(avg(var)) / sqrt(5) AS sg FROM g GROUP BY series),
z AS (SELECT series, ord // 5 AS i, mean AS v, mu, mu - {U!r} * sg AS lo, mu + {U!r} * sg AS hi, sign(mean - mu) AS side, (mean - mu) / sg AS z, sign(mean - lag(mean) OVER (PARTITION BY series ORDER BY ord)) AS step FROM g JOIN e USING (series)),
a AS (SELECT *, sum(CASE WHEN side IS DISTINCT FROM pside THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY i) AS island, sum(CASE WHEN step IS DISTINCT FROM pstep THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY i) AS slope
  FROM (SELECT *, lag(side) OVER (PARTITION BY series ORDER BY i) AS pside, lag(step) OVER (PARTITION BY series ORDER BY i) AS pstep FROM z)),
f AS (SELECT series, i AS pos, v > hi OR v < lo AS beyond_limits, side <> 0 AND row_number() OVER (PARTITION BY series, island ORDER BY i) >= 7 AS run,
  coalesce(step, 0) <> 0 AND row_number() OVER (PARTITION BY series, slope ORDER BY i) + 1 >= 7 AS trend,
  count(*) OVER (w ROWS 24 PRECEDING) = 25 AND NOT (count(*) FILTER (WHERE abs(v - (hi + lo) / 2) <= (hi - lo) / 6) OVER (w ROWS 24 PRECEDING)) BETWEEN 11 AND 23 AS middle_third,
  count(*) OVER (w ROWS 2 PRECEDING) = 3 AND (count(*) FILTER (WHERE z > 2) OVER (w ROWS 2 PRECEDING) >= 2 OR count(*) FILTER (WHERE z < -2) OVER (w ROWS 2 PRECEDING) >= 2) AS two_of_three_beyond_2s,
  count(*) OVER (w ROWS 4 PRECEDING) = 5 AND (count(*) FILTER (WHERE z > 1) OVER (w ROWS 4 PRECEDING) >= 4 OR count(*) FILTER (WHERE z < -1) OVER (w ROWS 4 PRECEDING) >= 4) AS four_of_five_beyond_1s,
  count(*) FILTER (WHERE abs(z) < 1) OVER (w ROWS 14 PRECEDING) = 15 AS fifteen_within_1s FROM a WINDOW w AS (PARTITION BY series ORDER BY i))
SELECT series, pos, rule FROM (UNPIVOT f ON beyond_limits, run, trend, middle_third, two_of_three_beyond_2s, four_of_five_beyond_1s, fifteen_within_1s INTO NAME rule VALUE hit) WHERE hit""")
def stability_violations(spark, sf_dir):
    return R.violations(_xbar_points(spark, sf_dir), R.ALL)


# -- Sequential and multivariate -------------------------------------------------


def _standard(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return m.join(m.groupBy("series").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd")), "series")


_N = f"{M}, e AS (SELECT series, avg(value) AS mu, stddev_samp(value) AS sd FROM m GROUP BY series), x AS (SELECT m.series, pos, value, mu, sd, (value - mu) / sd AS z FROM m JOIN e USING (series))"


@query(f"""WITH RECURSIVE {_N}, c AS (SELECT series, pos, greatest(0, z - 0.5) AS h, least(0, z + 0.5) AS l FROM x WHERE pos = 0
  UNION ALL SELECT x.series, x.pos, greatest(0, CASE WHEN c.h > 4.774897046326059 OR -c.l > 4.774897046326059 THEN 0 ELSE c.h END + z - 0.5), least(0, CASE WHEN c.h > 4.774897046326059 OR -c.l > 4.774897046326059 THEN 0 ELSE c.l END + z + 0.5)
  FROM c JOIN x ON x.series = c.series AND x.pos = c.pos + 1)
SELECT series, pos, {r("h", "high")}, {r("l", "low")}, CASE WHEN h > 4.774897046326059 THEN 'shift_up' WHEN -l > 4.774897046326059 THEN 'shift_down' END AS signal FROM c""")
def cusum_chart(spark, sf_dir):
    return rounded(S.cusum(_standard(spark, sf_dir), "mu", "sd"))


@query(f"""WITH {_N}, s AS (SELECT series, pos, sum(z - 0.5) OVER w AS a, sum(z + 0.5) OVER w AS b FROM x WINDOW w AS (PARTITION BY series ORDER BY pos))
SELECT series, pos, {r("a - least(0, min(a) OVER w)", "high")}, {r("b - greatest(0, max(b) OVER w)", "low")} FROM s WINDOW w AS (PARTITION BY series ORDER BY pos)""")
def cusum_sums(spark, sf_dir):
    return rounded(S.cusum_sums(_standard(spark, sf_dir), "mu", "sd"))


@query(f"""WITH RECURSIVE {_N}, c AS (SELECT series, pos, 0.2 * value + 0.8 * mu AS z, 1 AS i, mu, sd FROM x WHERE pos = 0
  UNION ALL SELECT x.series, x.pos, 0.2 * x.value + 0.8 * CASE WHEN abs(c.z - c.mu) > 2.962 * c.sd * sqrt(0.2 / 1.8 * (1 - 0.8 ^ (2 * c.i))) THEN c.mu ELSE c.z END,
    CASE WHEN abs(c.z - c.mu) > 2.962 * c.sd * sqrt(0.2 / 1.8 * (1 - 0.8 ^ (2 * c.i))) THEN 1 ELSE c.i + 1 END, x.mu, x.sd FROM c JOIN x ON x.series = c.series AND x.pos = c.pos + 1),
h AS (SELECT *, 2.962 * sd * sqrt(0.2 / 1.8 * (1 - 0.8 ^ (2 * i))) AS h FROM c)
SELECT series, pos, {r("z")}, {r("h", "half")}, CASE WHEN z > mu + h THEN 'shift_up' WHEN z < mu - h THEN 'shift_down' END AS signal FROM h""")
def ewma_chart(spark, sf_dir):
    return rounded(S.ewma(_standard(spark, sf_dir), "mu", "sd"))


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
e AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM v),
t AS (SELECT vec_id, (vb * (a - ma) ^ 2 - 2 * vab * (a - ma) * (b - mb) + va * (b - mb) ^ 2) / (va * vb - vab ^ 2) AS t2, (b - mb) ^ 2 / vb AS wa, (a - ma) ^ 2 / va AS wb FROM v, e),
q AS (SELECT n, {ALPHA!r} AS target FROM e), {solved("q", "n", f_tail("x", "2", "(n - 2)"), 1e-6, 60.0, 60)}
SELECT vec_id, {r("t2")}, {r("t2 - wa", "d1")}, {r("t2 - wb", "d2")}, t2 > 2.0 * (n + 1) * (n - 1) / (n * (n - 2)) * x AS alarm FROM t, solved""")
def hotelling_t2(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return rounded(S.t2_chart(rows, 2).drop("vec"))


_L = f"{M}, d AS (SELECT series, pos, value - avg(value) OVER (PARTITION BY series) AS d FROM m)"


@query(f"""WITH {_L}, l AS (SELECT series, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2, lag(d, 3) OVER w AS l3 FROM d WINDOW w AS (PARTITION BY series ORDER BY pos)),
c AS (SELECT series, count(*) AS n, sum(d * l1) / sum(d * d) AS r1, sum(d * l2) / sum(d * d) AS r2, sum(d * l3) / sum(d * d) AS r3 FROM l GROUP BY series)
SELECT series, n, {r("r1")}, {r("n * (n + 2) * (r1 ^ 2 / (n - 1) + r2 ^ 2 / (n - 2) + r3 ^ 2 / (n - 3))", "q")} FROM c""")
def ljung_box(spark, sf_dir):
    return rounded(S.ljung_box(measurements(spark, sf_dir), 3))


_AR = f"""{_L}, l AS (SELECT series, pos, d, lag(d) OVER (PARTITION BY series ORDER BY pos) AS l1 FROM d),
f AS (SELECT series, sum(d * l1) / sum(l1 * l1) AS phi, sqrt((sum(d * d) FILTER (WHERE l1 IS NOT NULL) - sum(d * l1) ^ 2 / sum(l1 * l1)) / (count(l1) - 1)) AS se FROM l GROUP BY series)"""


@query(f"WITH {_AR} SELECT series, {r('phi', 'phi')}, {r('se', 'sigma_e')} FROM f")
def ar_fit(spark, sf_dir):
    return rounded(S.ar_fit(measurements(spark, sf_dir), 1).select("series", F.col("phi")[0].alias("phi"), "sigma_e"))


@query(f"WITH {_AR}, j AS (SELECT l.series, pos, d - phi * coalesce(l1, 0) AS e, se FROM l JOIN f USING (series)) {_points('series, pos', 'j', 'e', '0.0', '-3 * se', '3 * se')}")
def ar_residual_chart(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return rounded(S.ar_residual_chart(m, S.ar_fit(m, 1), 1))


@query(f"""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS s, avg(value) AS v FROM events GROUP BY ALL),
x AS (SELECT *, avg(v) OVER (PARTITION BY day) AS t, avg(v) OVER (PARTITION BY s) AS sm, avg(v) OVER () AS mu FROM c),
a AS (SELECT count(DISTINCT day) AS n, count(DISTINCT s) AS k, any_value(mu) AS mu, sum((v - t - sm + mu) ^ 2) AS sse, var_pop(t) AS tv FROM x),
w AS (SELECT *, sse / ((n - 1) * (k - 1)) AS w FROM a)
SELECT n, k, {r("mu")}, {r("sqrt(w)", "sigma_within")}, {r("sqrt(greatest(0, (tv * n * k / (n - 1) - w) / k))", "sigma_time")} FROM w""")
def stream_anova(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return rounded(S.stream_anova(rows, "day", "event_type"))


def _with_targets_rounded(out):
    """Four digits of the targets: those of the SQL come from integrals over lists."""
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("p_target", "pk_target")}))


def _raised(rows: str, base: str) -> str:
    """CTEs `sizes` and `solved` with the chi-square points of the sizes in `rows`, which has n and `base`, and of the base sizes."""
    return f"""sizes AS (SELECT n, 0.9999 AS target FROM {rows} WHERE n < {base} AND n > 1 UNION SELECT {base}, 0.9999 FROM {rows}),
{solved("sizes", "n", chi2_tail_large("x", "(n - 1)"))}"""


def _study(m: str, lsl: float, usl: float, stage: str, cls: str, name: str) -> str:
    base, (p, pk) = A.BASE_SIZE[stage], A.TARGETS[stage][cls]
    width = "1.959963984540054 * sqrt(1 / (9 * n) + pk ^ 2 / (2 * (n - 1)))"
    return f"""WITH RECURSIVE {m}{G.removeprefix(M)}, e AS (SELECT series, avg(mean) AS mu, avg(sd) AS sb, sqrt(avg(var)) AS sr FROM g GROUP BY series),
x AS (SELECT g.series, count(*) AS n, count(*) FILTER (WHERE abs(mean - mu) > {_H!r} * sr) AS la, count(*) FILTER (WHERE sd > {_S[1]!r} * sr OR sd < {_S[0]!r} * sr) AS va FROM g JOIN e USING (series) GROUP BY g.series),
t AS (SELECT k, min(i) FILTER (WHERE cdf >= 0.99) AS threshold FROM (SELECT k, i, sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + i * ln({ALPHA!r}) + (k - i) * ln(1 - {ALPHA!r}))) OVER (PARTITION BY k ORDER BY i) AS cdf
  FROM (SELECT DISTINCT 2 * n AS k FROM x), range(60) r(i) WHERE i <= k) GROUP BY k),
v AS (SELECT m.series, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM m JOIN g ON m.series = g.series AND m.pos // 5 = g.ord // 5 GROUP BY m.series),
i AS (SELECT series, n, {usl - lsl} / (6 * s) AS p, least((mean - {lsl}) / (3 * s), ({usl} - mean) / (3 * s)) AS pk FROM v),
c AS (SELECT *, pk - {width} AS pl, pk + {width} AS ph, {base} AS base FROM i),
{_raised("c", "base")},
w AS (SELECT c.*, CASE WHEN c.n >= base THEN 1 ELSE sqrt(b.x / (base - 1) / (o.x / (c.n - 1))) END AS f FROM c JOIN solved b ON b.n = base LEFT JOIN solved o ON o.n = c.n)
SELECT series, la AS location_alarms, va AS variation_alarms, CAST(threshold AS INT) AS threshold, la + va <= threshold AS stable, CASE WHEN la + va <= threshold THEN 'unknown' ELSE 'unstable' END AS stability, '{name}' AS index_name,
w.n, {r("p")}, {r("pk")}, {r("pl", "pk_low")}, {r("ph", "pk_high")}, {r(f"{p} * f", "p_target", 4)}, {r(f"{pk} * f", "pk_target", 4)}, CASE WHEN w.n >= base THEN 'table' ELSE 'raised' END AS target_state,
CASE WHEN pk < {pk} * f THEN 'fails' WHEN pl >= {pk} * f THEN 'meets' ELSE 'meets_estimate_only' END AS verdict
FROM x JOIN t ON t.k = 2 * x.n JOIN w USING (series)"""


@query(_study(M, 5.0, 150.0, "production", "major", "Ppk"))
def process_analysis(spark, sf_dir):
    """The whole study of each series: chart, stability, indices, targets, verdict."""
    return _with_targets_rounded(A.analyse(measurements(spark, sf_dir), 5, 5.0, 150.0))


@query(_study("m AS (SELECT CAST(l_partkey AS VARCHAR) AS series, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS pos, l_quantity::DOUBLE AS value FROM lineitem)", -60.0, 110.0, "machine", "minor", "Pmk"))
def small_machine_studies(spark, sf_dir):
    """A study of each part's few values, against targets raised for their number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("series"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")).alias("line"), F.col("l_quantity").cast("double").alias("value"))
    return _with_targets_rounded(A.analyse(with_position(rows, "series", "line"), 5, -60.0, 110.0, stage="machine", cls="minor"))


_LINE_STUDIES = """s AS (SELECT l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'machine' WHEN 1 THEN 'preliminary' ELSE 'production' END AS stage,
  CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' WHEN 3 THEN 'others' END AS class, count(*) AS n FROM lineitem GROUP BY l_partkey)"""
_AGREED = ", ".join(f"('{stage}', '{c}', {p}, {pk}, {A.BASE_SIZE[stage]})" for stage, classes in A.TARGETS.items() for c, (p, pk) in classes.items())


@query(f"""WITH RECURSIVE {_LINE_STUDIES}, a(stage, class, p, pk, base) AS (VALUES {_AGREED}), j AS (SELECT s.*, p, pk, base FROM s LEFT JOIN a USING (stage, class)), j2 AS (SELECT n, base FROM j WHERE base IS NOT NULL),
{_raised("j2", "base")},
w AS (SELECT j.*, CASE WHEN base IS NULL THEN 'unknown' WHEN j.n >= base THEN 'table' WHEN stage = 'machine' AND class = 'critical' OR j.n < 2 THEN 'too_few' ELSE 'raised' END AS target_state,
  sqrt(b.x / (base - 1) / (o.x / (j.n - 1))) AS f, (1 + 1 / (2.0 * j.n)) / (1 + 1 / (2.0 * base)) AS g FROM j LEFT JOIN solved b ON b.n = base LEFT JOIN solved o ON o.n = j.n)
SELECT l_partkey AS part, stage, class, n, target_state, round(CASE target_state WHEN 'table' THEN p WHEN 'raised' THEN p * f END, 4) AS p_target, round(CASE target_state WHEN 'table' THEN pk WHEN 'raised' THEN pk * f * g END, 4) AS pk_target FROM w""")
def targets_by_size(spark, sf_dir):
    """Targets for the lines of every part, by stage, class and number, with the bias term."""
    k = F.col("l_partkey")
    studies = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).select(
        k.alias("part"), F.element_at(F.array(*map(F.lit, A.TARGETS)), (k % 3 + 1).cast("int")).alias("stage"),
        F.when(k % 5 < 4, F.element_at(F.array(*map(F.lit, A.TARGETS["machine"])), F.least(k % 5 + 1, F.lit(4)).cast("int"))).alias("class"), "n",
    )
    return rounded(A.with_targets(studies, bias_term=True), 4)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("series"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


_V = """v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id AS pos, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
e AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM v),
w AS (SELECT i, pos, (a - ma) / sqrt(va) AS x, ((b - mb) - c / va * (a - ma)) / sqrt(vb - c * c / va) AS y FROM v, e)"""


@query(f"""WITH RECURSIVE {_V}, z AS (SELECT i, pos, 0.1 * x AS zx, 0.1 * y AS zy, 1 AS t, (0.01 * (x * x + y * y)) / (0.1 / 1.9 * (1 - 0.9 ^ 2)) AS q FROM w WHERE i = 1
  UNION ALL SELECT w.i, w.pos, 0.1 * x + 0.9 * k * zx, 0.1 * y + 0.9 * k * zy, 1 + k * t, ((0.1 * x + 0.9 * k * zx) ^ 2 + (0.1 * y + 0.9 * k * zy) ^ 2) / (0.1 / 1.9 * (1 - 0.9 ^ (2 * (1 + k * t))))
  FROM (SELECT *, CASE WHEN q > 8.66 THEN 0 ELSE 1 END AS k FROM z) z JOIN w ON w.i = z.i + 1)
SELECT 'all' AS series, pos, {r("q", "statistic")}, q > 8.66 AS signal FROM z""")
def mewma_chart(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    _, mean, cov = S.vector_moments(rows, 2)
    return rounded(S.mewma(rows, mean, cov))


@query(f"""WITH RECURSIVE {_V}, z AS (SELECT i, pos, x * f AS sx, y * f AS sy, sqrt(x * x + y * y) * f AS q FROM (SELECT *, CASE WHEN x * x + y * y > 0.25 THEN 1 - 0.5 / sqrt(x * x + y * y) ELSE 0 END AS f FROM w WHERE i = 1)
  UNION ALL SELECT i, pos, vx * f, vy * f, sqrt(vx * vx + vy * vy) * f FROM (SELECT *, CASE WHEN vx * vx + vy * vy > 0.25 THEN 1 - 0.5 / sqrt(vx * vx + vy * vy) ELSE 0 END AS f
    FROM (SELECT w.i, w.pos, w.x + CASE WHEN q > 5.5 THEN 0 ELSE sx END AS vx, w.y + CASE WHEN q > 5.5 THEN 0 ELSE sy END AS vy FROM z JOIN w ON w.i = z.i + 1)))
SELECT 'all' AS series, pos, {r("q", "statistic")}, q > 5.5 AS signal FROM z""")
def mcusum_chart(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    _, mean, cov = S.vector_moments(rows, 2)
    return rounded(S.mcusum(rows, mean, cov))
