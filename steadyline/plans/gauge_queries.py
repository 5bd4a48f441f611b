"""Queries over whole gauge verdicts, agreement, streams measured together, samples, and indices of fitted families."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from steadyline.functions.numeric import sidak, upper_u
from steadyline.operators import gauges as U
from steadyline.operators import sequential as S
from steadyline.operators import studies as T

from .inputs import M, measurements, query, r, rounded, table
from .study_queries import _STATES, _gauge, _states
from .tail_sql import chi2_tail, f_tail, normal_tail

# -- Measurement systems -----------------------------------------------------------

_CELLS = """c AS (SELECT l_linenumber AS part, l_returnflag AS op, count(*) AS r, avg(l_quantity::DOUBLE) AS m, var_samp(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
p AS (SELECT var_pop(m) AS vp, count(*) AS p FROM (SELECT avg(m) AS m FROM c GROUP BY part)), o AS (SELECT var_pop(m) AS vo, count(*) AS o FROM (SELECT avg(m) AS m FROM c GROUP BY op)),
a AS (SELECT count(*) / sum(1 / r) AS r, var_pop(m) AS vc, count(*) AS cells, sum((r - 1) * v) AS se, sum(r) AS rows FROM c),
s AS (SELECT p, o, r, vp * p * o * r / (p - 1) AS mp, vo * p * o * r / (o - 1) AS mo, greatest(0, (vc - vp - vo) * p * o * r) AS si, se, (p - 1) * (o - 1) AS di, (rows - cells)::DOUBLE AS de FROM p, o, a),
t AS (SELECT *, si / di AS mi, se / de AS me FROM s)"""


@query(f"""WITH {_CELLS}, u AS (SELECT *, {f_tail("(mi / me)", "di", "de")} AS chance FROM t), w AS (SELECT *, chance > 0.25 AS pooled, CASE WHEN chance > 0.25 THEN (si + se) / (di + de) ELSE me END AS ev FROM u),
x AS (SELECT *, CASE WHEN pooled THEN ev ELSE mi END AS base, CASE WHEN pooled THEN 0 ELSE greatest(0, (mi - me) / r) END AS inter FROM w),
y AS (SELECT *, greatest(0, (mo - base) / (p * r)) AS av, greatest(0, (mp - base) / (o * r)) AS pv FROM x), z AS (SELECT *, ev + av + inter AS g FROM y),
k AS (SELECT *, 100 * sqrt(g / (g + pv)) AS tv_share, 600 * sqrt(g) / 400 AS tol_share, 1.41 * sqrt(pv / g) AS ndc FROM z)
SELECT p AS parts, o AS operators, {r("r", "trials", 4)}, pooled, {r("chance", "interaction_p", 5)}, {r("mp", "ms_parts", 4)}, {r("mo", "ms_operators", 4)}, {r("mi", "ms_interaction", 4)}, {r("me", "ms_error", 4)}, {r("sqrt(ev)", "ev", 4)}, {r("sqrt(av)", "av", 4)},
{r("sqrt(inter)", "interaction", 4)}, {r("sqrt(g)", "grr", 4)}, {r("sqrt(pv)", "pv", 4)}, {r("sqrt(g + pv)", "tv", 4)}, {r("tv_share", "pct_tv", 4)}, {r("tol_share", "pct_tol", 4)}, {r("ndc", "ndc", 4)},
CASE WHEN tol_share > 30 OR ndc < 2 THEN 'fail' WHEN tol_share > 10 OR ndc < 5 THEN 'conditional' ELSE 'pass' END AS verdict FROM k""")
def gauge_verdict(spark, sf_dir):
    out = U.gauge_verdict(_gauge(spark, sf_dir), "part", "op", tolerance=400.0)
    return rounded(out.withColumns({c: F.round(c, 4) for c, kind in out.dtypes if kind == "double" and c != "interaction_p"}), 5)


_RATED = "j AS (SELECT 'a' || (doc_id % 3) AS who, doc_id // 9 AS part, (doc_id // 3) % 3 AS trial, quality AS d, CAST((doc_id // 9) % 4 > 0 AS INT) AS ref FROM labels)"


@query(f"""WITH {_RATED}, w AS (SELECT part, trial, max(ref) AS reference, max(d) FILTER (WHERE who = 'a0') AS a0, max(d) FILTER (WHERE who = 'a1') AS a1, max(d) FILTER (WHERE who = 'a2') AS a2 FROM j GROUP BY ALL),
e AS (SELECT 'a0' AS a, 'a1' AS b, a0 AS x, a1 AS y FROM w UNION ALL SELECT 'a0', 'a2', a0, a2 FROM w UNION ALL SELECT 'a1', 'a2', a1, a2 FROM w
  UNION ALL SELECT 'a0', 'reference', a0, reference FROM w UNION ALL SELECT 'a1', 'reference', a1, reference FROM w UNION ALL SELECT 'a2', 'reference', a2, reference FROM w),
s AS (SELECT a, b, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM e WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
k AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM s)
SELECT a, b, n, {r("po", "agreement")}, {r("kappa")}, CASE WHEN kappa >= 0.75 THEN 'pass' WHEN kappa >= 0.4 THEN 'conditional' ELSE 'fail' END AS grade FROM k""")
def appraiser_kappas(spark, sf_dir):
    i, part = F.col("doc_id"), F.floor(F.col("doc_id") / 9)
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("a"), i % 3).alias("appraiser"), part.alias("part"), (F.floor(i / 3) % 3).alias("trial"), F.col("quality").alias("decision"), (part % 4 > 0).cast("int").alias("reference"))
    return rounded(U.appraiser_kappas(rows))


@query("""WITH s AS (SELECT o_custkey AS sys, o_orderpriority AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'conditional' ELSE 'pass' END AS verdict, 12 + 24 * (o_orderkey % 4) AS months, o_orderkey % 7 = 0 AS voided FROM orders),
l AS (SELECT * FROM s WHERE NOT voided QUALIFY row_number() OVER (PARTITION BY sys, kind ORDER BY d DESC, id DESC) = 1),
q AS (SELECT c_custkey AS sys, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS kind FROM customer),
w AS (SELECT c_custkey AS sys, '1-URGENT' AS kind, CAST(CASE WHEN c_custkey % 6 = 0 THEN '1997-01-01' ELSE '1999-01-01' END AS DATE) AS until FROM customer WHERE c_custkey % 3 = 0),
e AS (SELECT q.sys, l.sys IS NULL AS missing, w.until, CASE WHEN l.sys IS NULL OR d + to_months(CAST(months AS INT)) < DATE '1998-01-01' THEN 'block' ELSE verdict END AS st FROM q LEFT JOIN l ON q.sys = l.sys AND q.kind = l.kind LEFT JOIN w ON q.sys = w.sys AND q.kind = w.kind),
f AS (SELECT sys, missing, CASE WHEN st = 'block' AND until >= DATE '1998-01-01' THEN 'waived' ELSE st END AS st FROM e)
SELECT sys AS system, CASE WHEN bool_or(st = 'block') THEN 'block' WHEN bool_or(st IN ('waived', 'conditional')) THEN 'conditional' ELSE 'pass' END AS gate, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE st = 'waived') AS waived FROM f GROUP BY sys""")
def gate_of_required(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    studies = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("system"), F.col("o_orderpriority").alias("kind"), k.alias("id"), F.col("o_orderdate").cast("date").alias("date"),
        F.when(k % 5 == 0, "block").when(k % 5 == 1, "conditional").otherwise("pass").alias("verdict"), (12 + 24 * (k % 4)).cast("int").alias("months"), (k % 7 == 0).alias("voided"),
    )
    customers = table(spark, sf_dir, "customer")
    waivers = customers.filter(c % 3 == 0).select(c.alias("system"), F.lit("1-URGENT").alias("kind"), F.when(c % 6 == 0, "1997-01-01").otherwise("1999-01-01").cast("date").alias("until"))
    return U.gate_of_required(studies, customers.select(c.alias("system")), ["1-URGENT", "2-HIGH", "3-MEDIUM"], waivers, "1998-01-01")


@query(f"""WITH s AS (SELECT p_size AS st, max(900 + 10 * p_size)::DOUBLE AS ref, count(*) AS n, avg(p_retailprice::DOUBLE) - max(900 + 10 * p_size) AS off, var_samp(p_retailprice::DOUBLE) AS v FROM part GROUP BY 1),
w AS (SELECT off, ref FROM s ORDER BY abs(off) DESC, st LIMIT 1)
SELECT (SELECT count(*) FROM s) AS standards, (SELECT CAST(sum(n) AS BIGINT) FROM s) AS n, {r("(SELECT sqrt(avg(v)) FROM s)", "u_evr")}, {r("off", "bias")}, {r("ref", "bias_standard")}, {r("abs(off) / sqrt(3)", "u_bi")}, (SELECT max(v) > 4 * min(v) FROM s) AS variances_differ FROM w""")
def repeated_standards(spark, sf_dir):
    size = F.col("p_size")
    return rounded(U.repeated_standards(table(spark, sf_dir, "part").select(size.alias("standard"), (900 + 10 * size).cast("double").alias("reference"), F.col("p_retailprice").cast("double").alias("value"))))


# -- Streams measured together ---------------------------------------------------------

_K = 5


def _half(k: str) -> str:
    return f"{upper_u(0.0027)!r} * sqrt(sw * sw / {k} + st * st)"


@query(f"""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS stream, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT avg(v) AS mu, count(DISTINCT day) AS n, count(DISTINCT stream) AS k FROM c),
t AS (SELECT day, avg(v) AS tm, count(*) AS c FROM c GROUP BY 1), o AS (SELECT stream, avg(v) AS sm FROM c GROUP BY 1),
q AS (SELECT sum((v - tm - sm + mu) ^ 2) AS sse, var_pop(tm) AS tv, max(mu) AS mu, max(n) AS n, max(k) AS k FROM c JOIN t USING (day) JOIN o USING (stream), g),
l AS (SELECT mu, k, sqrt(sse / ((n - 1) * (k - 1))) AS sw, sqrt(greatest(0, (tv * n * k / (n - 1) - sse / ((n - 1) * (k - 1))) / k)) AS st FROM q),
f AS (SELECT stream, sm - (SELECT avg(sm) FROM o) AS off FROM o),
z AS (SELECT day, tm, stream, (v - tm - off) / (sw * sqrt((k - 1) / k)) AS z, mu, k, sw, st FROM c JOIN t USING (day) JOIN f USING (stream), l WHERE t.c = k)
SELECT day, {r("max(tm)", "mean", 5)}, {r("max(abs(z))", "top", 5)}, arg_max(stream, abs(z)) AS stream, abs(max(tm) - max(mu)) > max({_half("k")}) AS level_alarm, max(abs(z)) > {sidak(0.0027, _K)!r} AS stream_alarm FROM z GROUP BY day""")
def multistream_points(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    means = rows.groupBy("day", "event_type").agg(F.avg("value").alias("v")).groupBy("event_type").agg(F.avg("v").alias("m"))
    offsets = means.join(F.broadcast(means.agg(F.avg("m").alias("all")))).select("event_type", (F.col("m") - F.col("all")).alias("offset"))  # one row
    return rounded(U.multistream_points(rows, "day", "event_type", S.stream_anova(rows, "day", "event_type"), offsets), 5)


# -- Samples ---------------------------------------------------------------------------

_KINDS = ("xbar-s", "xbar-r", "median-r", "p", "np", "c", "u", "imr")
_SAMPLES = f"""s AS (SELECT l_orderkey AS o, list(l_quantity::DOUBLE - CASE WHEN l_orderkey % 11 = 0 THEN 30 ELSE 0 END ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1),
k AS (SELECT o, v, CASE o % 8 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind, 4 AS n FROM s),
b AS (SELECT *, len(v) <> CASE WHEN kind IN ('p', 'u') THEN 2 WHEN kind IN ('xbar-s', 'xbar-r', 'median-r') THEN n ELSE 1 END AS wrong,
  kind IN ('p', 'np', 'c', 'u') AND coalesce(v[1] < 0 OR v[1] <> floor(v[1]) OR (kind IN ('p', 'u') AND v[2] <= 0) OR (kind = 'p' AND (v[2] <> floor(v[2]) OR v[1] > v[2])) OR (kind = 'np' AND v[1] > n), false) AS bad FROM k)"""


def _samples(spark, sf_dir):
    q = F.col("l_quantity").cast("double") - F.when(F.col("l_orderkey") % 11 == 0, 30.0).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", q.alias("q")))).alias("v"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_orderkey") % 8 + 1).cast("int"))
    return lines.select(F.col("l_orderkey").alias("sample"), kind.alias("kind"), F.lit(4).alias("n"), F.col("v.q").alias("values"), (F.col("l_orderkey") % 50).cast("double").alias("previous"))


@query(f"""WITH {_SAMPLES} SELECT o AS sample, kind, CASE WHEN wrong THEN 'wrong_value_count' WHEN bad THEN 'bad_count' END AS problem FROM b""")
def sample_checks(spark, sf_dir):
    return _samples(spark, sf_dir).select("sample", "kind", U.sample_check(F.col("kind"), F.col("n"), F.col("values")).alias("problem"))


@query(f"""WITH {_SAMPLES} SELECT o AS sample, kind, CASE WHEN wrong THEN 'wrong_value_count' WHEN bad THEN 'bad_count' END AS problem,
CASE WHEN wrong OR bad THEN NULL ELSE {r("CASE WHEN kind IN ('p', 'u') THEN v[1] / v[2] WHEN kind = 'median-r' THEN list_aggregate(v, 'median') WHEN kind IN ('xbar-s', 'xbar-r') THEN list_avg(v) ELSE v[1] END", "x").removesuffix(" AS x")} END AS location,
CASE WHEN wrong OR bad THEN NULL ELSE {r("CASE WHEN kind = 'imr' THEN abs(v[1] - o % 50) WHEN kind = 'xbar-s' THEN list_aggregate(v, 'stddev_samp') WHEN kind IN ('xbar-r', 'median-r') THEN list_max(v) - list_min(v) END", "x").removesuffix(" AS x")} END AS variation FROM b""")
def sample_statistics(spark, sf_dir):
    return rounded(U.sample_statistics(_samples(spark, sf_dir)).select("sample", "kind", "problem", "location", "variation"))


_LOTS = f"{M}, l AS (SELECT series, pos, 'lot ' || pos // 300 AS lot FROM m WHERE pos % 300 = 0), a AS (SELECT series, pos FROM m WHERE pos % 700 = 41)"


@query(f"""WITH {_LOTS}, n AS (SELECT *, lead(pos) OVER (PARTITION BY series ORDER BY pos) AS nxt FROM l), f AS (SELECT n.series, n.pos, n.lot, max(nxt) AS nxt, min(a.pos) AS approved_at FROM n LEFT JOIN a ON a.series = n.series AND a.pos >= n.pos AND (nxt IS NULL OR a.pos < nxt) GROUP BY ALL)
SELECT series, pos, lot, approved_at, CASE WHEN approved_at IS NOT NULL THEN 'released' WHEN nxt IS NULL THEN 'pending' ELSE 'missed' END AS state FROM f""")
def first_articles(spark, sf_dir):
    m = measurements(spark, sf_dir)
    lots = m.filter("pos % 300 = 0").select("series", "pos", F.concat(F.lit("lot "), F.floor(F.col("pos") / 300).cast("string")).alias("lot"))
    return U.first_articles(lots, m.filter("pos % 700 = 41").select("series", "pos"))


@query(f"""WITH {M}, c AS (SELECT series, CASE WHEN series < 'l' THEN max(pos) - 20 ELSE max(pos) // 2 END AS after_pos FROM m GROUP BY 1),
s AS (SELECT series, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (WHERE value > 400) AS alarms FROM m JOIN c USING (series) WHERE pos > after_pos GROUP BY series),
i AS (SELECT *, 500 / (6 * sd) AS pp, least((mean + 50) / (3 * sd), (450 - mean) / (3 * sd)) AS ppk FROM s)
SELECT series, n, {r("pp")}, {r("ppk")}, alarms, CASE WHEN n < 25 THEN 'too_few' WHEN alarms > 0 THEN 'unstable' WHEN ppk >= 0.3 THEN 'met' ELSE 'not_met' END AS state FROM i""")
def after_improvement(spark, sf_dir):
    m = measurements(spark, sf_dir)
    last = F.max("pos")
    changes = m.groupBy("series").agg(last.alias("last")).select("series", F.when(F.col("series") < "l", F.col("last") - 20).otherwise(F.floor(F.col("last") / 2)).alias("after_pos"))
    return rounded(U.after_improvement(m.withColumn("alarm", F.col("value") > 400), changes, -50.0, 450.0, 0.3))


# -- Characteristics of another system ---------------------------------------------------


@query("""WITH x AS (SELECT l_returnflag AS characteristic, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS line, unnest([0, 1, 2]) AS j, unnest([l_quantity::DOUBLE, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_extendedprice::DOUBLE END, l_tax::DOUBLE]) AS value FROM lineitem)
SELECT characteristic, line, 'row ' || line AS subgroup, j, value FROM x WHERE value IS NOT NULL""")
def wide_series(spark, sf_dir):
    return U.wide_series(_wide(spark, sf_dir), "l_returnflag", "line", ["a", "b", "c"])


def _wide(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_returnflag", ((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") <= 5, F.col("l_extendedprice")).alias("b"), F.col("l_tax").alias("c"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("lo"), F.col("l_linenumber").alias("hi"))


@query("""WITH x AS (SELECT l_returnflag AS characteristic, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS line, 2 + CAST(l_linenumber <= 5 AS INT) AS filled, CASE WHEN l_linenumber <> 3 THEN l_discount::DOUBLE END AS lo, l_linenumber::DOUBLE AS hi FROM lineitem)
SELECT characteristic, count(*) AS lines, CAST(sum(filled) AS BIGINT) AS values, count(*) FILTER (WHERE filled = 0) AS skipped, arg_max(lo, line) FILTER (WHERE lo IS NOT NULL) AS lsl, count(DISTINCT lo) AS lsl_changes, arg_max(hi, line) AS usl, count(DISTINCT hi) AS usl_changes FROM x GROUP BY 1""")
def series_facts(spark, sf_dir):
    return U.series_facts(_wide(spark, sf_dir), "l_returnflag", "line", ["a", "b", "c"], {"lsl": "lo", "usl": "hi"})


# -- Indices of fitted families ----------------------------------------------------------

_L, _H = 1.0, 900.0


def _family(name: str, fit: str, low: float, high: float, x) -> str:
    zl, zu = f"((m - {low!r}) / s)", f"(({high!r} - m) / s)"
    a, b, c = x(-U.SPAN), x(0.0), x(U.SPAN)
    tail = lambda z: f"(CASE WHEN {z} >= 0 THEN {normal_tail(f'abs({z})')} ELSE 1 - {normal_tail(f'abs({z})')} END)"
    return f"""SELECT series, '{name}' AS family, {r(f"{_H - _L!r} / ({c} - {a})", "p_g", 5)}, {r(f"least(({_H!r} - {b}) / ({c} - {b}), ({b} - {_L!r}) / ({b} - {a}))", "pk_g", 5)}, {r(f"(least({zl}, 37) + least({zu}, 37)) / 6", "p_z", 5)}, {r(f"least({zl}, {zu}, 37) / 3", "pk_z", 5)},
{r(f"1e6 * ({tail(zl)} + {tail(zu)})", "ppm", 2)} FROM {fit} WHERE s > 0"""


@query(f"""WITH n AS (SELECT event_type AS series, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), g AS (SELECT event_type AS series, avg(ln(value + 1)) AS m, stddev_pop(ln(value + 1)) AS s FROM events GROUP BY 1 HAVING min(value) > -1),
n1 AS (SELECT series, m + 1 AS m, s FROM n)
{_family("normal", "n1", _L, _H, lambda z: f"(m + {z!r} * s)")} UNION ALL {_family("lognormal", "g", math.log(_L), math.log(_H), lambda z: f"exp(m + {z!r} * s)")}""")
def family_indices(spark, sf_dir):
    out = U.family_indices(table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), (F.col("value") + 1).alias("value")), _L, _H)
    return rounded(out.withColumn("ppm", F.round("ppm", 2)), 5)


# -- States and experiments --------------------------------------------------------------


_STATE_TESTS = f"""{_STATES}, g AS (SELECT * FROM s WHERE n > 2 AND var > 0),
b AS (SELECT count(*) AS k, sum(n - 1) AS f, sum((n - 1) * var) AS ss, sum((n - 1) * ln(var)) AS lg, sum(1 / (n - 1)) AS inv FROM g),
v AS (SELECT k - 1 AS df, (f * ln(ss / f) - lg) / (1 + (inv - 1 / f) / (3 * (k - 1))) AS x FROM b),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) AS s, sum(n * mean * mean) AS q, sum((n - 1) * var) AS w FROM g),
t AS (SELECT k, n - k AS dw, ((q - s * s / n) / (k - 1)) / (w / (n - k)) AS f FROM a)"""


@query(f"""WITH {_STATE_TESTS} SELECT 'variances' AS test, {r("x", "statistic", 4)}, df::DOUBLE AS df, {r(chi2_tail("x", "df"), "p", 5)} FROM v
UNION ALL SELECT 'means', {r("f", "statistic", 4)}, (k - 1)::DOUBLE, {r(f_tail("f", "(k - 1)", "dw"), "p", 5)} FROM t""")
def state_tests(spark, sf_dir):
    return T.state_tests(_states(spark, sf_dir)).select("test", (F.round("statistic", 4) + 0.0).alias("statistic"), "df", (F.round("p", 5) + 0.0).alias("p"))


_DESIGN = "x AS (SELECT l_extendedprice::DOUBLE AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS a, CASE WHEN l_linenumber > 3 THEN 1 ELSE -1 END AS b, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS c FROM lineitem)"
_TERMS = ("a", "b", "c", "ab", "ac", "bc", "abc")


@query(f"""WITH {_DESIGN}, g AS (SELECT a, b, c, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM x GROUP BY ALL), e AS (SELECT sum((n - 1) * v) / sum(n - 1) AS s2, sum(n - 1) AS df, sum(1 / n) AS inv FROM g),
w AS ({" UNION ALL ".join(f"SELECT '{':'.join(t)}' AS term, 2 * avg({' * '.join(t)} * m) AS effect FROM g" for t in _TERMS)}), f AS (SELECT term, effect, effect ^ 2 / (4 * s2 * inv / 64) AS f, df FROM w, e)
SELECT term, {r("effect", "effect", 3)}, {r("f", "f", 3)}, {r(f_tail("f", "1", "df"), "p", 5)} FROM f""")
def replicated_effects(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    rows = x.select(F.col("l_extendedprice").cast("double").alias("y"), sign(F.col("l_quantity") > 25).alias("a"), sign(F.col("l_linenumber") > 3).alias("b"), sign(F.col("l_linestatus") == "O").alias("c"))
    return U.replicated_effects(rows, "y", ["a", "b", "c"]).select("term", *((F.round(c, k) + 0.0).alias(c) for c, k in (("effect", 3), ("f", 3), ("p", 5))))


@query(f"""WITH {M}, d AS (SELECT series, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM m WINDOW w AS (PARTITION BY series ORDER BY pos)),
s AS (SELECT series, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d WHERE x IS NOT NULL GROUP BY 1),
t AS (SELECT *, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t FROM s) SELECT series, n, {r("b", "gamma")}, {r("t", "t", 5)}, t > -2.86 AS unit_root FROM t""")
def unit_root_test(spark, sf_dir):
    return rounded(U.unit_root_t(measurements(spark, sf_dir)).withColumn("t", F.round("t", 5)))


@query(f"""WITH x AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), c AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, covar_pop(a, b) AS vab, var_pop(b) AS vb FROM x),
z AS (SELECT (a - ma) / sqrt(va) AS u, ((b - mb) - vab / va * (a - ma)) / sqrt(vb - vab * vab / va) AS v, n FROM x, c), m AS (SELECT max(n) AS n, avg(u ^ 3) AS m0, avg(u * u * v) AS m1, avg(u * v * v) AS m2, avg(v ^ 3) AS m3 FROM z),
b AS (SELECT n, m0 ^ 2 + 3 * m1 ^ 2 + 3 * m2 ^ 2 + m3 ^ 2 AS b1 FROM m) SELECT n, {r("b1")}, {r("n * b1 / 6", "chi2", 4)}, 4 AS df FROM b""")
def mardia_skewness(spark, sf_dir):
    out = U.mardia_skewness(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")), 2)
    return rounded(out.withColumn("chi2", F.round("chi2", 4)))
