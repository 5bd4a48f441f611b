"""Queries over monitored streams, equipment readings, incidents, lots, health checks and fits."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, d2, upper_u
from steadyline.operators import fits as Y
from steadyline.operators import health as H
from steadyline.operators import monitors as Q
from steadyline.operators.lineage import shared_folder
from steadyline.streaming import monitor as V

from .inputs import G, M, groups, measurements, query, r, rounded, table
from .tail_sql import f_tail, solved

U = upper_u(ALPHA)


@query(f"""WITH {M}, l AS (SELECT series, pos // 700 AS revision, avg(value) AS c, {U!r} * stddev_samp(value) AS h FROM m WHERE pos % 700 < 100 GROUP BY ALL)
SELECT series, pos, revision, value AS point, {r("c", "center")}, {r("c - h", "lcl")}, {r("c + h", "ucl")}, value > c + h OR value < c - h AS alarm FROM (SELECT *, pos // 700 AS revision FROM m) JOIN l USING (series, revision)""")
def fixed_limits_points(spark, sf_dir):
    """Limits are set anew from the first 100 values of every 700."""
    m = measurements(spark, sf_dir).withColumn("revision", F.floor(F.col("pos") / 700))
    s = m.filter("pos % 700 < 100").groupBy("series", "revision").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("sd"))
    limits = s.select("series", "revision", "center", (F.col("center") - U * F.col("sd")).alias("lcl"), (F.col("center") + U * F.col("sd")).alias("ucl"))
    return rounded(Q.fixed_chart(m.withColumnRenamed("value", "point"), limits))


@query(f"""WITH {M}, z AS (SELECT series, pos // 2 AS sample, pos, value, CASE WHEN value < 0 OR value > 200 THEN 'red' WHEN value < 50 THEN 'low' WHEN value > 150 THEN 'high' ELSE 'green' END AS z FROM m),
s AS (SELECT series, sample, count(*) AS n, arg_max(value, (abs(value - 100), -pos)) AS point, count(*) FILTER (WHERE z = 'red') AS red, count(*) FILTER (WHERE z = 'low') AS low, count(*) FILTER (WHERE z = 'high') AS high FROM z GROUP BY ALL)
SELECT series, sample, point, CASE WHEN red > 0 THEN 'pre_red' WHEN low = 2 OR high = 2 THEN 'pre_two_yellow_same_side' WHEN low + high = 2 THEN 'pre_two_yellow_opposite' WHEN low + high > 0 THEN 'yellow_zone' END AS rule FROM s WHERE n = 2""")
def precontrol_samples(spark, sf_dir):
    return Q.precontrol(measurements(spark, sf_dir), 0.0, 200.0)


@query(f"WITH {M} SELECT series, max(pos) - coalesce(max(pos) FILTER (WHERE value < 5 OR value > 150), -1) AS greens, max(pos) - coalesce(max(pos) FILTER (WHERE value < 5 OR value > 150), -1) >= 5 AS qualified FROM m GROUP BY series")
def precontrol_qualification(spark, sf_dir):
    return Q.qualified(measurements(spark, sf_dir), 5 - 145 / 2, 150 + 145 / 2)


@query(f"""WITH {M}, p AS (SELECT user_id % 7 AS part, avg(value) AS mu, stddev_samp(value) AS sigma FROM m WHERE user_id % 7 < 6 GROUP BY 1), x AS (SELECT series, pos, part, (value - mu) / sigma AS z FROM (SELECT *, user_id % 7 AS part FROM m) JOIN p USING (part))
SELECT series, pos, part, {r("z", "point")}, 0.0::DOUBLE AS center, {r(f"{-U!r}::DOUBLE", "lcl")}, {r(f"{U!r}::DOUBLE", "ucl")}, abs(z) > {U!r} AS alarm FROM x""")
def short_run_chart(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("part", F.col("user_id") % 7)
    parts = m.filter("part < 6").groupBy("part").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    return rounded(Q.zmr(m, parts))


def _readings(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("event_type").alias("node"), i.alias("serial"), F.when(i % 41 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"), (i % 53 != 0).alias("good"),
        F.when(i % 61 == 0, None).when(i % 29 == 0, F.expr("ts - interval 20 minutes")).when(i % 31 == 0, F.expr("ts - interval 2 hours")).when(i % 37 == 0, F.expr("ts + interval 10 minutes")).otherwise(F.col("ts")).alias("source_time"), F.col("ts").alias("arrived_at"),
    )


_READINGS = """x AS (SELECT event_type AS node, event_id AS serial, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS v, event_id % 53 <> 0 AS good, ts AS arrived,
  CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 29 = 0 THEN ts - INTERVAL 20 MINUTE WHEN event_id % 31 = 0 THEN ts - INTERVAL 2 HOUR WHEN event_id % 37 = 0 THEN ts + INTERVAL 10 MINUTE ELSE ts END AS src FROM events),
f AS (SELECT *, CASE WHEN NOT good THEN 'bad_quality' WHEN v IS NULL THEN 'not_numeric' WHEN src IS NULL THEN 'no_timestamp' WHEN src > arrived + INTERVAL 5 MINUTE THEN 'future' WHEN arrived - src > INTERVAL 1 HOUR THEN 'stale' END AS first FROM x),
g AS (SELECT *, coalesce(first, CASE WHEN src <= max(CASE WHEN first IS NULL THEN src END) OVER (PARTITION BY node ORDER BY serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'old_or_repeated' END) AS reason FROM f)"""


@query(f"WITH {_READINGS} SELECT node, serial, reason FROM g")
def reading_guards(spark, sf_dir):
    return Q.guarded_readings(_readings(spark, sf_dir)).select("node", "serial", "reason")


@query(f"""WITH {_READINGS}, a AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY serial) - 1) // 5 AS sample FROM g WHERE reason IS NULL)
SELECT node, sample, {r("avg(v)", "mean")} FROM a GROUP BY node, sample HAVING count(*) = 5""")
def reading_samples(spark, sf_dir):
    return rounded(Q.samples(Q.guarded_readings(_readings(spark, sf_dir)), 5).select("node", "sample", "mean"))


@query(f"""WITH {G}, l AS (SELECT series, avg(mean) AS mu, sqrt(avg(var)) AS sigma FROM g WHERE ord < 500 GROUP BY series), p AS (SELECT g.series, mean, sd, mu, sigma, abs(mean - mu) > {U!r} * sigma / sqrt(5) AS alarm FROM g JOIN l USING (series)),
s AS (SELECT series, count(*) AS points, count(*) FILTER (WHERE alarm) AS alarm_points, sqrt(avg(sd * sd)) / any_value(sigma) AS sigma_ratio, (avg(mean) - any_value(mu)) / (any_value(sigma) / sqrt(5)) AS shift FROM p GROUP BY series)
SELECT series, points, alarm_points, {r("sigma_ratio")}, {r("shift")}, CASE WHEN sigma_ratio < 0.8 THEN 'too_wide' WHEN sigma_ratio > 1.25 THEN 'too_narrow' WHEN abs(shift) > 1 THEN 'location_moved' WHEN alarm_points > greatest(3, 3 * {ALPHA!r} * points) THEN 'too_narrow' ELSE 'ok' END AS verdict FROM s""")
def limits_review(spark, sf_dir):
    g = groups(spark, sf_dir)
    limits = g.filter("ord < 500").groupBy("series").agg(F.avg("mean").alias("mu"), F.sqrt(F.avg("var")).alias("sigma"))
    points = g.join(limits, "series").withColumn("alarm", F.abs(F.col("mean") - F.col("mu")) > U * F.col("sigma") / math.sqrt(5))
    return rounded(Q.limits_review(points, ALPHA, 5))


@query(f"""WITH {M}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos DESC) AS rank FROM m), w AS (SELECT series, back, value FROM k, range(7) t(back) WHERE rank > back * 31 AND rank <= back * 31 + 125)
SELECT series, CAST(back AS INT) AS back, count(*) AS n, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "sd")} FROM w GROUP BY ALL""")
def rolling_report(spark, sf_dir):
    w = Q.rolling_windows(measurements(spark, sf_dir).select("series", "pos", "value"))
    return rounded(w.groupBy("series", "back").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")))


@query("""WITH i AS (SELECT o_orderpriority AS series, o_orderkey AS incident, o_orderdate::TIMESTAMP AS opened FROM orders),
e AS (SELECT l_orderkey AS k, min(l_shipdate::TIMESTAMP) FILTER (WHERE l_linenumber <= 2) AS ack, min(l_shipdate::TIMESTAMP) FILTER (WHERE l_linenumber IN (3, 4)) AS act, min(l_shipdate::TIMESTAMP) FILTER (WHERE l_linenumber > 4) AS cl FROM lineitem GROUP BY 1),
j AS (SELECT series, cl, epoch(ack)::BIGINT - epoch(opened)::BIGINT AS a, epoch(act)::BIGINT - epoch(opened)::BIGINT AS b, epoch(cl)::BIGINT - epoch(opened)::BIGINT AS c FROM i LEFT JOIN e ON k = incident)
SELECT series, count(*) AS incidents, count(*) FILTER (WHERE cl IS NULL) AS open, median(a) AS median_to_ack, max(a) AS longest_to_ack, median(b) AS median_to_action, max(b) AS longest_to_action, median(c) AS median_to_close, max(c) AS longest_to_close FROM j GROUP BY series""")
def response_times(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    incidents = o.select(F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("incident"), F.col("o_orderdate").cast("timestamp").alias("opened"))
    kind = F.when(F.col("l_linenumber") <= 2, "ack").when(F.col("l_linenumber") <= 4, "action").otherwise("close")
    events = li.select(F.col("l_orderkey").alias("incident"), kind.alias("kind"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return Q.response_times(incidents, events)


@query("""WITH e AS (SELECT l_orderkey AS k, max(l_shipdate) AS acted FROM lineitem WHERE l_linenumber IN (3, 4) GROUP BY 1),
c AS (SELECT o_orderpriority AS series, max(o_orderdate) AS last FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1)
SELECT o_orderpriority AS series, o_orderkey AS incident FROM orders JOIN e ON k = o_orderkey JOIN c ON series = o_orderpriority WHERE last >= acted""")
def recovered_incidents(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    incidents = o.select(F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("incident"))
    events = li.filter("l_linenumber in (3, 4)").select(F.col("l_orderkey").alias("incident"), F.lit("action").alias("kind"), F.col("l_shipdate").alias("at"))
    points = o.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 3 == 0).alias("alarm"))
    return Q.recovered(incidents, events, points)


@query(f"""WITH {M}, p AS (SELECT series, pos, value > 150 AS alarm FROM m), lots AS (SELECT DISTINCT series, pos // 90 AS lot, (pos // 90) * 90 AS a, (pos // 90) * 90 + 69 AS b FROM m)
SELECT l.series, lot, count(pos) AS points, count(*) FILTER (WHERE alarm) AS alarms, CASE WHEN count(pos) = 0 THEN 'no_points' WHEN count(*) FILTER (WHERE alarm) > 0 THEN 'blocked' ELSE 'free' END AS state
FROM lots l LEFT JOIN p ON p.series = l.series AND pos BETWEEN a AND b GROUP BY l.series, lot""")
def lot_evidence(spark, sf_dir):
    m = measurements(spark, sf_dir)
    lot = F.floor(F.col("pos") / 90)
    lots = m.select("series", lot.alias("lot")).distinct().select("series", "lot", (F.col("lot") * 90).alias("seq_from"), (F.col("lot") * 90 + 69).alias("seq_to"))
    return Q.lot_evidence(lots, m.select("series", "pos", (F.col("value") > 150).alias("alarm")))


@query(f"""WITH {M}, k AS (SELECT series, pos, event_id::VARCHAR AS mark FROM m WHERE user_id % 23 = 0)
SELECT m.series, m.pos, mark FROM m ASOF LEFT JOIN k ON m.series = k.series AND m.pos >= k.pos""")
def latest_cycle_mark(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return Q.latest_mark(m, m.filter("user_id % 23 = 0").select("series", "pos", F.col("event_id").alias("mark")))


@query(f"WITH {M} SELECT series, pos FROM m WHERE event_id % 500 = 3")
def audit_trail(spark, sf_dir):
    """A chain of entries of which some were changed afterwards."""
    m = measurements(spark, sf_dir)
    chained = Q.chain(m.select("series", "pos", F.concat_ws("|", "event_id", F.floor(F.col("value") * 100)).alias("body")))
    changed = chained.withColumn("body", F.when(F.substring_index("body", "|", 1).cast("long") % 500 == 3, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return Q.broken_links(changed)


# -- Streams -------------------------------------------------------------------------


def _arriving(spark, sf_dir, monitor):
    """The rows of a monitor over all events, which arrive in three batches."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("pos"), "value")
    return V.in_slices(events, "pos", 3, monitor, f"{shared_folder(spark.range(0))}/stream-{uuid.uuid4().hex}")


@query(f"""WITH RECURSIVE {M}, x AS (SELECT series, pos, event_id, (value - 50.0) / 50.0 AS z FROM m), c AS (SELECT series, pos, event_id, greatest(0, z - 0.5) AS h, least(0, z + 0.5) AS l FROM x WHERE pos = 0
  UNION ALL SELECT x.series, x.pos, x.event_id, greatest(0, CASE WHEN c.h > 4.774897046326059 OR -c.l > 4.774897046326059 THEN 0 ELSE c.h END + z - 0.5), least(0, CASE WHEN c.h > 4.774897046326059 OR -c.l > 4.774897046326059 THEN 0 ELSE c.l END + z + 0.5)
  FROM c JOIN x ON x.series = c.series AND x.pos = c.pos + 1)
SELECT series, event_id AS pos, {r("h", "high")}, {r("l", "low")}, CASE WHEN h > 4.774897046326059 THEN 'shift_up' WHEN -l > 4.774897046326059 THEN 'shift_down' END AS signal FROM c""")
def cusum_monitor_stream(spark, sf_dir):
    return rounded(_arriving(spark, sf_dir, lambda x: V.cusum_stream(x.withColumns({"mu": F.lit(50.0), "sigma": F.lit(50.0)}))))


@query(f"""WITH {M}, z AS (SELECT series, pos, event_id, value AS v, sign(value - 50) AS side, sign(value - lag(value) OVER (PARTITION BY series ORDER BY pos)) AS step FROM m),
f AS (SELECT series, event_id AS pos, v > 200 OR v < 0 AS beyond_limits, abs(sum(side) OVER (PARTITION BY series ORDER BY pos ROWS 6 PRECEDING)) = 7 AS run, abs(sum(step) OVER (PARTITION BY series ORDER BY pos ROWS 5 PRECEDING)) = 6 AS trend FROM z)
SELECT series, pos, rule FROM (UNPIVOT f ON beyond_limits, run, trend INTO NAME rule VALUE hit) WHERE hit""")
def limits_monitor_stream(spark, sf_dir):
    limits = {"revision": F.lit(1).cast("long"), "center": F.lit(50.0), "lcl": F.lit(0.0), "ucl": F.lit(200.0)}
    return _arriving(spark, sf_dir, lambda x: V.limits_stream(x.withColumns(limits)))


# -- Health check and fits --------------------------------------------------------------


def _limits(spark):
    rows = [("click", 0.0, 300.0, 10.0, 90.0), ("error", 0.0, 200.0, 0.0, 200.0), ("view", None, None, -100.0, 250.0), ("purchase", 0.0, 120.0, None, None), ("signup", 0.0, 500.0, None, 110.0)]
    return spark.createDataFrame(rows, "series string, lsl double, usl double, lcl double, ucl double")


def _health(spark, sf_dir):
    return H.facts(measurements(spark, sf_dir), groups(spark, sf_dir), 5, _limits(spark))


@query(f"""WITH {G}, o AS (SELECT series, count(*) AS n_values, avg(value) AS mean, stddev_samp(value) AS sd_total FROM m GROUP BY series)
SELECT o.series, n_values, {r("o.mean", "mean")}, {r("sd_total")}, count(*) AS k, {r("sqrt(avg(var))", "sigma_in")}, {r("stddev_samp(g.mean) * sqrt(5) / sqrt(avg(var))", "ratio")} FROM o JOIN g USING (series) GROUP BY ALL""")
def health_facts(spark, sf_dir):
    return rounded(_health(spark, sf_dir).select("series", "n_values", "mean", "sd_total", "k", "sigma_in", "ratio"))


SHOWN = f"""{G}, lim(series, lsl, usl, lcl, ucl) AS (VALUES ('click', 0.0, 300.0, 10.0, 90.0), ('error', 0.0, 200.0, 0.0, 200.0), ('view', NULL, NULL, -100.0, 250.0), ('purchase', 0.0, 120.0, NULL, NULL), ('signup', 0.0, 500.0, NULL, 110.0)),
o AS (SELECT series, avg(value) AS mean, stddev_samp(value) AS sd FROM m GROUP BY 1),
inr AS (SELECT g.series, count(*) AS k, avg(mean) AS centre, sqrt(avg(var)) AS sigma, var_samp(mean) AS vm, count(*) FILTER (WHERE mean < lcl OR mean > ucl) AS used FROM g LEFT JOIN lim USING (series) GROUP BY 1),
pre AS (SELECT series, row_number() OVER w AS i, sum(mean) OVER w AS lft, sum(mean) OVER (PARTITION BY series) AS al, count(*) OVER (PARTITION BY series) AS n FROM g WINDOW w AS (PARTITION BY series ORDER BY ord)),
spl AS (SELECT series, max((lft / i - (al - lft) / (n - i)) ^ 2 * i * (n - i) / n) AS score FROM pre WHERE i >= 5 AND n - i >= 5 GROUP BY 1),
isl AS (SELECT series, pos - row_number() OVER (PARTITION BY series, value ORDER BY pos) AS island, value AS v FROM m), lng AS (SELECT series, max(n) AS longest FROM (SELECT series, v, island, count(*) AS n FROM isl GROUP BY ALL) GROUP BY 1),
fit AS (SELECT series, k FROM m, range(7) t(k) GROUP BY 1, 2 HAVING bool_and(abs(value * 10 ^ k - round(value * 10 ^ k)) <= 1e-9 * greatest(1, abs(value * 10 ^ k)))), plc AS (SELECT series, min(k) AS k FROM fit GROUP BY 1),
stp AS (SELECT series, k, CAST(round(value * 10 ^ k) AS BIGINT) - min(CAST(round(value * 10 ^ k) AS BIGINT)) OVER (PARTITION BY series) AS step FROM m JOIN plc USING (series)),
res AS (SELECT series, list_reduce(list(DISTINCT step) FILTER (WHERE step > 0), lambda a, b: gcd(a, b)) / 10 ^ max(k) AS resolution FROM stp GROUP BY 1),
cnt AS (SELECT DISTINCT k, 0.001 AS target FROM inr WHERE k > 1), {solved("cnt", "k", f_tail("x", "(k - 1)", "(4 * k)"), 0.5, 60.0, 60)},
f1 AS (SELECT inr.*, lsl, usl, lcl, ucl, mean, sd, resolution, longest, sqrt(vm * 5) / sigma AS ratio, sqrt(greatest(0, vm * (inr.k - 1) - score) / (inr.k - 1) * 5) / sigma AS rest, x AS fc, {upper_u(ALPHA)!r} * sigma / sqrt(5) AS half
  FROM inr JOIN o USING (series) LEFT JOIN lim USING (series) LEFT JOIN spl USING (series) LEFT JOIN res USING (series) LEFT JOIN lng USING (series) LEFT JOIN solved ON solved.k = inr.k),
f2 AS (SELECT *, resolution / sd > 1 AS coarse, k >= 20 AS enough, k >= 20 AND ratio >= 1.5 AND ratio * ratio > fc AS unsteady, rest >= 1.5 AND rest * rest > fc AS still, lcl IS NOT NULL AND ucl IS NOT NULL AS has, (ucl - lcl) / (2 * half) AS width, abs((lcl + ucl) / 2 - centre) / (half / {upper_u(ALPHA)!r}) AS off,
  coalesce(abs(ucl - usl) <= 0.02 * (usl - lsl) AND abs(lcl - lsl) <= 0.02 * (usl - lsl), false) AS copied, used / k AS share, CASE WHEN lsl IS NULL AND usl IS NULL THEN NULL ELSE least((mean - lsl) / (3 * sd), (usl - mean) / (3 * sd)) END AS pk FROM f1),
f3 AS (SELECT *, unsteady AND NOT still AS shift, unsteady AND still AS betw, has AND enough AND width <= 0.67 AND NOT (unsteady AND still) AS narrow FROM f2)"""
_CHECKS = (
    ("resolution_vs_tolerance", "'high'", "resolution / (usl - lsl) > 0.05"), ("resolution_vs_variation", "'medium'", "coarse"), ("repeated_values", "'medium'", "longest >= 8 AND NOT coalesce(coarse, false)"), ("level_shift", "'medium'", "shift"),
    ("between_subgroups", "CASE WHEN share >= 0.05 THEN 'high' ELSE 'medium' END", "betw"), ("too_few_data", "'info'", "NOT enough"), ("limits_are_spec", "'high'", "has AND copied"),
    ("limits_too_wide", "CASE WHEN width >= 2 THEN 'high' ELSE 'medium' END", "has AND enough AND NOT copied AND width >= 1.5"), ("limits_too_narrow", "'medium'", "narrow"), ("limits_off_centre", "'medium'", "has AND enough AND NOT copied AND off >= 1.5"),
    ("too_many_alarms", "'high'", "has AND share >= 0.05 AND NOT unsteady AND NOT narrow"), ("limits_incomplete", "'low'", "(lcl IS NULL) <> (ucl IS NULL)"), ("no_limits_in_file", "'info'", "lcl IS NULL AND ucl IS NULL"),
    ("index_from_unstable_process", "'medium'", "enough AND unsteady AND pk IS NOT NULL"), ("capability_poor", "'high'", "enough AND pk < 1.0"), ("capability_below_target", "'medium'", "enough AND pk >= 1.0 AND pk < 1.33"), ("no_specification", "'info'", "lsl IS NULL AND usl IS NULL"),
)
FOUND = " UNION ALL ".join(f"SELECT series, '{code}' AS code, {severity} AS severity, {i} AS place FROM f3 WHERE {when}" for i, (code, severity, when) in enumerate(_CHECKS))


@query(f"WITH RECURSIVE {SHOWN} {FOUND}")
def health_findings(spark, sf_dir):
    return H.findings(_health(spark, sf_dir))


@query(f"""WITH s AS (SELECT event_type AS series, count(*) AS n, avg(value) AS m, var_pop(value) AS v, avg(ln(value)) AS lm, var_pop(ln(value)) AS lv, avg(value * value) AS q FROM events GROUP BY 1)
SELECT series, 'normal' AS family, {r("m", "a", 4)}, {r("sqrt(v)", "b", 4)}, {r("-n / 2 * (ln(2 * pi()) + ln(v) + 1)", "loglik", 3)} FROM s
UNION ALL SELECT series, 'lognormal', {r("lm", "a", 4)}, {r("sqrt(lv)", "b", 4)}, {r("-n / 2 * (ln(2 * pi()) + ln(lv) + 1) - n * lm", "loglik", 3)} FROM s
UNION ALL SELECT series, 'exponential', {r("m", "a", 4)}, NULL, {r("-n * (ln(m) + 1)", "loglik", 3)} FROM s
UNION ALL SELECT series, 'rayleigh', {r("sqrt(q / 2)", "a", 4)}, NULL, {r("n * (lm - ln(q / 2) - 1)", "loglik", 3)} FROM s""")
def closed_form_fits(spark, sf_dir):
    f = Y.closed_fits(measurements(spark, sf_dir)).filter("family != 'gamma'")
    return f.select("series", "family", (F.round("a", 4) + 0.0).alias("a"), (F.round("b", 4) + 0.0).alias("b"), (F.round("loglik", 3) + 0.0).alias("loglik"))


_DIGAMMA = "(ln(exp(x) + 10) - 1 / (2 * (exp(x) + 10)) - 1 / (12 * (exp(x) + 10) ^ 2) + 1 / (120 * (exp(x) + 10) ^ 4) - 1 / (252 * (exp(x) + 10) ^ 6) - list_sum(list_transform(range(0, 10), lambda j: 1 / (exp(x) + j))))"
_WEIBULL = f"""{M}, ws AS (SELECT series, count(*) AS n, avg(ln(value)) AS lm, pi() / (sqrt(6) * stddev_pop(ln(value))) AS k FROM m GROUP BY 1 HAVING min(value) > 0),
wb AS (SELECT series, n, lm, k, 0 AS it, 0::DOUBLE AS b FROM ws UNION ALL SELECT series, n, lm, greatest(k / 5, k - (s1 / s0 - 1 / k - lm) / (s2 / s0 - (s1 / s0) ^ 2 + 1 / k ^ 2)), it + 1, (s0 / n) ^ (1 / k)
  FROM (SELECT wb.series, n, lm, k, it, sum(value ^ k) AS s0, sum(value ^ k * ln(value)) AS s1, sum(value ^ k * ln(value) ^ 2) AS s2 FROM wb JOIN m ON m.series = wb.series WHERE it < 12 GROUP BY ALL)),
wf AS (SELECT series, n, lm, k, b FROM wb WHERE it = 12)"""


@query(f"""WITH RECURSIVE {_WEIBULL}, s AS (SELECT series, count(*) AS n, avg(value) AS m, var_pop(value) AS v, avg(ln(value)) AS lm, var_pop(ln(value)) AS lv, avg(value * value) AS q FROM m GROUP BY 1),
gap AS (SELECT series, n, m, lm, ln(m) - lm AS target FROM s), {solved("gap", "series, n, m, lm", f"(x - {_DIGAMMA})", -15.0, 25.0, 80)}, ga AS (SELECT *, exp(x) AS sh, m / exp(x) AS sc FROM solved),
f AS (SELECT series, 'normal' AS family, m AS a, sqrt(v) AS b, -n / 2 * (ln(2 * pi()) + ln(v) + 1) AS l, 2 AS k FROM s UNION ALL SELECT series, 'lognormal', lm, sqrt(lv), -n / 2 * (ln(2 * pi()) + ln(lv) + 1) - n * lm, 2 FROM s
  UNION ALL SELECT series, 'exponential', m, NULL, -n * (ln(m) + 1), 1 FROM s UNION ALL SELECT series, 'rayleigh', sqrt(q / 2), NULL, n * (lm - ln(q / 2) - 1), 1 FROM s
  UNION ALL SELECT series, 'gamma', sh, sc, n * ((sh - 1) * lm - sh - sh * ln(sc) - lgamma(sh)), 2 FROM ga UNION ALL SELECT series, 'weibull', k, b, n * (ln(k) - k * ln(b) + (k - 1) * lm - 1), 2 FROM wf),
t AS (SELECT *, 2 * k - 2 * l AS aic, min(2 * k - 2 * l) OVER (PARTITION BY series) AS best FROM f)
SELECT series, family, {r("a", "a", 3)}, {r("b", "b", 3)}, {r("l", "loglik", 2)}, k, {r("aic", "aic", 2)}, CAST(row_number() OVER (PARTITION BY series ORDER BY CASE WHEN family = 'normal' AND aic <= best + 2 THEN 0 ELSE 1 END, aic, family) AS INT) AS rank FROM t""")
def distribution_ranking(spark, sf_dir):
    m = measurements(spark, sf_dir)
    out = Y.ranked(Y.closed_fits(m).unionByName(Y.weibull_fit(m)))
    return rounded(out.withColumns({"loglik": F.round("loglik", 2), "aic": F.round("aic", 2)}), 3)


@query(f"""WITH RECURSIVE {_WEIBULL}, q AS (SELECT series, b * (-ln(0.5)) ^ (1 / k) AS c, b * (-ln(1 - {ALPHA / 2!r})) ^ (1 / k) AS lo, b * (-ln({ALPHA / 2!r})) ^ (1 / k) AS hi FROM wf WHERE n >= 20)
SELECT m.series, pos, value AS point, {r("c", "center", 4)}, {r("lo", "lcl", 4)}, {r("hi", "ucl", 4)}, value > hi OR value < lo AS alarm FROM m JOIN q USING (series)""")
def t_chart(spark, sf_dir):
    out = Y.t_chart(measurements(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("center", "lcl", "ucl")})


def _pass(n: int, before: str, half: float) -> str:
    """SQL of one pass of the search for the exponent, on a grid of 41 about that of the table before."""
    step = 2 * half / 40
    return f"""v{n} AS (SELECT m.series, i, lam - {half!r} + i * {step!r} AS l, n, lm, var_pop(CASE WHEN abs(lam - {half!r} + i * {step!r}) < 1e-9 THEN ln(value) ELSE (exp((lam - {half!r} + i * {step!r}) * ln(value)) - 1) / (lam - {half!r} + i * {step!r}) END) AS v
  FROM m JOIN {before} b ON b.series = m.series, range(41) t(i) GROUP BY ALL), w{n} AS (SELECT series, n, lm, l AS lam, -n / 2 * ln(v) + (l - 1) * n * lm AS ll FROM v{n} QUALIFY row_number() OVER (PARTITION BY series ORDER BY -n / 2 * ln(v) + (l - 1) * n * lm DESC) = 1)"""


_BOX_COX = f"{M}, w0 AS (SELECT series, count(*) AS n, avg(ln(value)) AS lm, 0.0::DOUBLE AS lam FROM m GROUP BY 1 HAVING min(value) > 0), {_pass(1, 'w0', 2.0)}, {_pass(2, 'w1', 0.1)}, {_pass(3, 'w2', 0.005)}"


@query(f"WITH {_BOX_COX} SELECT series, {r('lam', 'lambda', 5)}, {r('ll', 'loglik', 2)} FROM w3")
def box_cox_exponents(spark, sf_dir):
    return rounded(Y.box_cox(measurements(spark, sf_dir)).withColumn("loglik", F.round("loglik", 2)), 5)


@query(f"""WITH {_BOX_COX}, y AS (SELECT m.series, pos, value, lam, CASE WHEN abs(lam) < 1e-9 THEN ln(value) ELSE (value ^ lam - 1) / lam END AS y FROM m JOIN w3 USING (series) WHERE n >= 20),
c AS (SELECT series, lam, avg(y) AS c, avg(rg) / {d2(2)!r} AS s FROM (SELECT *, abs(y - lag(y) OVER (PARTITION BY series ORDER BY pos)) AS rg FROM y) GROUP BY ALL),
b AS (SELECT series, {", ".join(f"CASE WHEN abs(lam) < 1e-9 THEN exp(c + {k} * {U!r} * s) WHEN lam * (c + {k} * {U!r} * s) + 1 > 0 THEN (lam * (c + {k} * {U!r} * s) + 1) ^ (1 / lam) END AS {name}" for k, name in ((0, "mid"), (-1, "lo"), (1, "hi")))} FROM c)
SELECT y.series, pos, {r("y", "y", 4)}, value AS point, {r("mid", "center", 4)}, {r("lo", "lcl", 4)}, {r("hi", "ucl", 4)}, coalesce(value > hi, false) OR coalesce(value < lo, false) AS alarm FROM y JOIN b USING (series)""")
def box_cox_chart(spark, sf_dir):
    out = Y.box_cox_chart(measurements(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("y", "center", "lcl", "ucl")})
