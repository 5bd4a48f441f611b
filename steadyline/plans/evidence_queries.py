"""Queries of evidence about series, and of parsing measurement text."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyline.operators import evidence as V
from steadyline.operators import health as H
from steadyline.operators import monitors as Q
from steadyline.operators import studies as T
from steadyline.sources import text as S

from .inputs import G, groups, measurements, query, r, rounded, table
from .monitor_queries import FOUND, SHOWN, health_findings
from .study_queries import nested_sql
from .tail_sql import f_tail, solved

_TRIGAMMA = V.trigamma(2.0)


@query(f"""WITH {G}, d AS (SELECT m.series, g.label, sum((value - mean) ^ 2) AS m2, sum((value - mean) ^ 4) AS m4 FROM m JOIN g ON m.series = g.series AND m.pos // 5 = g.ord // 5 GROUP BY ALL),
p AS (SELECT series, avg((30 * m4 - 12 * m2 * m2) / 24) / avg((m2 / 4) ^ 2) AS kappa FROM d GROUP BY series),
a AS (SELECT series, count(*) AS k, 5 * var_samp(mean) / avg(var) AS f, regr_r2(mean, ord::DOUBLE) AS tr, var_samp(ln(CASE WHEN var > 0 THEN var END)) AS lv FROM g GROUP BY series),
s AS (SELECT series, sum((value - mu) ^ 3) / count(*) / (var_pop(value) ^ 1.5) AS g1, kurtosis_pop(value) + 3 AS b2 FROM (SELECT *, avg(value) OVER (PARTITION BY series) AS mu FROM m) GROUP BY series)
SELECT series, k, {r("f")}, {r("tr", "trend_r2")}, {r("kappa")}, {r(f"lv / ({_TRIGAMMA!r} + kappa / 5)", "dispersion")}, {r("g1", "skewness")}, {r("b2", "kurtosis")} FROM a JOIN p USING (series) JOIN s USING (series)""")
def time_model_evidence(spark, sf_dir):
    return rounded(V.time_model_evidence(groups(spark, sf_dir), measurements(spark, sf_dir), 5))


@query(f"""WITH s AS (SELECT event_type AS series, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1 HAVING count(*) >= 20),
g AS (SELECT s.series, max(n) AS n, avg(((value - m) / sqrt(v)) ^ 3) AS g1, avg(((value - m) / sqrt(v)) ^ 4) AS b2 FROM events JOIN s ON s.series = event_type GROUP BY 1),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ^ 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM g),
b AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, 6 + 8 / root * (2 / root + sqrt(1 + 4 / root ^ 2)) AS a FROM a),
c AS (SELECT *, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS ratio FROM b), d AS (SELECT series, z1, (1 - 2 / (9 * a) - sign(ratio) * abs(ratio) ^ (1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM c)
SELECT series, {r("z1", "z_skewness", 5)}, {r("z2", "z_kurtosis", 5)}, {r("z1 * z1 + z2 * z2", "k2", 3)}, {r("exp(-(z1 * z1 + z2 * z2) / 2)", "p")} FROM d""")
def normality_test(spark, sf_dir):
    out = V.normality(measurements(spark, sf_dir))
    return out.select("series", *((F.round(c, k) + 0.0).alias(c) for c, k in (("z_skewness", 5), ("z_kurtosis", 5), ("k2", 3), ("p", 6))))


@query(f"""WITH RECURSIVE s AS (SELECT event_type AS series, count(*) AS n, avg(value) - 49 AS b, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1), c AS (SELECT DISTINCT n, 0.05 AS target FROM s),
{solved("c", "n", f_tail("(x * x)", "1", "(n - 1)"), 0.5, 60.0, 50)}
SELECT series, s.n, {r("b", "bias")}, {r("se")}, {r("b / se", "t")}, {r("x", "t_critical")}, {r("b - x * se", "low")}, {r("b + x * se", "high")} FROM s JOIN solved ON solved.n = s.n""")
def bias_study(spark, sf_dir):
    return rounded(V.bias_study(measurements(spark, sf_dir), 49.0))


@query(f"""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 10 + embedding[3]::DOUBLE AS s FROM embeddings)
SELECT vec_id, {r("2 * sqrt(x * x + y * y)", "deviation")}, {r("3 + (s - 9) - 2 * sqrt(x * x + y * y)", "clearance")} FROM v""")
def position_clearance(spark, sf_dir):
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), (10 + e[2].cast("double")).alias("s"))
    return rounded(V.clearance(rows, "s", "x", "y", 3.0, 9.0).select("vec_id", "deviation", "clearance"))


@query(f"""WITH v AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), e AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM v),
d AS (SELECT n, (vb * (a - ma) ^ 2 - 2 * c * (a - ma) * (b - mb) + va * (b - mb) ^ 2) / (va * vb - c ^ 2) AS d2 FROM v, e)
SELECT {r("avg(d2 * d2)", "b2")}, {r("(avg(d2 * d2) - 8) / sqrt(64 / any_value(n))", "z")} FROM d""")
def mardia_kurtosis(spark, sf_dir):
    return rounded(V.mardia_kurtosis(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")), 2))


@query(f"""WITH s AS (SELECT user_id % 12 AS cavity, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT cavity, n, {r("mean")}, {r("sd")}, {r("145 / (6 * sd)", "pm")}, {r("least((mean - 5) / (3 * sd), (150 - mean) / (3 * sd))", "pmk")} FROM s""")
def cavity_capability(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("cavity"), "value")
    return rounded(V.level_capability(rows, "cavity", 5.0, 150.0))


@query(f"""WITH {G}, s AS (SELECT series, avg(rng) / 2.3259289472810205 AS sigma FROM g GROUP BY series) SELECT series, {r("sigma", "sigma", 4)} FROM s""")
def mean_range_sigma(spark, sf_dir):
    return rounded(Q.mean_range_sigma(groups(spark, sf_dir), 5), 4)


@query(f"WITH RECURSIVE {SHOWN}, found AS ({FOUND}) SELECT severity, count(*) AS findings, count(DISTINCT series) AS series FROM found GROUP BY 1")
def health_overview(spark, sf_dir):
    return H.health_summary(health_findings(spark, sf_dir))


@query("SELECT o_orderpriority AS part, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def unknown_products(spark, sf_dir):
    parts = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "part string")
    return Q.unknown_parts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part")), parts)


@query(nested_sql("SELECT event_type AS op, user_id AS g, value::DOUBLE AS v FROM events", "op", "g", 3))
def nested_gauge_study(spark, sf_dir):
    """Parts are nested in operators: each operator has parts of its own."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.col("user_id").alias("g"), "value")
    return rounded(T.nested_anova(rows, "op", "g"), 3)


# -- Text of measurements --------------------------------------------------------


def _lines(spark, sf_dir):
    """Events as the raw cells of files, one file per type, with faults in some rows."""
    i = F.col("event_id")
    value = F.when(i % 97 == 0, "").when(i % 89 == 0, "12,5").when(i % 83 == 0, "n/a").otherwise(F.format_string("%.2f", "value"))
    flag = F.when(i % 71 == 0, "no").when(i % 67 == 0, "perhaps").otherwise("ok")
    cells = F.create_map(F.lit("v"), value, F.lit("g"), F.when(i % 61 == 0, "").otherwise((F.col("user_id") % 9).cast("string")), F.lit("ok"), flag, F.lit("why"), F.when(i % 142 == 0, "broken tool").otherwise(""))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), i.alias("line"), cells.alias("cells"))


_CELLS = """c AS (SELECT event_type AS file, event_id AS line, CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN '12,5' WHEN event_id % 83 = 0 THEN 'n/a' ELSE 'x' END AS v, event_id % 61 = 0 AS no_g,
  CASE WHEN event_id % 71 = 0 THEN 'no' WHEN event_id % 67 = 0 THEN 'perhaps' ELSE 'ok' END AS flag, event_id % 142 = 0 AS why FROM events)"""


@query(f"""WITH {_CELLS} SELECT file, line, 'v' AS "column", 'missing_value' AS code FROM c WHERE v = '' UNION ALL SELECT file, line, 'v', 'bad_number' FROM c WHERE v IN ('12,5', 'n/a')
UNION ALL SELECT file, line, 'g', 'missing_subgroup' FROM c WHERE no_g UNION ALL SELECT file, line, 'ok', 'invalid_without_reason' FROM c WHERE flag = 'no' AND NOT why UNION ALL SELECT file, line, 'ok', 'bad_flag' FROM c WHERE flag = 'perhaps'""")
def import_issues(spark, sf_dir):
    return S.typed(_lines(spark, sf_dir), S.reading("v", group="g", ok="ok", why="why"))[1]


@query(f"""WITH {_CELLS} SELECT file, line AS source_row, round(e.value, 2) + 0.0 AS value, flag <> 'no' AS valid FROM c JOIN events e ON e.event_id = line WHERE v = 'x'""")
def imported_rows(spark, sf_dir):
    rows = S.typed(_lines(spark, sf_dir), S.reading("v", group="g", ok="ok", why="why"))[0]
    return rounded(rows.select("file", "source_row", "value", "valid"), 2)


@query("SELECT DISTINCT event_type AS file, 'subgroup_not_contiguous' AS code FROM events")
def import_notes(spark, sf_dir):
    rows = S.typed(_lines(spark, sf_dir), S.reading("v", group="g"))[0]
    return S.notes(rows)
