"""Queries over states, nested levels, measurement systems and designed experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyline.functions.numeric import d2
from steadyline.operators import studies as T

from .inputs import query, r, rounded, table
from .tail_sql import f_tail, solved

_STATES = "s AS (SELECT l_returnflag || l_linestatus AS state, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, var_samp(l_quantity) AS var FROM lineitem GROUP BY 1)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("state"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("value"))


def _states(spark, sf_dir):
    return T.state_stats(_lines(spark, sf_dir), "state")


@query(f"WITH {_STATES} SELECT state, n, {r('mean')}, {r('sd')}, {r('var')} FROM s")
def state_statistics(spark, sf_dir):
    return rounded(_states(spark, sf_dir))


@query(f"""WITH {_STATES}, a AS (SELECT count(*) AS k, sum(n - 1) AS f, sum((n - 1) * var) AS ss, sum((n - 1) * ln(var)) AS lg, sum(1 / (n - 1)) AS inv FROM s WHERE n > 1 AND var > 0)
SELECT {r("(f * ln(ss / f) - lg) / (1 + (inv - 1 / f) / (3 * (k - 1)))", "statistic")}, k - 1 AS df FROM a""")
def bartlett_test(spark, sf_dir):
    return rounded(T.bartlett(_states(spark, sf_dir)))


_ANOVA = f"""{_STATES}, a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) AS s, sum(n * mean * mean) AS q, sum((n - 1) * var) AS w FROM s),
t AS (SELECT q - s * s / n AS b, w, CAST(k - 1 AS BIGINT) AS dfb, CAST(n - k AS BIGINT) AS dfw FROM a)"""


@query(f"WITH {_ANOVA} SELECT {r('b', 'ss_between', 4)}, {r('w', 'ss_within', 4)}, dfb AS df_between, dfw AS df_within, {r('(b / dfb) / (w / dfw)', 'f', 4)}, {r('b / (b + w)', 'eta2')} FROM t")
def one_way_anova(spark, sf_dir):
    out = T.anova(_states(spark, sf_dir))
    return out.select(*(F.round(c, 4 if c != "eta2" else 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(f"""WITH RECURSIVE {_ANOVA}, c AS (SELECT dfb, dfw, 0.05 AS target FROM t), {solved("c", "dfb, dfw", f_tail("x", "dfb", "dfw"), 1e-6, 60.0, 50)}, f AS (SELECT *, (b / dfb) / (w / dfw) AS f FROM t)
SELECT {r('b', 'ss_between', 4)}, {r('w', 'ss_within', 4)}, f.dfb AS df_between, f.dfw AS df_within, {r('f', 'f', 4)}, {r('b / (b + w)', 'eta2', 5)}, {r('x', 'critical', 5)}, {r(f_tail("f", "f.dfb", "f.dfw"), 'p', 5)} FROM f, solved""")
def equal_means_test(spark, sf_dir):
    out = T.judged(T.anova(_states(spark, sf_dir)))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("ss_between", "ss_within", "f")}), 5)


@query(f"""WITH {_STATES}, p AS (SELECT a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.var AS v1, b.var AS v2 FROM s a, s b WHERE a.state = 'AF' AND b.state = 'NO')
SELECT {r("greatest(v1, v2) / least(v1, v2)", "f")}, {r("(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))", "t")}, {r("(m1 - m2) / sqrt(v1 / n1 + v2 / n2)", "welch_t")},
{r("(v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1))", "welch_df")} FROM p""")
def two_state_tests(spark, sf_dir):
    return rounded(T.two_states(_states(spark, sf_dir), "AF", "NO", "state"))


@query(f"""WITH RECURSIVE {_STATES}, d AS (SELECT s.state, max(abs(l_quantity - mean) / sd) AS g, max(n) AS n FROM lineitem JOIN s ON s.state = l_returnflag || l_linestatus WHERE n > 2 AND sd > 0 GROUP BY 1),
c AS (SELECT DISTINCT n, 0.05 / n AS target FROM d), {solved("c", "n", f_tail("(x * x)", "1", "(n - 2)"), 0.5, 40.0, 50)},
k AS (SELECT d.state, g, d.n, (d.n - 1) / sqrt(d.n) * sqrt(x * x / (d.n - 2 + x * x)) AS critical FROM d JOIN solved USING (n))
SELECT state, {r("g")}, n, {r("critical")}, g > critical AS outlier FROM k""")
def state_outliers(spark, sf_dir):
    return rounded(T.state_extremes(_lines(spark, sf_dir), "state"))


@query(f"""WITH {_STATES}, a AS (SELECT sqrt(sum((n - 1) * var) / sum(n - 1)) AS s, min(mean) AS lo, max(mean) AS hi FROM s)
SELECT {r("s", "sigma")}, {r("hi - lo", "delta_m")}, {r("(60 - (hi - lo)) / (6 * s)", "pm")}, {r("least((lo + 5) / (3 * s), (55 - hi) / (3 * s))", "pmk")} FROM a""")
def multi_state_capability(spark, sf_dir):
    return rounded(T.pooled_capability(_states(spark, sf_dir), -5.0, 55.0))


@query(f"""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DOUBLE) AS s, sum(l_quantity::DOUBLE * l_quantity) AS q FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, sum(n) OVER () - n AS m, s / n AS mean, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS rest, sum(q) OVER () - q AS qr FROM g),
y AS (SELECT *, (q - n * mean * mean) / (n - 1) AS v, (qr - m * rest * rest) / (m - 1) AS w FROM x)
SELECT l_returnflag, l_linestatus, n, {r("mean")}, {r("sqrt(v)", "sd")}, {r("mean - rest", "difference")}, {r("(mean - rest) / sqrt(v / n + w / m)", "t")}, {r("(v / n + w / m) ^ 2 / ((v / n) ^ 2 / (n - 1) + (w / m) ^ 2 / (m - 1))", "df", 4)} FROM y""")
def factor_combinations(spark, sf_dir):
    out = T.combinations_against_rest(_lines(spark, sf_dir), "l_returnflag", "l_linestatus")
    return rounded(out.withColumn("df", F.round("df", 4)))


@query("SELECT f.l_returnflag, s.l_linestatus FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT l_linestatus FROM lineitem) s EXCEPT SELECT l_returnflag, l_linestatus FROM lineitem")
def missing_combinations(spark, sf_dir):
    return T.missing_combinations(_lines(spark, sf_dir), "l_returnflag", "l_linestatus")


@query(f"""WITH d AS (SELECT state, abs(q - median(q) OVER (PARTITION BY state)) AS v FROM (SELECT l_returnflag || l_linestatus AS state, l_quantity::DOUBLE AS q FROM lineitem)),
s AS (SELECT state, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM d GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) AS s, sum(n * mean * mean) AS q, sum((n - 1) * var) AS w FROM s)
SELECT {r("((q - s * s / n) / (k - 1)) / (w / (n - k))", "f", 4)} FROM a""")
def brown_forsythe_test(spark, sf_dir):
    return T.brown_forsythe(_lines(spark, sf_dir), "state").select((F.round("f", 4) + 0.0).alias("f"))


def _nested_rows(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("value"))


def nested_sql(rows: str, a: str, b: str, digits: int = 2) -> str:
    """Nested analysis of `rows` (a, b, v), b inside a, by sums of squares and the coefficients of unequal sizes."""
    line = lambda name, i: f"SELECT '{name}' AS level, {r(f's{i}', 'ss', digits)}, CAST(d{i} AS BIGINT) AS df, {r(f's{i} / d{i}', 'ms', digits)}, {r(f'v{i}', 'variance', digits)} FROM w"
    return f"""WITH m AS ({rows}),
f AS (SELECT {a}, {b}, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM m GROUP BY ALL), g AS (SELECT {a}, sum(n) AS n, sum(s) AS s, sum(n * n) AS w FROM f GROUP BY 1),
t AS (SELECT sum(s) ^ 2 / sum(n) AS t0, sum(n) AS n, sum(n * n) / sum(n) AS q01, (SELECT sum(w) FROM g) / sum(n) AS q02 FROM g), u AS (SELECT sum(s * s / n) AS t1, count(*) AS a, sum(w / n) AS q12 FROM g), x AS (SELECT sum(s * s / n) AS t2, count(*) AS b, sum(q) AS q FROM f),
y AS (SELECT t1 - t0 AS s1, t2 - t1 AS s2, q - t2 AS s3, a - 1 AS d1, b - a AS d2, n - b AS d3, (n - q01) / (a - 1) AS k11, (q12 - q02) / (a - 1) AS k12, (n - q12) / (b - a) AS k22 FROM t, u, x),
z AS (SELECT *, s3 / d3 AS v3, greatest(0, (s2 / d2 - s3 / d3) / k22) AS v2 FROM y), w AS (SELECT *, greatest(0, (s1 / d1 - v3 - k12 * v2) / k11) AS v1 FROM z)
{line(a, 1)} UNION ALL {line(b, 2)} UNION ALL {line("error", 3)}"""


_NESTED = nested_sql("SELECT n_regionkey AS region, n_nationkey AS nation, c_acctbal::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey", "region", "nation")


@query(_NESTED)
def nested_anova(spark, sf_dir):
    return rounded(T.nested_anova(_nested_rows(spark, sf_dir), "region", "nation"), 2)


@query(_NESTED)
def nested_variance_components(spark, sf_dir):
    return rounded(T.nested_anova(_nested_rows(spark, sf_dir), "region", "nation"), 2)


# -- Measurement systems -------------------------------------------------------


@query(f"""WITH s AS (SELECT event_type AS series, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM events GROUP BY 1)
SELECT series, n, {r("mean")}, {r("s")}, {r("mean - 50", "bias")}, {r("0.2 * 2000 / (4 * s)", "cg")}, {r("(0.1 * 2000 - abs(mean - 50)) / (2 * s)", "cgk")}, {r("(mean - 50) / (s / sqrt(n))", "t")} FROM s""")
def type1_gauge_study(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "value")
    return rounded(T.gauge_type1(rows, 50.0, 2000.0))


_CELLS = "c AS (SELECT l_linenumber AS part, l_returnflag AS op, count(*) AS r, avg(l_quantity::DOUBLE) AS m, coalesce(var_samp(l_quantity::DOUBLE), 0) AS v FROM lineitem GROUP BY 1, 2)"


def _gauge(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("part"), F.col("l_returnflag").alias("op"), F.col("l_quantity").cast("double").alias("value"))


@query(f"""WITH {_CELLS}, p AS (SELECT var_pop(m) AS vp, count(*) AS p FROM (SELECT avg(m) AS m FROM c GROUP BY part)), o AS (SELECT var_pop(m) AS vo, count(*) AS o FROM (SELECT avg(m) AS m FROM c GROUP BY op)),
a AS (SELECT avg(r) AS r, var_pop(m) AS vc, count(*) AS cells, sum((r - 1) * v) AS se, sum(r) AS rows FROM c),
s AS (SELECT p, o, r, vp * p * o * r AS sp, vo * p * o * r AS so, vc * cells * r - vp * p * o * r - vo * p * o * r AS si, se, se / (rows - cells) AS me FROM p, o, a),
w AS (SELECT *, sp / (p - 1) AS mp, so / (o - 1) AS mo, si / ((p - 1) * (o - 1)) AS mi FROM s)
SELECT p AS parts, o AS operators, {r("sp", "ss_part", 4)}, {r("so", "ss_operator", 4)}, {r("si", "ss_interaction", 4)}, {r("se", "ss_repeat", 4)}, {r("me", "var_repeat", 4)}, {r("greatest(0, (mi - me) / r)", "var_interaction", 4)},
{r("greatest(0, (mo - mi) / (p * r))", "var_operator", 4)}, {r("greatest(0, (mp - mi) / (o * r))", "var_part", 4)} FROM w""")
def crossed_gauge_study(spark, sf_dir):
    return rounded(T.crossed_grr(_gauge(spark, sf_dir), "part", "op"), 4)


@query(f"""WITH {_CELLS}, o AS (SELECT op, sqrt(avg(v)) AS sd, avg(m) AS mean FROM c GROUP BY op), a AS (SELECT sqrt(avg(sd * sd)) AS ps, avg(mean) AS g, stddev_samp(mean) AS b FROM o)
SELECT op, {r("sd")}, {r("mean")}, {r("sd / ps", "k")}, {r("(mean - g) / b", "h", 4)} FROM o, a""")
def pooled_sd_gauge_study(spark, sf_dir):
    out = T.pooled_sd_grr(_gauge(spark, sf_dir), "part", "op")
    return rounded(out.withColumn("h", F.round("h", 4)))


@query(f"SELECT count(*) AS parts, {r('avg(abs(s_acctbal - s_nationkey))', 'r_bar', 4)}, {r(f'avg(abs(s_acctbal - s_nationkey)) / {d2(2)!r}', 'sigma', 4)} FROM supplier")
def range_method(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("part"), F.col("s_acctbal").cast("double").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return rounded(T.range_method(rows, "part", "a", "b"), 4)


@query(f"""WITH x AS (SELECT p_size::DOUBLE AS x, (p_retailprice - p_size)::DOUBLE AS y FROM part), a AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, avg(x) AS xm FROM x),
s AS (SELECT *, sqrt((syy - b * sxy) / (n - 2)) AS s FROM a)
SELECT n, {r("b", "slope", 5)}, {r("a", "intercept", 5)}, {r("r2", "r2", 5)}, {r("s", "s", 5)}, {r("b / (s / sqrt(sxx))", "t_slope", 5)}, {r("a / (s * sqrt(1 / n + xm * xm / sxx))", "t_intercept", 5)} FROM s""")
def linearity_study(spark, sf_dir):
    return rounded(T.linearity(table(spark, sf_dir, "part"), "p_size", "p_retailprice"), 5)


@query(f"""WITH g AS (SELECT p_size AS x, count(*) AS n, coalesce(var_samp(p_retailprice::DOUBLE), 0) AS v FROM part GROUP BY 1), p AS (SELECT sum((n - 1) * v) AS sp, CAST(sum(n - 1) AS BIGINT) AS dp, count(*) - 2 AS dl FROM g),
l AS (SELECT regr_syy(p_retailprice::DOUBLE, p_size::DOUBLE) - regr_sxy(p_retailprice::DOUBLE, p_size::DOUBLE) ^ 2 / regr_sxx(p_retailprice::DOUBLE, p_size::DOUBLE) AS sr FROM part)
SELECT {r("sr", "ss_residual", 3)}, {r("sp", "ss_pure", 3)}, {r("sr - sp", "ss_lack", 3)}, dp AS df_pure, dl AS df_lack, {r("((sr - sp) / dl) / (sp / dp)", "f", 5)} FROM p, l""")
def lack_of_fit_test(spark, sf_dir):
    out = T.lack_of_fit(table(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("ss_residual", "ss_pure", "ss_lack")}), 5)


@query(f"""WITH s AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s)
SELECT n, {r("po", "agreement")}, {r("pe", "by_chance")}, {r("(po - pe) / (1 - pe)", "kappa")} FROM e""")
def cohen_kappa(spark, sf_dir):
    return rounded(T.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


_JUDGED = "j AS (SELECT doc_id, quality AS c FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels UNION ALL SELECT doc_id, CAST(doc_id % 3 = 0 AS INT) FROM labels)"


@query(f"""WITH {_JUDGED}, c AS (SELECT doc_id, c, count(*) AS n FROM j GROUP BY ALL), i AS (SELECT doc_id, sum(n) AS m, sum(n * n) AS q FROM c GROUP BY 1), a AS (SELECT count(*) AS items, avg((q - m) / (m * (m - 1))) AS po, sum(m) AS al FROM i),
s AS (SELECT sum((k / (SELECT al FROM a)) ^ 2) AS pe FROM (SELECT sum(n) AS k FROM c GROUP BY c)) SELECT items, {r("po")}, {r("pe")}, {r("(po - pe) / (1 - pe)", "kappa")} FROM a, s""")
def fleiss_kappa(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    rows = x.select("doc_id", F.explode(F.array(F.col("quality"), 1 - F.col("toxic"), (F.col("doc_id") % 3 == 0).cast("int"))).alias("c"))
    return rounded(T.fleiss_kappa(rows, "doc_id", "c"))


@query(f"""WITH j AS (SELECT 'a' || (doc_id % 3) AS who, doc_id // 9 AS part, quality AS d, CAST((doc_id // 9) % 4 > 0 AS INT) AS ref FROM labels),
p AS (SELECT who, part, min(d) AS lo, max(d) AS hi, max(ref) AS ref, count(*) AS n, count(*) FILTER (WHERE d = 1 AND ref = 0) AS miss, count(*) FILTER (WHERE d = 0 AND ref = 1) AS fa FROM j GROUP BY ALL)
SELECT who, count(*) AS parts, {r("avg(CASE WHEN lo = hi THEN 1.0 ELSE 0 END)", "within")}, {r("avg(CASE WHEN lo = hi AND lo = ref THEN 1.0 ELSE 0 END)", "effectiveness")}, {r("sum(miss) / sum(n) FILTER (WHERE ref = 0)", "miss_rate")}, {r("sum(fa) / sum(n) FILTER (WHERE ref = 1)", "false_alarm_rate")} FROM p GROUP BY who""")
def attribute_agreement(spark, sf_dir):
    part = F.floor(F.col("doc_id") / 9)
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("a"), F.col("doc_id") % 3).alias("who"), part.alias("part"), F.col("quality").alias("d"), (part % 4 > 0).cast("int").alias("ref"))
    return rounded(T.attribute_agreement(rows, "who", "part", "d", "ref"))


@query(f"""WITH x AS (SELECT quality + (doc_id % 2) AS a, toxic + (doc_id % 3 > 0)::INT AS b FROM labels), t AS (SELECT a, b, count(*) AS n FROM x WHERE a <> b GROUP BY ALL),
p AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, coalesce(sum(n) FILTER (WHERE a < b), 0) AS u, coalesce(sum(n) FILTER (WHERE a > b), 0) AS d FROM t GROUP BY ALL)
SELECT {r("sum((u - d) ^ 2 / (u + d))", "statistic")}, count(*) AS df FROM p""")
def bowker_symmetry(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("doc_id") % 2).alias("a"), (F.col("toxic") + (F.col("doc_id") % 3 > 0).cast("int")).alias("b"))
    return rounded(T.bowker(rows, "doc_id", "a", "b"))


@query("""WITH p AS (SELECT p_partkey, max(p_size) AS ref, min(CAST(p_size + (l_orderkey % 5) > 25 AS INT)) AS lo, max(CAST(p_size + (l_orderkey % 5) > 25 AS INT)) AS hi FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)
SELECT max(ref) FILTER (WHERE hi = 0) AS last_reject, min(ref) FILTER (WHERE lo = 1) AS first_accept, count(*) FILTER (WHERE lo <> hi) AS grey_parts FROM p""")
def signal_detection_zone(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    rows = p.select("p_partkey", "p_size").join(li, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_size", (F.col("p_size") + F.col("l_orderkey") % 5 > 25).cast("int").alias("ok"))
    return T.signal_detection(rows, "p_partkey", "p_size", "ok")


@query("""WITH s AS (SELECT o_custkey AS sys, o_orderpriority AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'conditional' ELSE 'pass' END AS verdict, 12 + 24 * (o_orderkey % 4) AS months, o_orderkey % 7 = 0 AS voided FROM orders),
l AS (SELECT * FROM s WHERE NOT voided QUALIFY row_number() OVER (PARTITION BY sys, kind ORDER BY d DESC, id DESC) = 1),
e AS (SELECT sys, CASE WHEN d + to_months(CAST(months AS INT)) < DATE '1998-01-01' THEN 'block' ELSE verdict END AS state FROM l)
SELECT sys AS system, CASE WHEN bool_or(state = 'block') THEN 'block' WHEN bool_or(state = 'conditional') THEN 'conditional' ELSE 'pass' END AS gate FROM e GROUP BY sys""")
def measurement_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.col("o_custkey").alias("system"), F.col("o_orderpriority").alias("kind"), k.alias("id"), F.col("o_orderdate").cast("date").alias("date"),
        F.when(k % 5 == 0, "block").when(k % 5 == 1, "conditional").otherwise("pass").alias("verdict"), (12 + 24 * (k % 4)).cast("int").alias("months"), (k % 7 == 0).alias("voided"),
    )
    return T.gate(rows, "1998-01-01")


# -- Designed experiments ------------------------------------------------------


@query(f"""WITH RECURSIVE x AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem), a AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, count(*)::DOUBLE AS n, avg(x) AS xm FROM x),
s AS (SELECT *, sqrt((syy - b * sxy) / (n - 2)) AS s FROM a), c AS (SELECT n, 0.05 AS target FROM a), {solved("c", "n", f_tail("(x * x)", "1", "(n - 2)"), 0.5, 20.0, 50)},
t AS (SELECT 'constant' AS term, a AS estimate, s * sqrt(1 / n + xm * xm / sxx) AS se, NULL::DOUBLE AS vif FROM s UNION ALL SELECT 'l_quantity', b, s / sqrt(sxx), 1::DOUBLE FROM s)
SELECT term, {r("estimate", "estimate", 3)}, {r("se", "se", 3)}, {r("estimate / se", "t", 3)}, {r("estimate - x * se", "low", 3)}, {r("estimate + x * se", "high", 3)}, {r("vif", "vif", 3)} FROM t, solved""")
def simple_regression(spark, sf_dir):
    return rounded(T.regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]), 3)


_FACTORS = ("l_quantity", "l_discount", "l_tax")


def _covered(i: int, j: int) -> str:
    """SQL of an element of the inverse of the 3 x 3 matrix of centred products s11 ... s33, times its determinant."""
    a, b = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
    at = lambda x, y: f"s{min(x, y)}{max(x, y)}"
    return f"({'-' if (i + j) % 2 else ''}({at(a[0], b[0])} * {at(a[1], b[1])} - {at(a[0], b[1])} * {at(a[1], b[0])}))"


_NORMAL = f"""x AS (SELECT l_extendedprice::DOUBLE AS y, {", ".join(f"{c}::DOUBLE AS x{i}" for i, c in enumerate(_FACTORS))} FROM lineitem),
a AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, var_pop(y) * count(*) AS syy, {", ".join(f"avg(x{i}) AS m{i}, covar_pop(y, x{i}) * count(*) AS y{i}" for i in range(3))}, {", ".join(f"covar_pop(x{i}, x{j}) * count(*) AS s{i}{j}" for i in range(3) for j in range(i, 3))} FROM x),
d AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) AS det FROM a),
i AS (SELECT *, {", ".join(f"{_covered(i, j)} / det AS i{i}{j}" for i in range(3) for j in range(3))} FROM d), b AS (SELECT *, {", ".join(f"{' + '.join(f'i{i}{j} * y{j}' for j in range(3))} AS b{i}" for i in range(3))} FROM i),
e AS (SELECT *, (syy - {" - ".join(f"b{i} * y{i}" for i in range(3))}) / (n - 4) AS s2, my - {" - ".join(f"b{i} * m{i}" for i in range(3))} AS b, 1 / n + {" + ".join(f"m{i} * m{j} * i{i}{j}" for i in range(3) for j in range(3))} AS i FROM b),
c AS (SELECT n, 0.05 AS target FROM a), t AS (SELECT 'constant' AS term, b AS estimate, sqrt(s2 * i) AS se, n, NULL AS vif FROM e {" ".join(f"UNION ALL SELECT '{c}', b{i}, sqrt(s2 * i{i}{i}), n, i{i}{i} * s{i}{i} FROM e" for i, c in enumerate(_FACTORS))})"""


@query(f"""WITH RECURSIVE {_NORMAL}, {solved("c", "n", f_tail("(x * x)", "1", "(n - 4)"), 0.5, 20.0, 50)}
SELECT term, {r("estimate", "estimate", 3)}, {r("se", "se", 3)}, {r("estimate / se", "t", 3)}, {r("estimate - x * se", "low", 3)}, {r("estimate + x * se", "high", 3)}, {r("vif", "vif", 3)} FROM t, solved""")
def multiple_regression(spark, sf_dir):
    return rounded(T.regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_FACTORS)), 3)


def _design(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return x.select(F.col("l_extendedprice").cast("double").alias("y"), sign(F.col("l_quantity") > 25).alias("a"), sign(F.col("l_linenumber") > 3).alias("b"), sign(F.col("l_linestatus") == "O").alias("c"))


_DESIGN = "x AS (SELECT l_extendedprice::DOUBLE AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS a, CASE WHEN l_linenumber > 3 THEN 1 ELSE -1 END AS b, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS c FROM lineitem)"


def _effect(name: str, sign: str) -> str:
    return f"SELECT '{name}' AS term, {r(f'avg(y) FILTER (WHERE {sign} > 0) - avg(y) FILTER (WHERE {sign} < 0)', 'effect', 4)} FROM x"


_EFFECTS = " UNION ALL ".join(_effect(":".join(t), " * ".join(t)) for t in ("a", "b", "c", "ab", "ac", "bc", "abc"))


@query(f"WITH {_DESIGN} {_EFFECTS}")
def factorial_effects(spark, sf_dir):
    return rounded(T.factorial_effects(_design(spark, sf_dir), "y", ["a", "b", "c"]), 4)


@query(f"""WITH RECURSIVE {_DESIGN}, e AS ({_EFFECTS}), s AS (SELECT 1.5 * median(abs(effect)) AS s0, count(*) / 3.0 AS df FROM e), k AS (SELECT 1.5 * median(abs(effect)) AS pse, max(df) AS df FROM e, s WHERE abs(effect) < 2.5 * s0),
c AS (SELECT df, 0.05 AS target FROM k), {solved("c", "df", f_tail("(x * x)", "1", "df"), 0.5, 60.0, 50)} SELECT {r("pse", "pse", 2)}, {r("x * pse", "margin", 2)} FROM k, solved""")
def lenth_error(spark, sf_dir):
    return rounded(T.lenth(T.factorial_effects(_design(spark, sf_dir), "y", ["a", "b", "c"])), 2)
