"""Queries over designed experiments and attribute gauges by the analytic method."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyline.operators import attribute_gauge as A
from steadyline.operators import designs as D

from .inputs import query, r, rounded, table
from .tail_sql import both_tails, f_tail_large, normal_points

# Five factors in the rows of a quarter fraction: d = ab, e = ac.
_CELLS = """x AS (SELECT l_quantity AS y, (l_quantity > 25)::INT + 2 * (l_linenumber > 3)::INT + 4 * (l_linestatus = 'O')::INT + 8 * (l_partkey % 2 = 0)::INT + 16 * (l_suppkey % 3 = 0)::INT AS cell FROM lineitem),
g AS (SELECT cell, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) AS v FROM x WHERE bit_count(cell & 11) % 2 = 1 AND bit_count(cell & 21) % 2 = 1 GROUP BY 1),
t AS (SELECT t, bit_count(t)::INT AS size, array_to_string(list_filter(['a', 'b', 'c', 'd', 'e'], lambda v, i: (t >> (i - 1)) & 1 = 1), ':') AS label FROM (SELECT unnest(range(1, 32)) AS t)),
s AS (SELECT t, size, label, cell, m, CASE WHEN bit_count(t & (31 - cell)) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM t, g),
w AS (SELECT t, size, label, list(sign ORDER BY cell) AS signs, 2 * avg(sign * m) AS effect FROM s GROUP BY ALL),
k AS (SELECT *, signs[1] AS lead, list_transform(signs, lambda v: v * signs[1]) AS key FROM w)"""


def _fraction(spark, sf_dir):
    sign = lambda c: F.when(c, 1).otherwise(-1)
    levels = {"a": F.col("l_quantity") > 25, "b": F.col("l_linenumber") > 3, "c": F.col("l_linestatus") == "O", "d": F.col("l_partkey") % 2 == 0, "e": F.col("l_suppkey") % 3 == 0}
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("y"), *(sign(c).alias(f) for f, c in levels.items()))
    return rows.filter("d = a * b and e = a * c"), "y", list(levels)


@query(f"WITH {_CELLS}, i AS (SELECT label AS word, lead AS sign, size AS length FROM k WHERE list_min(key) = list_max(key)) SELECT word, sign, length, (SELECT min(length) FROM i) AS resolution FROM i")
def defining_relation(spark, sf_dir):
    return D.defining_relation(*_fraction(spark, sf_dir))


@query(f"""WITH {_CELLS}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, label) AS place, first_value(lead) OVER (PARTITION BY key ORDER BY size, label) AS own FROM k WHERE list_min(key) <> list_max(key)),
e AS (SELECT sum((n - 1) * v) / sum(n - 1) AS s2, sum(n - 1) AS dof, sum(1 / n) AS inv, count(*) AS m FROM g),
a AS (SELECT key, string_agg(CASE WHEN lead * own < 0 THEN '-' ELSE '' END || label, ' ' ORDER BY size, label) FILTER (WHERE place > 1 AND size <= 3) AS aliases FROM c GROUP BY 1),
f AS (SELECT label AS term, aliases, effect, effect ^ 2 / (4 * s2 * inv / (m * m)) AS f, dof FROM c JOIN a USING (key), e WHERE place = 1)
SELECT term, coalesce(aliases, '') AS aliases, {r("effect", "effect", 5)}, {r("f", "f", 3)}, {r(both_tails("sqrt(f)", "dof"), "p", 4)} FROM f""")
def fraction_effects(spark, sf_dir):
    out = D.fraction_effects(*_fraction(spark, sf_dir))
    return out.select("term", "aliases", *((F.round(c, k) + 0.0).alias(c) for c, k in (("effect", 5), ("f", 3), ("p", 4))))


# Second-order model of two factors. The SQL makes the terms orthogonal one after another; a term that comes last has its coefficient there.
_SURFACE = "q0 AS (SELECT l_discount * 100 AS x, l_tax * 100 AS z, count(*) AS n, avg(l_quantity) AS y, var_pop(l_quantity) * count(*) AS within FROM lineitem GROUP BY ALL), b0 AS (SELECT n, y, within, 1.0::DOUBLE AS c0, x AS c1, z AS c2, x * x AS c3, z * z AS c4, x * z AS c5 FROM q0)"


def _orthogonal(order: list[int], name: str) -> str:
    """CTEs whose last, `name`, has the squared length of the last term and its product with y after all others, and the sums of squares of each in `name`_s."""
    ctes, before = [], "b0"
    for step, c in enumerate(order):
        later = ", ".join(f"c{d} - c{c} * (sum(n * c{c} * c{d}) OVER ()) / (sum(n * c{c} * c{c}) OVER ()) AS c{d}" for d in order[step + 1 :])
        kept = ", ".join(f"c{d}" for d in order[: step + 1])
        if later:
            ctes.append(f"{name}{step} AS (SELECT n, y, within, {kept}, {later} FROM {before})")
            before = f"{name}{step}"
    sums = ", ".join(f"sum(n * c{c} * y) AS u{c}, sum(n * c{c} * c{c}) AS l{c}" for c in order)
    return ", ".join([*ctes, f"{name} AS (SELECT {sums}, sum(n) AS n, count(*) AS cells, sum(within) AS pure, sum(n * y * y) + sum(within) AS yy FROM {before})"])


_WHOLE = f"{_SURFACE}, {_orthogonal([0, 1, 2, 3, 4, 5], 'o')}, v AS (SELECT *, {', '.join(f'u{c} * u{c} / l{c} AS s{c}' for c in range(6))} FROM o), e AS (SELECT *, yy - s0 - s1 - s2 - s3 - s4 - s5 AS rest, n - 6 AS dof, n - cells AS free FROM v)"


def _surface(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("x"), (F.col("l_tax") * 100).alias("z")), "l_quantity", ["x", "z"]


@query(f"""WITH {_WHOLE}, a AS (SELECT 'linear' AS source, 2 AS df, s1 + s2 AS ss, (s1 + s2) / 2 / (rest / dof) AS f, 2 AS d1, dof AS d2 FROM e
UNION ALL SELECT 'square', 2, s3 + s4, (s3 + s4) / 2 / (rest / dof), 2, dof FROM e UNION ALL SELECT 'cross', 1, s5, s5 / (rest / dof), 1, dof FROM e UNION ALL SELECT 'residual', dof, rest, NULL, NULL, NULL FROM e
UNION ALL SELECT 'lack_of_fit', dof - free, rest - pure, ((rest - pure) / (dof - free)) / (pure / free), dof - free, free FROM e UNION ALL SELECT 'pure_error', free, pure, NULL, NULL, NULL FROM e)
SELECT source, df::BIGINT AS df, {r("ss", "ss", 3)}, {r("f", "f", 4)}, CASE WHEN f IS NOT NULL THEN round({f_tail_large("f", "d1", "d2")}, 4) + 0.0 END AS p FROM a""")
def surface_anova(spark, sf_dir):
    out = D.surface_anova(*_surface(spark, sf_dir))
    return out.select("source", "df", *((F.round(c, k) + 0.0).alias(c) for c, k in (("ss", 3), ("f", 4), ("p", 4))))


_NAMES = {0: ("constant", "constant"), 1: ("x", "linear"), 2: ("z", "linear"), 3: ("x^2", "square"), 4: ("z^2", "square"), 5: ("x:z", "cross")}
_LAST = ", ".join(_orthogonal([c for c in range(6) if c != last] + [last], f"p{last}_") for last in range(6))
_COEFFICIENTS = f"{_WHOLE}, {_LAST}, w AS ({' UNION ALL '.join(f'''SELECT '{name}' AS term, '{kind}' AS kind, p.u{c} / p.l{c} AS b, sqrt(rest / dof / p.l{c}) AS se, dof FROM p{c}_ p, e''' for c, (name, kind) in _NAMES.items())})"


@query(f"WITH {_COEFFICIENTS} SELECT term, kind, {r('b', 'coefficient', 5)}, {r('se', 'se', 5)}, {r('b / se', 't', 4)}, {r(both_tails('(b / se)', 'dof'), 'p', 4)} FROM w")
def surface_terms(spark, sf_dir):
    out = D.surface_terms(*_surface(spark, sf_dir))
    return out.select("term", "kind", *((F.round(c, k) + 0.0).alias(c) for c, k in (("coefficient", 5), ("se", 5), ("t", 4), ("p", 4))))


@query(f"""WITH {_COEFFICIENTS}, m AS (SELECT {', '.join(f"max(b) FILTER (WHERE term = '{name}') AS b{c}" for c, (name, _) in _NAMES.items())} FROM w),
d AS (SELECT *, (b5 * b2 - 2 * b4 * b1) / (4 * b3 * b4 - b5 * b5) AS x, (b5 * b1 - 2 * b3 * b2) / (4 * b3 * b4 - b5 * b5) AS z, (b3 + b4) / 2 AS mid, sqrt((b3 - b4) ^ 2 / 4 + b5 * b5 / 4) AS arm FROM m),
n AS (SELECT *, b0 + (b1 * x + b2 * z) / 2 AS response, CASE WHEN mid + arm < 0 THEN 'maximum' WHEN mid - arm > 0 THEN 'minimum' ELSE 'saddle' END AS nature FROM d)
SELECT 'x' AS factor, {r("x", "at", 3)}, {r("response", "response", 4)}, {r("mid - arm", "curvature", 5)}, nature FROM n UNION ALL SELECT 'z', {r("z", "at", 3)}, {r("response", "response", 4)}, {r("mid + arm", "curvature", 5)}, nature FROM n""")
def stationary_point(spark, sf_dir):
    out = D.stationary_point(*_surface(spark, sf_dir))
    return out.select("factor", *((F.round(c, k) + 0.0).alias(c) for c, k in (("at", 3), ("response", 4), ("curvature", 5))), "nature")


# Gauges are return flags, parts quantities; a line is accepted where its quantity and an error by its part pass the limit of 25.
_ACCEPTS = "a AS (SELECT l_returnflag AS gauge, l_quantity AS reference, floor(20.0 * count(*) FILTER (WHERE l_quantity + l_partkey % 21 - 10 > 25) / count(*))::BIGINT AS accepts FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_ACCEPTS}, g AS (SELECT gauge, count(*) AS parts, count(*) FILTER (WHERE accepts BETWEEN 1 AND 19) AS between_ends, max(reference) FILTER (WHERE accepts = 0) AS low, min(reference) FILTER (WHERE accepts = 20) AS high FROM a GROUP BY 1),
p AS (SELECT gauge, reference, CASE WHEN accepts = 0 AND reference = low THEN 0.025 WHEN accepts = 20 AND reference = high THEN 0.975 WHEN accepts < 10 THEN (accepts + 0.5) / 20 WHEN accepts > 10 THEN (accepts - 0.5) / 20 ELSE 0.5 END::DOUBLE AS p
  FROM a JOIN g USING (gauge) WHERE accepts BETWEEN 1 AND 19 OR accepts = 0 AND reference = low OR accepts = 20 AND reference = high),
{normal_points("p", "gauge, reference", "p")}, l AS (SELECT gauge, regr_slope(reference, z) AS b, regr_intercept(reference, z) AS a FROM zs GROUP BY 1),
s AS (SELECT gauge, 25 - a AS bias, 2 * 2.5758293035489004 * b / 1.08 / 5.15 AS sd, a FROM l)
SELECT gauge, parts, between_ends, NULL::VARCHAR AS refused, {r("a", "x50", 4)}, {r("bias", "bias", 4)}, {r("sd", "repeatability", 4)}, {r("6.078 * abs(bias) / sd", "t", 3)}, 6.078 * abs(bias) / sd > 2.093 AS biased FROM s JOIN g USING (gauge)""")
def analytic_gauge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("gauge"), F.col("l_quantity").alias("reference"))
    counts = lines.agg(F.floor(20.0 * F.count_if(F.expr("l_quantity + l_partkey % 21 - 10 > 25")) / F.count("*")).alias("accepts"))
    out = A.analytic_method(counts, 25.0)
    return out.select(*((F.round(c, 3 if c == "t" else 4) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))
