"""SQL of tail probabilities and quantiles that DuckDB lacks: Simpson's rule over a list, and halving of intervals."""

from __future__ import annotations

PANELS = 2000


def _simpson(integrand: str, width: str) -> str:
    """Integral of `integrand`, an expression of s, from 0 to `width`."""
    s = f"(i * ({width}) / {PANELS})"
    weight = f"CASE WHEN i = 0 OR i = {PANELS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(({width}) / {PANELS} / 3 * list_sum(list_transform(range(0, {PANELS + 1}), lambda i: ({weight}) * ({integrand.replace('{s}', s)}))))"


def f_tail(f: str, d1: str, d2: str) -> str:
    """P(F > f): the incomplete beta function at x = d2 / (d2 + d1 f), written as an integral over s with t = x exp(-s^2)."""
    a, b = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)"
    x = f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    front = f"exp({a} * ln({x}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
    return f"({front} * {_simpson(f'2 * {{s}} * exp(-{a} * {{s}} * {{s}}) * pow(greatest(1 - {x} * exp(-{{s}} * {{s}}), 1e-300), {b} - 1)', f'sqrt(40.0 / {a})')})"


def chi2_tail(x: str, df: str) -> str:
    """P(X > x): the incomplete gamma function, with t = x / 2 + s."""
    a = f"(({df}) / 2.0)"
    front = f"exp(-({x}) / 2 - lgamma({a}))"
    return f"({front} * {_simpson(f'exp(-{{s}}) * pow(({x}) / 2 + {{s}}, {a} - 1)', f'40.0 + 4 * {a}')})"


def f_tail_large(f: str, d1: str, d2: str) -> str:
    """P(F > f) for many degrees of freedom: all in one exponent, over a width that reaches nine deviations of the beta distribution below its mean."""
    a, b = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)"
    x = f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    low = f"greatest({x} / 1000, {a} / ({a} + {b}) - 9 * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1))))"
    inner = f"2 * {{s}} * exp({a} * ln({x}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}) - {a} * {{s}} * {{s}} + ({b} - 1) * ln(greatest(1 - {x} * exp(-{{s}} * {{s}}), 1e-300)))"
    return _simpson(inner, f"sqrt(40.0 / {a} + greatest(0, ln({x} / {low})))")


def both_tails(t: str, df: str) -> str:
    """P(|T| > |t|), from the density between: no singular end, so right near 1 too."""
    front = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi() * ({df}))"
    return f"greatest(0, 1 - 2 * {front} * {_simpson(f'exp(-(({df}) + 1) / 2.0 * ln(1 + {{s}} * {{s}} / ({df})))', f'least(abs({t}), 40.0)')})"


def chi2_tail_large(x: str, df: str) -> str:
    """P(X > x) where the powers in `chi2_tail` would overflow: all in one exponent, over a width of twelve deviations."""
    a = f"(({df}) / 2.0)"
    return _simpson(f"exp(-{{s}} + ({a} - 1) * ln(({x}) / 2 + {{s}}) - ({x}) / 2 - lgamma({a}))", f"40.0 + 12 * sqrt({a}) + greatest(0, {a} - ({x}) / 2)")


def normal_tail(z: str) -> str:
    """P(Z > z) for z of 0 or more, as exp(-z^2 / 2) times an integral."""
    return f"(exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * {_simpson(f'exp(-({z}) * {{s}} - {{s}} * {{s}} / 2)', '9.0')})"


def solved(rows: str, keys: str, tail: str, low: float = 0.0, high: float = 200.0, steps: int = 60) -> str:
    """Two CTEs: `solved` has the keys of `rows` and the x where the falling expression `tail` of x and the keys comes to `target`, a column of `rows`."""
    return f"""halved AS (SELECT {keys}, target, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi, 0 AS step FROM {rows}
UNION ALL SELECT {keys}, target, CASE WHEN v > target THEN x ELSE lo END, CASE WHEN v > target THEN hi ELSE x END, step + 1 FROM (SELECT *, {tail} AS v FROM (SELECT *, (lo + hi) / 2 AS x FROM halved WHERE step < {steps}))),
solved AS (SELECT {keys}, (lo + hi) / 2 AS x FROM halved WHERE step = {steps})"""


def normal_points(rows: str, keys: str, p: str, name: str = "zs") -> str:
    """CTEs, the last of them `name`: the keys of `rows` and z, the standard normal quantile of the expression `p`, by a rational first value and two of Newton's steps."""
    step = f"z + ({normal_tail('z')} - q) / (exp(-z * z / 2) / sqrt(2 * pi()))"
    return f"""{name}0 AS (SELECT {keys}, {p} AS p, least({p}, 1 - ({p})) AS q FROM {rows}),
{name}1 AS (SELECT {keys}, p, q, greatest(0, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)) AS z FROM (SELECT *, sqrt(-2 * ln(q)) AS t FROM {name}0)),
{name}2 AS (SELECT {keys}, p, q, greatest(0, {step}) AS z FROM {name}1), {name}3 AS (SELECT {keys}, p, q, {step} AS z FROM {name}2),
{name} AS (SELECT {keys}, CASE WHEN p < 0.5 THEN -z ELSE z END AS z FROM {name}3)"""
