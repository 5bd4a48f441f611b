"""Multi-state procedure: screening against a plain loop, and the types of dispersion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyline.functions.numeric import grubbs_critical
from steadyline.operators import states as S

ROWS = "series string, state string, value double"


def frame(spark, **processes):
    return spark.createDataFrame([(p, s, float(v)) for p, states in processes.items() for s, values in states.items() for v in values], ROWS)


def peeled(states, alpha=0.05):
    """The screening with all values at hand; None where over a third would go."""
    work = {k: list(map(float, v)) for k, v in states.items()}
    total, removed = sum(map(len, work.values())), []

    def far(x):
        if len(x) < 3 or np.std(x) == 0:
            return None
        d = np.abs(np.array(x) - np.mean(x))
        g = d.max() / np.std(x, ddof=1)
        return (int(d.argmax()), g) if g > grubbs_critical(len(x), alpha) else None

    while True:
        hit = next(((k, work[k][f[0]]) for k in sorted(work) if (f := far(work[k]))), None)
        if hit is None:
            every = [(k, x) for k in sorted(work) for x in work[k]]
            f = far([x for _, x in every])
            hit = f and every[f[0]]
        if not hit:
            return removed, work
        if len(removed) + 1 > total / 3:
            return None
        k, x = hit
        work[k].remove(x)
        removed.append((k, x, x - np.mean(work[k]) if work[k] else None))


def cases():
    rng = np.random.default_rng(3)
    return {
        "one": {"a": [10.0, 10.1, 9.9, 10.0, 10.1, 9.95], "b": [10.1, 10.0, 12.0, 10.05, 9.95, 10.0], "c": [10.0, 10.05, 9.95, 10.1, 10.0, 9.9]},
        "many": {k: np.r_[rng.normal(0, 1, 80), rng.normal(0, 60, 6)] for k in "abc"},
        "skew": {k: rng.exponential(1, 300) for k in "ab"},
        "whole": {"a": [5.0] * 12 + [5.01], "b": [5.0, 5.02] * 6, "c": [40.0, 40.0]},
        "clean": {k: rng.normal(0, 1, 30) for k in "ab"},
    }


@pytest.mark.parametrize("ends", [1, 2, 32])
def test_screening(spark, ends):
    given = cases()
    states, removed = S.screened(frame(spark, **given), ends=ends)
    states, removed = states.collect(), removed.orderBy("series", "step").collect()
    for p, process in given.items():
        want, left = peeled(process)
        got = [(r["state"], r["value"], r["delta"]) for r in removed if r["series"] == p]
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2] == pytest.approx(w[2]) for g, w in zip(got, want, strict=True))
        for r in (r for r in states if r["series"] == p):
            v = left[r["state"]]
            if not v:
                assert (r["n"], r["mean"], r["var"], r["low"]) == (0, None, None, None)
                continue
            assert (r["planned"], r["n"], r["low"], r["high"], r["usable"]) == (len(process[r["state"]]), len(v), min(v), max(v), True)
            assert (r["mean"], r["var"]) == (pytest.approx(np.mean(v)), pytest.approx(np.var(v, ddof=1), rel=1e-6, abs=1e-12))
    assert any(r["series"] == "whole" and r["state"] == "c" for r in removed)


def test_too_many_outliers(spark):
    rows = {"a": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 9.0, 50.0, 400.0], "b": [1.0]}
    got = S.multistate_performance(frame(spark, p=rows, q={"a": [1.0, 2.0, 3.0]}, r={"a": [1.0, 2.0], "b": [1.0]}), 0, 9).collect()
    by = {r["series"]: r for r in got}
    assert by["p"]["usable"] is False and peeled(rows) is None
    assert [by[p]["type"] for p in "pqr"] == [None] * 3 and [by[p]["pmk"] for p in "pqr"] == [None] * 3


def test_forced_variances(spark):
    rows = {"a": [143.1] * 5, "b": [140.2, 140.2, 140.2, 140.1], "c": [140.2, 140.0, 140.2, 140.3, 140.6], "d": [1.0] * 12}
    facts = spark.createDataFrame([(k, float(np.var(v, ddof=1)), len(v), max(v) - min(v)) for k, v in rows.items()], "state string, var double, n long, spread double")
    got = {r["state"]: r["v"] for r in facts.select("state", S.forced(F.col("var"), F.col("n"), F.col("spread"), 0.1).alias("v")).collect()}
    assert [got[s] for s in "abd"] == pytest.approx([0.0016, 0.0074, 0.001]) and got["c"] == pytest.approx(np.var(rows["c"], ddof=1))
    # States without variation are compared once the resolution is known.
    flat = frame(spark, p={"a": [1.0] * 3, "b": [2.0] * 3, "c": [1.0, 1.1, 1.2]})
    assert S.multistate_performance(flat, 0, 9).first()["type"] is None and S.multistate_performance(flat, 0, 9, resolution=0.1).first()["width_p"] > 0.1


def test_types(spark):
    rng = np.random.default_rng(10)
    draw = lambda *of, n=12: {k: rng.normal(m, s, n) for k, (m, s) in zip("abc", of, strict=False)}
    given = {"same": draw((10, 0.2), (10, 0.2), (10, 0.2)), "shift": draw((10, 0.2), (11, 0.2), (10.5, 0.2)), "wide": draw((10, 0.1), (10, 0.6), (10, 0.1)), "mixed": draw((10, 0.1), (11, 0.6), (10, 0.1)), "two": draw((10, 0.2), (10, 0.9), n=20)}
    df = frame(spark, **given)
    run = lambda **kw: {r["series"]: r for r in S.multistate_performance(df, 8.0, 13.0, **kw).collect()}
    fixed, moving, decided = run(alpha=0.01), run(alpha=0.01, delta_m_variable=True, delta_m_star=1.5, location="median"), run(alpha=0.01, widths_equal=True, locations_equal=True)
    assert {p: r["type"] for p, r in fixed.items()} == {"same": 0, "shift": 1, "wide": 3, "mixed": 4, "two": 3}
    assert {p: r["type"] for p, r in moving.items()} == {"same": 0, "shift": 2, "wide": 3, "mixed": 5, "two": 3}
    assert {r["type"] for r in decided.values()} == {0}
    left = {p: peeled(states, 0.01)[1] for p, states in given.items()}
    r, v = fixed["shift"], left["shift"]
    sigma = math.sqrt(sum((len(x) - 1) * np.var(x, ddof=1) for x in v.values()) / sum(len(x) - 1 for x in v.values()))
    means = [np.mean(x) for x in v.values()]
    assert (r["sigma"], r["delta_m"], r["pm"]) == (pytest.approx(sigma), pytest.approx(max(means) - min(means)), pytest.approx((5 - max(means) + min(means)) / (6 * sigma)))
    assert (r["pmk_l"], r["pmk_u"]) == (pytest.approx((min(means) - 8) / (3 * sigma)), pytest.approx((13 - max(means)) / (3 * sigma)))
    assert r["location_statistic"] == pytest.approx(12 * np.var(means, ddof=1) / sigma**2)
    assert moving["shift"]["pm"] == pytest.approx(5 / (6 * sigma + 1.5)) and moving["shift"]["pmk_l"] == pytest.approx((min(np.median(x) for x in v.values()) - 8) / (3 * sigma))
    d = {k: 3 * np.std(x, ddof=1) for k, x in left["mixed"].items()}
    c = {k: np.mean(x) for k, x in left["mixed"].items()}
    low, high = min(d, key=lambda k: c[k] - d[k]), max(d, key=lambda k: c[k] + d[k])
    assert fixed["mixed"]["pm"] == pytest.approx((5 - max(c.values()) + min(c.values())) / (d[low] + d[high]))
    m = {k: np.median(x) for k, x in left["mixed"].items()}
    assert moving["mixed"]["pmk"] == pytest.approx(min(min((m[k] - 8) / d[k], (13 - m[k]) / d[k]) for k in d))
    x, y = left["two"]["a"], left["two"]["b"]
    assert fixed["two"]["width_statistic"] == pytest.approx(np.var(x, ddof=1) / np.var(y, ddof=1))
    assert fixed["two"]["location_statistic"] == pytest.approx((np.mean(x) - np.mean(y)) / math.sqrt(np.var(x, ddof=1) / len(x) + np.var(y, ddof=1) / len(y)))


def test_a_real_outlier_widens_its_side(spark):
    df = frame(spark, p={"a": [10.0, 10.1, 9.9, 10.0, 8.0], "b": [10.2, 10.3, 10.1, 10.2, 10.25]})
    run = lambda **kw: S.multistate_performance(df, 7.0, 13.0, widths_equal=True, locations_equal=False, **kw).first()
    plain, low = run(), run(outlier_physical=True, outlier_direction="negative")
    assert plain["removed"] == 1 and low["pmk_u"] == plain["pmk_u"]
    assert low["pmk_l"] == pytest.approx((10 - 7) / (3 * low["sigma"] + 2.0)) and plain["pmk_l"] == pytest.approx(3 / (3 * plain["sigma"]))
    with pytest.raises(ValueError):
        run(location="mode")


def test_infinite_values_go_first(spark):
    """The logarithm of 0 is no part of a mean: it goes, and counts among the planned and the gone."""
    rows = [("a", state, float(v % 7 + k)) for k, state in enumerate("xy") for v in range(40)] + [("a", "x", float("-inf"))] * 3
    df = spark.createDataFrame(rows, "series string, state string, value double")
    got = {r.state: r for r in S.screened(df)[0].collect()}
    assert (got["x"].planned, got["x"].n, got["x"].low_gone, got["x"].low) == (43, 40, 3, 0.0) and got["y"].low_gone == 0
    assert S.multistate_performance(df, -20.0, 30.0).first().removed == 3
