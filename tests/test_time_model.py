"""Modes, the time model's decision, mixtures and bootstrap intervals against plain Python."""

import math
import random

import numpy as np
import pytest

from steadyline.operators import mixtures as B
from steadyline.operators import time_model as T
from steadyline.operators.measurements import whole_subgroups

ROWS = "series string, pos long, value double"


def frame(spark, **series):
    return spark.createDataFrame([(s, i, float(v)) for s, values in series.items() for i, v in enumerate(values)], ROWS)


def draw(seed, n, mean=0.0, sd=1.0):
    return np.random.default_rng(seed).normal(mean, sd, n)


def test_peaks():
    assert T.peaks(np.array([0, 1, 0, 2, 2, 0, 1.95, 1.9, 2.0, 0])) == 3
    assert T.peaks(np.array([0.0, 5, 4.9, 5.1, 0])) == 1  # a dip too small to part them
    assert T.peaks(np.zeros(9)) == 0 and T.peaks(np.arange(9.0)) == 0


def test_modes(spark):
    df = frame(spark, one=draw(1, 400), two=np.r_[draw(2, 200), draw(3, 200, 6)], three=np.r_[draw(2, 200), draw(3, 200, 8), draw(4, 200, 16)], few=[0, 9] * 10, flat=[2.0] * 40, far=np.r_[draw(5, 400), [1e4]])
    assert {r["series"]: r["modes"] for r in T.modes(df).collect()} == {"one": 1, "two": 2, "three": 3, "few": 1, "flat": 1, "far": 1}


def processes():
    k, n = 60, 5
    base = [draw(100 + i, k * n) for i in range(8)]
    at = np.repeat(np.arange(k), n)
    return {
        "A1": base[0],
        "A2": np.exp(base[1]),
        "B": base[2] * np.where(at % 2, 4.0, 0.5),
        "C1": base[3] + np.repeat(draw(7, k, 0, 1.0), n),
        "C3": base[4] + 0.15 * at,
        "C4": base[5] + 8.0 * (at % 2),
        "D": base[6] * np.where(at % 2, 4.0, 0.5) + 9.0 * (at % 3),
    }


def test_models_of_simulated_processes(spark):
    df = frame(spark, **processes(), short=draw(9, 20))
    found = T.evidence(whole_subgroups(df, 5), df, 5).cache()
    got = {r["series"]: r for r in T.decide(found, 5).collect()}
    assert {s: r["model"] for s, r in got.items()} == {**{s: s for s in processes()}, "short": None}
    assert got["short"]["reasons"] == "not_enough_data" and got["short"]["confidence"] is None
    assert got["C4"]["reasons"] == "variation_constant,location_changes,random_location,multimodal"
    assert (got["A1"]["in_control"], got["A1"]["control_chart"], got["D"]["analysis_chart"], got["B"]["sample_size"]) == (True, "shewhart", "extended", "bigger")
    assert got["C3"]["frequency"] == "higher"
    # Blocks cut from a plain series, and hints that disagree, are less certain; hints that agree are not.
    sure, hint = next((s, h) for s, h in (("D", "multi_stream"), ("C4", "tool_or_batch_changes"), ("A2", "natural_limit")) if got[s]["confidence"] == "high")
    level = lambda **kw: {r["series"]: r["confidence"] for r in T.decide(found, 5, **kw).collect()}[sure]
    assert (level(blocks=True), level(hints=["spindle_wear"]), level(hints=[hint]), level(hints=[hint, "spindle_wear"])) == ("medium", "medium", "high", "medium")
    with pytest.raises(ValueError):
        T.decide(found, 5, hints=["luck"])


def test_borderline_evidence_has_alternatives(spark):
    columns = "series string, k long, anova_p double, trend_p double, trend_r2 double, after_trend_p double, dispersion_p double, dispersion_ratio double, instantaneous_p double, resulting_p double, modes int, modes_of_means int"
    rows = [("near", 40, 0.03, 0.5, 0.1, 0.5, 0.9, 1.0, 0.5, 0.5, 1, 1), ("clear", 40, 0.5, 0.5, 0.1, 0.5, 0.9, 1.0, 0.5, 0.5, 1, 1), ("small", 40, 0.5, 0.5, 0.1, 0.5, 0.0, 1.5, 0.5, 0.5, 1, 1), ("strict", 14, 0.005, 0.5, 0.1, 0.5, 0.9, 1.0, 0.5, 0.5, 1, 1)]
    got = {r["series"]: r for r in T.decide(spark.createDataFrame(rows, columns), 5).collect()}
    assert (got["near"]["model"], got["near"]["alternatives"], got["near"]["borderline"], got["near"]["confidence"]) == ("A1", "C1", "anova_p", "medium")
    assert (got["clear"]["alternatives"], got["clear"]["borderline"], got["clear"]["confidence"]) == ("", "", "high")
    assert got["small"]["model"] == "A1"  # a dispersion test alone is no finding under the least ratio
    assert (got["strict"]["model"], got["strict"]["alternatives"], got["strict"]["confidence"]) == ("C1", "A1", "low")


def test_mixtures(spark):
    two = np.r_[draw(11, 150, 0, 1), draw(12, 100, 8, 2)]
    df = frame(spark, two=two, few=draw(1, 29), flat=[1.0] * 50, small=draw(5, 31), heavy=np.repeat([1.0, 2.0, 5.0], 40))
    whole = B.mixture_fits(df, rounds=60).collect()
    assert {r["series"] for r in whole} == {"two", "small", "heavy"} and {r["k"] for r in whole if r["series"] == "small"} == {2}
    fit = [r for r in whole if r["series"] == "two" and r["chosen"]]
    assert [r["k"] for r in fit] == [2, 2] and [r["weight"] for r in fit] == pytest.approx([0.6, 0.4], abs=0.05)
    assert [r["mean"] for r in fit] == pytest.approx([0, 8], abs=0.5) and [r["sd"] for r in fit] == pytest.approx([1, 2], abs=0.35)
    density = sum(r["weight"] / r["sd"] / math.sqrt(2 * math.pi) * np.exp(-0.5 * ((two - r["mean"]) / r["sd"]) ** 2) for r in fit)
    assert fit[0]["loglik"] == pytest.approx(np.log(density).sum()) and fit[0]["bic"] == pytest.approx(-2 * np.log(density).sum() + 5 * math.log(250))
    # A series in many packs, a round of all packs at a time: the same fits, and the same rounds.
    parts = B.mixture_fits(df, rounds=60, pack=64).collect()
    key = lambda r: (r["series"], r["k"], r["j"])
    for a, b in zip(sorted(whole, key=key), sorted(parts, key=key), strict=True):
        assert key(a) == key(b) and (a["chosen"], a["rounds"]) == (b["chosen"], b["rounds"])
        assert [a[c] for c in ("weight", "mean", "sd", "loglik")] == pytest.approx([b[c] for c in ("weight", "mean", "sd", "loglik")], rel=1e-6, abs=1e-9)
    assert B.mixture_fits(df.limit(0)).count() == 0


def test_mixtures_of_repeated_values_need_no_pass_per_round(spark, monkeypatch):
    """Equal values are one with a count, so many rows of few values are finished in one task."""
    x = [float(v % 37 + 60 * (v % 3 == 0)) for v in range(400)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "series string, pos long, value double")
    cuts = []
    own = B.cut
    monkeypatch.setattr(B, "cut", lambda frame: cuts.append(1) or own(frame))
    got = B.mixture_fits(df, pack=100).collect()
    assert len(cuts) < 8
    assert {r.k for r in got} == {2, 3, 4, 5} and sum(r.weight for r in got if r.k == 2) == pytest.approx(1)


def test_bootstrap(spark):
    rng = random.Random(4)
    x = [math.exp(rng.gauss(1, 0.4)) for _ in range(150)]
    df = frame(spark, a=x, tiny=[1.0, 2.0], flat=[3.0] * 9, minus=[-1.0] + x)
    run = lambda seed, **kw: {r["series"]: r for r in B.bootstrap_intervals(df.repartition(3), 0.2, 12.0, "lognormal", replicates=60, seed=seed, **kw).collect()}
    one, again, other = run(1), run(1), run(2)
    assert one == again and one != other and set(one) == {"a", "tiny"}
    m, s = np.log(x).mean(), np.log(x).std()
    pk = min((12 - math.exp(m)) / (math.exp(m + 3 * s) - math.exp(m)), (math.exp(m) - 0.2) / (math.exp(m) - math.exp(m - 3 * s)))
    assert one["a"]["succeeded"] == 60 and one["a"]["pk_low"] < pk < one["a"]["pk_high"]
    assert one["tiny"]["succeeded"] < 48 and one["tiny"]["pk_low"] is None and one["tiny"]["p_high"] is None
    with pytest.raises(ValueError):
        B.bootstrap_intervals(df, 0.2, 12.0, "weibull")


def test_bootstrap_covers_the_index(spark):
    """Of 60 samples with a known index, intervals of 90 per cent hold it in most."""
    rng = np.random.default_rng(8)
    df = frame(spark, **{f"s{i}": rng.normal(10, 1, 120) for i in range(60)})
    want = min(14 - 10, 10 - 7) / 3
    got = B.bootstrap_intervals(df, 7.0, 14.0, replicates=100, confidence=0.9).collect()
    assert sum(r["pk_low"] <= want <= r["pk_high"] for r in got) >= 46


def test_draws_are_poisson():
    w = np.concatenate([B.draws(np.arange(20_000), b, 7) for b in range(5)])
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.03) and np.mean(w == 0) == pytest.approx(math.exp(-1), abs=0.005)
    assert abs(np.corrcoef(B.draws(np.arange(20_000), 0, 7), B.draws(np.arange(20_000), 1, 7))[0, 1]) < 0.02


def test_bootstrap_of_a_lognormal_with_a_zero(spark):
    df = spark.createDataFrame([("a", i, float(i % 9)) for i in range(60)], "series string, pos long, value double")
    got = B.bootstrap_intervals(df, 1.0, 9.0, "lognormal", replicates=30).first()
    assert got.succeeded == 30 and all(math.isnan(got[c]) for c in ("p_low", "p_high", "pk_low", "pk_high"))
