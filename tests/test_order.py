"""Order statistics against plain Python, with ties, cut series and empty tables."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from steadyline.operators import order as O

ROWS = "series string, pos long, value double"


def frame(spark, **series):
    return spark.createDataFrame([(s, i, v) for s, values in series.items() for i, v in enumerate(values)], ROWS)


def tied(seed, n, levels):
    rng = random.Random(seed)
    return [float(rng.randrange(levels)) for _ in range(n)]


def test_ranks_and_quantiles(spark):
    values = {"a": tied(1, 200, 7), "b": [3.0], "c": [1.0, None, 2.0], "d": [5.0] * 50 + [6.0]}
    df = frame(spark, **values)
    got = O.ordered_values(df, "series").collect()
    for r in got:
        own = sorted(v for v in values[r["series"]] if v is not None)
        assert (r["count"], r["before"], r["n"]) == (own.count(r["value"]), sum(v < r["value"] for v in own), len(own))
    for r in O.quantiles(df, {"low": 0.1, "mid": 0.5, "high": 0.973}, "series").collect():
        own = [v for v in values[r["series"]] if v is not None]
        assert [r["low"], r["mid"], r["high"]] == pytest.approx(list(np.quantile(own, [0.1, 0.5, 0.973])))
    assert O.medians(df.limit(0), "series").count() == 0


def test_anderson_darling_with_ties(spark):
    values = [v + 1 for v in tied(2, 60, 9)]
    m, s = float(np.mean(values)), float(np.std(values))
    fits = spark.createDataFrame([("a", "normal", m, s), ("a", "exponential", m, None), ("a", "weibull", 1.7, m), ("a", "gamma", 2.5, m / 2.5)], "series string, family string, a double, b double")
    got = {r["family"]: r["a2"] for r in O.anderson_darling(frame(spark, a=values), fits).collect()}
    xs, n = np.sort(values), len(values)
    i = np.arange(1, n + 1)
    for family, cdf in (("normal", np.array([NormalDist(m, s).cdf(x) for x in xs])), ("exponential", 1 - np.exp(-xs / m)), ("weibull", 1 - np.exp(-((xs / m) ** 1.7)))):
        assert got[family] == pytest.approx(-n - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))), rel=1e-9)
    # A family that describes the values lies nearer than one that does not.
    assert got["normal"] < got["exponential"] and got["gamma"] < got["exponential"]


@pytest.mark.parametrize("piece", [7, 65_536])
@pytest.mark.parametrize("side", ["upper", "lower"])
def test_plot_correlation(spark, monkeypatch, piece, side):
    monkeypatch.setattr(O, "PIECE", piece)
    values = [v + 1 for v in tied(3, 61, 12)]
    fits = spark.createDataFrame([("a", "normal", 5.0, 2.0), ("a", "rayleigh", 4.0, None), ("a", "lognormal", 1.0, 0.5)], "series string, family string, a double, b double")
    got = {r["family"]: r for r in O.plot_correlation(frame(spark, a=values, b=[1.0] * 5), fits.union(spark.createDataFrame([("b", "normal", 1.0, 1.0)], fits.schema)), side).collect() if r["series"] == "a" or r["corr_all"] is not None}
    xs, n = np.sort(values), len(values)
    p = (np.arange(1, n + 1) - 0.3) / (n + 0.4)
    z = np.array([NormalDist().inv_cdf(v) for v in p])
    m = round(0.25 * n)
    own = slice(n - m, n) if side == "upper" else slice(0, m)
    for family, q in (("normal", 5 + 2 * z), ("rayleigh", 4 * np.sqrt(-2 * np.log(1 - p))), ("lognormal", np.exp(1 + 0.5 * z))):
        assert (got[family]["n_tail"], got[family]["corr_all"], got[family]["corr_tail"]) == (m, pytest.approx(np.corrcoef(xs, q)[0, 1]), pytest.approx(np.corrcoef(xs[own], q[own])[0, 1]))
    with pytest.raises(ValueError):
        O.plot_correlation(frame(spark, a=values), fits, "middle")


def test_shapiro_wilk_published_example(spark):
    """Weights of eleven men, the example with which the test was published: W = 0.79 and p under 0.01; an even one has W near 1."""
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    even = [NormalDist().inv_cdf((i - 0.375) / 100.25) for i in range(1, 101)]
    df = frame(spark, men=list(map(float, men)), even=even, few=[1.0, 2.0, 4.0], flat=[2.0] * 20, five=[1.0, 2.0, 3.0, 4.0, 5.5])
    got = {r["series"]: r for r in O.shapiro_wilk(df).collect()}
    assert set(got) == {"men", "even", "five"}
    assert got["men"]["w"] == pytest.approx(0.79, abs=0.005) and 0.001 < got["men"]["p"] < 0.01
    assert got["even"]["w"] > 0.995 and got["even"]["p"] > 0.9 and 0.9 < got["five"]["w"] < 1


@pytest.mark.parametrize("block", [4, 13, 65_536])
def test_rank_trend(spark, block):
    rng = random.Random(block)
    values = {
        "ties": tied(4, 90, 6), "hot": [float(rng.choice([3, 3, 3, 3, 1, 2, 4, 5])) for _ in range(120)], "up": [float(i) for i in range(50)], "down": [float(-i) for i in range(20)],
        "noise": [rng.random() for _ in range(101)], "flat": [1.0] * 9, "one": [1.0], "gaps": [None if i % 5 == 0 else rng.random() for i in range(40)],
    }
    got = {r["series"]: r for r in O.rank_trend(frame(spark, **values), block).collect()}
    assert set(got) == set(values) - {"flat", "one"}
    for name, r in got.items():
        v = [x for x in values[name] if x is not None]
        s = sum(np.sign(v[j] - v[i]) for i in range(len(v)) for j in range(i + 1, len(v)))
        counts = [v.count(x) for x in set(v)]
        pairs = len(v) * (len(v) - 1)
        assert r["s"] == s and r["tau"] == pytest.approx(2 * s / math.sqrt(pairs * (pairs - sum(c * (c - 1) for c in counts))))
        if len(v) > 33 or len(set(v)) < len(v):
            z = s / math.sqrt((pairs * (2 * len(v) + 5) - sum(c * (c - 1) * (2 * c + 5) for c in counts)) / 18)
            assert (r["z"], r["p"]) == (pytest.approx(z), pytest.approx(math.erfc(abs(z) / math.sqrt(2))))
    # Twenty values that only fall: one order of 20! in each direction.
    assert got["down"]["p"] == pytest.approx(2 / math.factorial(20))


def test_empty_tables(spark):
    none = frame(spark, a=[1.0]).limit(0)
    fits = spark.createDataFrame([("a", "normal", 0.0, 1.0)], "series string, family string, a double, b double")
    for out in (O.ordered_values(none, "series"), O.anderson_darling(none, fits), O.plot_correlation(none, fits), O.shapiro_wilk(none), O.rank_trend(none)):
        assert out.count() == 0


def test_grid_steps(spark):
    from steadyline.operators.measurements import resolution

    rows = {"half": [1.5, 3.0, 9.0, 4.5], "cents": [0.07, 0.21, 0.35], "flat": [2.0, 2.0], "none": [0.1, math.pi], "hot": [6.0] * 300 + [10.0, 16.0], "minus": [-8.0, -2.0, 7.0]}
    for parts in (1, 5):
        got = {r["series"]: r["resolution"] for r in resolution(frame(spark, **rows).repartition(parts)).collect()}
        assert got == pytest.approx({"half": 1.5, "cents": 0.14, "hot": 2.0, "minus": 3.0})
    assert resolution(frame(spark, **rows).limit(0)).count() == 0


def test_nested_analysis_of_values_far_from_zero(spark):
    """Sums of squares keep their digits, three levels of unequal sizes take one pass, and an empty table gives nothing."""
    from steadyline.operators.studies import nested_anova

    rng = random.Random(12)
    rows = [(a, b, c, 1e8 + 3 * a + rng.gauss(0, 1)) for a in range(3) for b in range(2 + a) for c in range(2) for _ in range(2 + (a + b + c) % 3)]
    got = nested_anova(spark.createDataFrame(rows, "a int, b int, c int, value double"), "a", "b", "c").collect()
    sums = []
    for depth in range(4):
        groups = {}
        for r in rows:
            groups.setdefault(r[:depth], []).append(r[3] - 1e8)
        sums.append((sum(sum(v) ** 2 / len(v) for v in groups.values()), len(groups)))
    total = sum((r[3] - 1e8) ** 2 for r in rows)
    want = [sums[i][0] - sums[i - 1][0] for i in (1, 2, 3)] + [total - sums[3][0]]
    assert [r["level"] for r in got] == ["a", "b", "c", "error"] and [r["ss"] for r in got] == pytest.approx(want, rel=1e-6)
    assert [r["df"] for r in got] == [2, sums[2][1] - 3, sums[3][1] - sums[2][1], len(rows) - sums[3][1]]
    assert nested_anova(spark.createDataFrame([], "a int, value double"), "a").count() == 0
