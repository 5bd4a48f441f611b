"""Pearson curves against families with known quantiles."""

import math

import numpy as np
import pytest

from steadyline.functions.numeric import NORMAL, beta_ppf, chi2_ppf
from steadyline.operators import pearson as P

PROBABILITIES = (0.00135, 0.2, 0.5, 0.9, 0.99865)


def test_normal_and_gamma_curves():
    assert [P.Curve(0.0, 3.0).quantile(p) for p in PROBABILITIES] == pytest.approx([NORMAL.inv_cdf(p) for p in PROBABILITIES], abs=1e-7)
    for sign in (1, -1):
        curve = P.Curve(sign * 2 / math.sqrt(4), 3 + 6 / 4)  # shape 4
        want = [sign * (chi2_ppf(p if sign > 0 else 1 - p, 8) / 2 - 4) / 2 for p in PROBABILITIES]
        assert curve.kind == "III" and [curve.quantile(p) for p in PROBABILITIES] == pytest.approx(want, abs=1e-6)


def test_beta_curve():
    a, b = 2.5, 4.0
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    skew = 2 * (b - a) * math.sqrt(a + b + 1) / ((a + b + 2) * math.sqrt(a * b))
    kurt = 3 + 6 * ((a - b) ** 2 * (a + b + 1) - a * b * (a + b + 2)) / (a * b * (a + b + 2) * (a + b + 3))
    curve = P.Curve(skew, kurt)
    assert curve.kind == "I" and [curve.quantile(p) for p in PROBABILITIES] == pytest.approx([(beta_ppf(p, a, b) - mean) / math.sqrt(var) for p in PROBABILITIES], abs=1e-6)


def test_curves_with_heavy_tails():
    """Inverse gamma (V), a ratio of gammas (VI), and t with ten degrees of freedom (IV without skew)."""
    a = 8.0
    skew, kurt = 4 * math.sqrt(a - 2) / (a - 3), 3 + 6 * (5 * a - 11) / ((a - 3) * (a - 4))
    sd = 1 / ((a - 1) * math.sqrt(a - 2))
    got = P.Curve(skew, kurt)
    assert got.kind == "V" and [got.quantile(p) for p in PROBABILITIES] == pytest.approx([(2 / chi2_ppf(1 - p, 2 * a) - 1 / (a - 1)) / sd for p in PROBABILITIES], abs=1e-5)
    t = P.Curve(0.0, 4.0)
    rng = np.random.default_rng(1)
    sample = np.sort(rng.standard_t(10, 4_000_000)) / math.sqrt(10 / 8)
    assert t.kind == "IV" and [t.quantile(p) for p in PROBABILITIES] == pytest.approx([sample[int(p * len(sample))] for p in PROBABILITIES], abs=0.03)
    mirrored = P.Curve(-1.0, 5.2), P.Curve(1.0, 5.2)
    assert {c.kind for c in mirrored} == {"IV"} and mirrored[0].quantile(0.01) == pytest.approx(-mirrored[1].quantile(0.99), abs=1e-7)
    six = P.Curve(2.0, 9.6)
    assert six.kind == "VI" and six.quantile(0.5) < 0
    # Moments of the curve, by its own quantiles.
    x = np.array([six.quantile(p) for p in (np.arange(300) + 0.5) / 300])
    assert x.mean() == pytest.approx(0, abs=0.01) and x.std() == pytest.approx(1, abs=0.08)


@pytest.mark.parametrize(("skew", "kurt"), [(2.0, 5.0), (0.0, 1.5), (1.0, 1.9), (math.nan, 3.0)])
def test_no_curve(skew, kurt):
    with pytest.raises(P.NoCurve):
        P.Curve(skew, kurt)


def test_charts(spark):
    rng = np.random.default_rng(6)
    series = {"bell": rng.normal(5, 1, 400), "skew": rng.gamma(4, 2, 400), "short": rng.normal(size=29), "flat": [1.0] * 50, "two": [0.0, 1.0] * 40}
    df = spark.createDataFrame([(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)], "series string, pos long, value double")
    found = {r["series"]: r for r in P.pearson_quantiles(P.shapes(df)).collect()}
    assert set(found) == {"bell", "skew", "two"} and found["two"]["kind"] is None and "form" in found["two"]["reason"] or found["two"]["reason"]
    rows = P.pearson_chart(df).collect()
    assert {r["series"] for r in rows} == {"bell", "skew"} and len(rows) == 800
    skew = next(r for r in rows if r["series"] == "skew")
    assert skew["ucl"] - skew["center"] > 1.5 * (skew["center"] - skew["lcl"])
    first = P.pearson_chart(df, reference_n=100).filter("series = 'bell'").first()
    assert first["center"] == pytest.approx(series["bell"][:100].mean())
    fitted = {r["series"]: r for r in P.fitted_chart(df).collect()}
    assert fitted["bell"]["family"] == "normal" and fitted["bell"]["ucl"] == pytest.approx(series["bell"].mean() + 3 * series["bell"].std()) and fitted["skew"]["lcl"] > 0
    assert P.pearson_chart(df.limit(0)).count() == 0 and P.fitted_chart(df.limit(0)).count() == 0
