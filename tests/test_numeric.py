import math

import pytest

from steadyline.functions import numeric as N


def test_range_constants():
    assert [round(N.d2(n), 3) for n in range(2, 11)] == [1.128, 1.693, 2.059, 2.326, 2.534, 2.704, 2.847, 2.970, 3.078]
    assert [round(N.d3(n), 4) for n in range(2, 11)] == [0.8525, 0.8884, 0.8798, 0.8641, 0.8480, 0.8332, 0.8198, 0.8078, 0.7971]
    assert [round(N.c4(n), 4) for n in range(2, 11)] == [0.7979, 0.8862, 0.9213, 0.9400, 0.9515, 0.9594, 0.9650, 0.9693, 0.9727]
    assert N.w_quantile(5, 0.00135) == pytest.approx(0.397, abs=6e-4)
    assert N.w_quantile(5, 0.99865) == pytest.approx(5.378, abs=6e-4)


def test_sequential_designs():
    assert N.cusum_h(0.5, 370.4) == pytest.approx(4.775, abs=5e-4)
    assert [round(N.cusum_arl(4.775, 0.5, s), 1) for s in (0.4, 1.0, 2.0, 3.0)] == [54.5, 9.9, 3.9, 2.5]
    assert N.ewma_arl(2.814, 0.1, 0.0) == pytest.approx(500, rel=0.01)


def test_critical_values():
    assert [round(N.grubbs_critical(n), 4) for n in (10, 25)] == [2.29, 2.8217]
    assert N.t_ppf(0.975, 14) == pytest.approx(2.14479, abs=1e-5)
    assert N.chi2_ppf(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert N.f_ppf(0.95, 2, 27) == pytest.approx(3.354, abs=1e-3)


@pytest.mark.parametrize("p", [0.001, 0.05, 0.5, 0.9, 0.999])
def test_quantiles_close(p):
    assert N.chi2_cdf(N.chi2_ppf(p, 7), 7) == pytest.approx(p)
    assert N.t_cdf(N.t_ppf(p, 5), 5) == pytest.approx(p)
    assert N.f_cdf(N.f_ppf(p, 3, 11), 3, 11) == pytest.approx(p)
    assert N.beta_cdf(N.beta_ppf(p, 2, 5), 2, 5) == pytest.approx(p)


@pytest.mark.parametrize(("n", "share"), [(20, 0.1), (300, 0.2)])
def test_binomial_quantile_by_adding_up(n, share):
    for p in (0.00135, 0.5, 0.99865):
        total, k = 0.0, -1
        while total < p:
            k += 1
            total += math.comb(n, k) * share**k * (1 - share) ** (n - k)
        assert N.binom_ppf(p, n, share) == k


def test_poisson_quantile_by_adding_up():
    for mean in (0.5, 9.5, 67.0):
        for p in (0.00135, 0.5, 0.99865):
            total, k = 0.0, -1
            while total < p:
                k += 1
                total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            assert N.poisson_ppf(p, mean) == k


def test_size_of_a_mean():
    for shift, arl in ((1.0, 2.0), (0.5, 5.0), (2.0, 1.05)):
        n = N.mean_size(shift, arl)
        length = lambda k, shift=shift: 1 / N.beyond(shift * k**0.5)
        assert length(n) <= arl * (1 + 1e-9) and (n == 1 or length(n - 1) > arl)
