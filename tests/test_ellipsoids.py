"""Ellipsoid indices against a search over the sphere, and against one dimension."""

import numpy as np
import pytest

from steadyline.functions.numeric import NORMAL
from steadyline.operators import ellipsoids as L


@pytest.mark.parametrize("d", [2, 3, 5])
def test_least_on_sphere(d):
    rng = np.random.default_rng(d)
    for _ in range(20):
        a = rng.normal(size=(d, d))
        b, g = a @ a.T + 0.1 * np.eye(d), rng.normal(size=d) * rng.choice([0, 0.01, 1, 30])
        y = rng.normal(size=(200_000, d))
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        tried = np.einsum("ni,ij,nj->n", y, b, y) + 2 * y @ g
        found = L.least_on_sphere(b, g)
        assert found <= tried.min() + 1e-9 and found == pytest.approx(tried.min(), abs=0.15 * (1 + abs(found)) if d > 3 else 0.02 * (1 + abs(found)))


def test_least_along_the_smallest_axis():
    """The slope has no part along the smallest axis, and is too small to reach the sphere by itself."""
    assert L.least_on_sphere(np.diag([1.0, 4.0]), np.array([0.0, 1.0])) == pytest.approx(min(np.cos(t) ** 2 + 4 * np.sin(t) ** 2 + 2 * np.sin(t) for t in np.linspace(0, 7, 200_001)))
    assert L.least_on_sphere(np.diag([2.0, 2.0]), np.zeros(2)) == pytest.approx(2)


def test_tails_keep_their_digits():
    assert [L.two_sided(u, 1) for u in (0.5, 3.0, 6.0, 8.0)] == pytest.approx([0.5, 3, 6, 8]) and L.two_sided(60, 3) == L.FARTHEST
    assert L.two_sided(3.0, 2) == pytest.approx(-NORMAL.inv_cdf(np.exp(-4.5) / 2))


def test_performance(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 2)) @ np.array([[0.5, 0.2], [0.0, 0.4]])
    rows = [("in", *map(float, v)) for v in base + [0.3, 0]] + [("out", *map(float, v)) for v in base + [9, 0]] + [("few", 0.0, 1.0)] * 9 + [("line", float(i), 2.0 * i) for i in range(30)] + [("in", None, 1.0)]
    df = spark.createDataFrame(rows, "lot string, a double, b double")
    got = {r["lot"]: r for r in L.ellipsoid_performance(df, ["a", "b"], [-3, -2], [3, 2], "lot").collect()}
    assert set(got) == {"in", "out"} and got["in"]["n"] == 400 and got["in"]["centre_inside"] and not got["out"]["centre_inside"]
    turn = np.linspace(0, 2 * np.pi, 400_001)
    for lot, shift in (("in", [0.3, 0]), ("out", [9, 0])):
        x = base + shift
        border = np.stack([3 * np.cos(turn), 2 * np.sin(turn)], 1)
        inverse = np.linalg.inv(np.cov(x, rowvar=False))
        reach = lambda m: np.sqrt(np.einsum("ni,ij,nj->n", border - m, inverse, border - m).min())  # noqa: B023, E731
        assert (got[lot]["c_pmk"], got[lot]["c_pm"]) == (pytest.approx(reach(x.mean(axis=0)), rel=1e-6), pytest.approx(reach(np.zeros(2)), rel=1e-6))
    assert got["out"]["pmk"] < 0 < got["in"]["pmk"] < got["in"]["pm"]
    assert L.ellipsoid_performance(df.limit(0), ["a", "b"], [-3, -2], [3, 2], "lot").count() == 0
    assert L.ellipsoid_performance(df.filter("lot = 'in'"), ["a", "b"], [-3, -2], [3, 2]).first()["pmk"] == pytest.approx(got["in"]["pmk"])
    for limits in (([0, 0], [1, 0]), ([0], [1])):
        with pytest.raises(ValueError):
            L.ellipsoid_performance(df, ["a", "b"], *limits)
