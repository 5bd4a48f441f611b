"""Designed experiments and the analytic gauge method on rows of known outcome."""

import itertools
from statistics import NormalDist

import numpy as np
import pytest

from steadyline.operators import attribute_gauge as A
from steadyline.operators import designs as D


def frame(spark, names, rows):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in rows], ", ".join(f"`{n}` double" for n in names))


def fraction_rows(repeats=1, sign=1):
    """2^(5-2) with d = ab and e = sign ac; y has effects 4 of a, -3 of b and 1.5 of bc."""
    out = []
    for a, b, c in itertools.product((-1, 1), repeat=3):
        for k in range(repeats):
            out.append((a, b, c, a * b, sign * a * c, 10 + 2 * a - 1.5 * b + 0.75 * b * c + (0.1 if k % 2 else -0.1) * (repeats > 1)))
    return out


NAMES = ["a", "b", "c", "d", "e", "y"]


@pytest.mark.parametrize("sign", [1, -1])
def test_relation_is_found(spark, sign):
    got = {r["word"]: (r["sign"], r["length"], r["resolution"]) for r in D.defining_relation(frame(spark, NAMES, fraction_rows(sign=sign)), "y", NAMES[:-1]).collect()}
    assert got == {"a:b:d": (1, 3, 3), "a:c:e": (sign, 3, 3), "b:c:d:e": (sign, 4, 3)}


def test_effects_and_aliases(spark):
    rows = D.fraction_effects(frame(spark, NAMES, fraction_rows(2, -1)), "y", NAMES[:-1]).collect()
    got = {r["term"]: r for r in rows}
    assert len(rows) == 7
    assert got["a"]["effect"] == pytest.approx(4) and got["b"]["effect"] == pytest.approx(-3) and got["b:c"]["effect"] == pytest.approx(1.5)
    assert got["a"]["aliases"] == "b:d -c:e" and got["b:c"]["aliases"] == "-d:e -a:b:e a:c:d"
    # Pure error: eight settings of two rows 0.2 apart, 0.02 a setting; an effect's variance is 4 / 16 of it.
    assert got["a"]["f"] == pytest.approx(16 / (0.02 / 4)) and got["a"]["p"] < 1e-9 and got["c"]["p"] == pytest.approx(1)


def test_effects_without_replicates_go_by_lenth(spark):
    rows = fraction_rows()
    rng = np.random.default_rng(1)
    rows = [(*r[:-1], r[-1] + e) for r, e in zip(rows, rng.normal(0, 0.05, 8), strict=True)]
    got = D.fraction_effects(frame(spark, NAMES, rows), "y", NAMES[:-1]).collect()
    size = np.abs([r["effect"] for r in got])
    first = 1.5 * np.median(size)
    assert all(r["f"] is None and r["p"] is None for r in got)
    assert got[0]["margin"] == pytest.approx(3.7639 * 1.5 * np.median(size[size < 2.5 * first]), rel=1e-3)  # t of 0.975 at 7 / 3 degrees of freedom


def test_full_factorial_and_refusals(spark):
    full = [(*x, sum(x)) for x in itertools.product((-1, 1), repeat=3)]
    names = ["a", "b", "c", "y"]
    assert D.defining_relation(frame(spark, names, full), "y", names[:-1]).count() == 0
    assert D.fraction_effects(frame(spark, names, full), "y", names[:-1]).count() == 7
    for rows in (full[:-1], [r for r in full if r[0] == 1], full[:3] + full[4:5], []):
        with pytest.raises(ValueError):
            D.fraction_effects(frame(spark, names, rows), "y", names[:-1])


def surface_rows():
    rng = np.random.default_rng(7)
    places = [*itertools.product((80.0, 85.0, 90.0), (170.0, 175.0, 180.0)), (85.0, 175.0), (85.0, 175.0)] * 2
    return [(x, z, 60 - 0.05 * (x - 86) ** 2 - 0.02 * (z - 174) ** 2 + 0.01 * (x - 86) * (z - 174) + e) for (x, z), e in zip(places, rng.normal(0, 0.3, len(places)), strict=True)]


def test_surface_equals_least_squares(spark):
    rows = surface_rows()
    df = frame(spark, ["x", "z", "y"], rows)
    x, z, y = np.array(rows).T
    u, v = x - 85, z - 175  # plain least squares about the middle, for its digits
    columns = [np.ones_like(u), u, v, u * u, v * v, u * v]
    rest = []
    for k in (1, 3, 5, 6):
        m = np.column_stack(columns[:k])
        rest.append(float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()))
    got = {r["source"]: r for r in D.surface_anova(df, "y", ["x", "z"]).collect()}
    for name, k, dof in (("linear", 0, 2), ("square", 1, 2), ("cross", 2, 1)):
        assert got[name]["ss"] == pytest.approx(rest[k] - rest[k + 1], rel=1e-6) and got[name]["df"] == dof
    pure = sum(((y[(x == a) & (z == b)] - y[(x == a) & (z == b)].mean()) ** 2).sum() for a, b in {(a, b) for a, b in zip(x, z, strict=True)})
    assert got["residual"]["ss"] == pytest.approx(rest[-1]) and got["pure_error"]["ss"] == pytest.approx(pure) and got["pure_error"]["df"] == len(rows) - 9
    assert got["lack_of_fit"]["df"] == 3 and got["lack_of_fit"]["ss"] == pytest.approx(rest[-1] - pure)
    b = np.linalg.lstsq(np.column_stack(columns), y, rcond=None)[0]
    own = {r["term"]: r for r in D.surface_terms(df, "y", ["x", "z"]).collect()}
    assert own["x^2"]["coefficient"] == pytest.approx(b[3]) and own["x:z"]["coefficient"] == pytest.approx(b[5])
    assert own["x"]["coefficient"] == pytest.approx(b[1] - 2 * b[3] * 85 - b[5] * 175)
    assert own["constant"]["coefficient"] == pytest.approx(b[0] - b[1] * 85 - b[2] * 175 + b[3] * 85**2 + b[4] * 175**2 + b[5] * 85 * 175, rel=1e-6)
    top = D.stationary_point(df, "y", ["x", "z"]).collect()
    bend = np.array([[b[3], b[5] / 2], [b[5] / 2, b[4]]])
    place = np.array([85, 175]) + np.linalg.solve(-2 * bend, b[1:3])
    assert [r["at"] for r in top] == pytest.approx(list(place)) and {r["nature"] for r in top} == {"maximum"}
    assert [r["curvature"] for r in top] == pytest.approx(sorted(np.linalg.eigvalsh(bend)))
    assert top[0]["response"] == pytest.approx(b[0] + b[1:3] @ (place - [85, 175]) / 2)


def test_surface_edges(spark):
    names = ["x", "z", "y"]
    one = [(x, x * x + e) for x, e in zip([-1, 0, 1, -1, 0, 1, 2], [0.1, -0.1, 0, 0, 0.1, -0.1, 0], strict=True)]
    assert {r["source"] for r in D.surface_anova(frame(spark, ["x", "y"], one), "y", ["x"]).collect()} == {"linear", "square", "residual", "lack_of_fit", "pure_error"}
    nulls = frame(spark, names, surface_rows()).union(spark.createDataFrame([(1.0, None, 3.0), (None, 2.0, 3.0)], "x double, z double, y double"))
    assert D.surface_anova(nulls, "y", ["x", "z"]).orderBy("source").collect() == D.surface_anova(frame(spark, names, surface_rows()), "y", ["x", "z"]).orderBy("source").collect()
    two_levels = [(a, b, a + b + k) for k, (a, b) in enumerate(itertools.product((-1, 1), repeat=2))] * 3
    for rows in ([], two_levels, surface_rows()[:5]):
        with pytest.raises(ValueError):
            D.surface_anova(frame(spark, names, rows), "y", ["x", "z"])


PART = [-0.05, -0.045, -0.04, -0.035, -0.03, -0.025, -0.02, -0.015, -0.01, -0.005]
COUNT = [0, 1, 3, 5, 8, 16, 18, 19, 20, 20]


def test_analytic_method(spark):
    turned = [("u", -x, a) for x, a in zip(PART, COUNT, strict=True)]
    rows = [("l", x, a) for x, a in zip(PART, COUNT, strict=True)]
    bad = [("few", x, a) for x, a in zip(PART[:5], COUNT[:5], strict=True)] + [("ends", x, a) for x, a in zip(PART, [1, *COUNT[1:]], strict=True)]
    bad += [("counts", x, 21 if a == 20 else a) for x, a in zip(PART, COUNT, strict=True)] + [("twice", x, a) for x, a in rows_of(rows)] + [("twice", PART[0], 0)]
    bad += [("between", x, a) for x, a in zip(PART, [0, 0, 0, 0, 4, 16, 20, 20, 20, 20], strict=True)] + [(None, None, None)]
    schema = "gauge string, reference double, accepts int"
    got = {r["gauge"]: r for r in A.analytic_method(spark.createDataFrame(rows + bad, schema), -0.02).collect()}
    assert {k: r["refused"] for k, r in got.items()} == {"l": None, "few": "too few parts", "ends": "ends", "counts": "counts", "twice": "repeated references", "between": "too few between the ends", None: "counts"}
    assert all(got[k]["t"] is None and got[k]["biased"] is None for k in got if k != "l")
    p = [0.025] + [(a + 0.5) / 20 if a < 10 else (a - 0.5) / 20 for a in COUNT[1:8]] + [0.975]
    z = [NormalDist().inv_cdf(v) for v in p]
    slope, middle = np.polyfit(z, PART[:9], 1)
    own = got["l"]
    spread = 2 * NormalDist().inv_cdf(0.995) * slope / 1.08 / 5.15
    assert (own["parts"], own["between_ends"]) == (10, 7)
    assert own["x50"] == pytest.approx(middle) and own["bias"] == pytest.approx(-0.02 - middle) and own["repeatability"] == pytest.approx(spread)
    assert own["t"] == pytest.approx(6.078 * abs(own["bias"]) / spread) and own["biased"] == (own["t"] > 2.093)
    upper = A.analytic_method(spark.createDataFrame(turned, schema), 0.02, "upper").first()
    assert upper["x50"] == pytest.approx(-middle) and upper["bias"] == pytest.approx(own["bias"]) and upper["refused"] is None
    assert A.analytic_method(spark.createDataFrame([], schema), 0.0).count() == 0


def rows_of(rows):
    return [r[1:] for r in rows]
