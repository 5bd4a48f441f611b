import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyline.operators import charts, fits, gauges, measurements, monitors, order, pearson, rules, sequential, studies
from steadyline.streaming.monitor import completed


def frame(spark, values, series="a", **more):
    rows = [(series, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, pos long, value double")


def criteria_by_loop(v, center, lcl, ucl, sigma, r):
    """The criteria one point after the other."""
    found, run, prev, count, direction = set(), 0, 0, 1, 0
    z = (np.array(v) - center) / sigma
    for i, x in enumerate(v):
        if x > ucl or x < lcl:
            found.add((i, "beyond_limits"))
        s = np.sign(x - center)
        run = run + 1 if s and s == prev else int(bool(s))
        prev = s
        if run >= r.run_length:
            found.add((i, "run"))
        if i:
            step = np.sign(x - v[i - 1])
            count = count + 1 if step and step == direction else 2 if step else 1
            direction = step
            if count >= r.trend_length:
                found.add((i, "trend"))
        if i >= 24:
            inside = sum(abs(y - (lcl + ucl) / 2) <= (ucl - lcl) / 6 for y in v[i - 24 : i + 1])
            if inside < 11 or inside > 23:
                found.add((i, "middle_third"))
        for n, least, limit, name in ((3, 2, 2, "two_of_three_beyond_2s"), (5, 4, 1, "four_of_five_beyond_1s")):
            w = z[i - n + 1 : i + 1]
            if i >= n - 1 and (sum(w > limit) >= least or sum(w < -limit) >= least):
                found.add((i, name))
        if i >= 14 and all(abs(z[i - 14 : i + 1]) < 1):
            found.add((i, "fifteen_within_1s"))
    return found


@pytest.mark.parametrize("chunk", [17, 65_536])
def test_criteria_do_not_depend_on_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(measurements.chunked, "__defaults__", (chunk,))
    rng = np.random.default_rng(4)
    v = np.round(np.r_[rng.normal(10, 1, 150), rng.normal(10.8, 0.5, 100), np.linspace(8, 13, 12), np.full(30, 10.0)], 1)
    r = rules.RuleSet(True, 3, 4, True, True, True, True) if chunk > 17 else rules.RuleSet(True, 4, 4, False, True, True, True)
    points = frame(spark, v).select("series", "pos", F.col("value").alias("point"), F.lit(10.0).alias("center"), F.lit(7.0).alias("lcl"), F.lit(13.0).alias("ucl"), F.lit(1.0).alias("sigma"))
    got = {(x["pos"], x["rule"]) for x in rules.violations(points, r).collect()}
    want = criteria_by_loop(v.tolist(), 10.0, 7.0, 13.0, 1.0, r)
    assert got == {x for x in want if r.middle_third or x[1] != "middle_third"}


def test_monitor_step_agrees_with_the_loop():
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(10, 1, 300), 1).tolist()
    want = {x for x in criteria_by_loop(v, 10.0, 8.0, 12.0, 1.0, rules.RuleSet(True, 7, 7)) if x[1] in ("beyond_limits", "run", "trend")}
    assert {(i, rule) for i in range(len(v)) for rule in completed(v[max(0, i - 99) : i + 1], 10.0, 8.0, 12.0)} == want


def test_positions_across_buckets(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"), (F.col("id") * 7).alias("o"))
    got = measurements.with_position(rows, "s", "o", span=100).orderBy("s", "o").groupBy("s").agg(F.collect_list("pos").alias("p")).collect()
    assert all(sorted(r["p"]) == list(range(len(r["p"]))) for r in got)


def test_subgroup_keeps_only_the_largest_raw_size(spark):
    m = frame(spark, range(10)).withColumn("label", F.floor(F.col("pos") / 4)).withColumn("ok", F.col("pos") != 1)
    got = {r["label"]: (r["raw"], r["n"], r["whole"]) for r in measurements.subgroup_stats(m, F.col("label"), F.col("ok")).collect()}
    assert got == {"0": (4, 3, False), "1": (4, 4, True), "2": (2, 2, False)}


def test_moving_ranges_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(measurements.chunked, "__defaults__", (5,))
    v = np.random.default_rng(1).normal(size=23)
    got = [r["mr"] for r in charts.moving_ranges(frame(spark, v)).orderBy("pos").collect()]
    assert got[0] is None and np.allclose(got[1:], np.abs(np.diff(v)))


def test_cusum_restarts_after_a_signal(spark):
    v = [0.0] * 5 + [3.0] * 6
    rows = frame(spark, v).withColumns({"mu": F.lit(0.0), "sd": F.lit(1.0)})
    got = sequential.cusum(rows, "mu", "sd", k=0.5, h=4.0).orderBy("pos").collect()
    assert [r["signal"] for r in got] == [None] * 6 + ["shift_up", None, "shift_up", None, "shift_up"]
    assert got[7]["high"] == 2.5


@pytest.mark.parametrize("chart", ["cusum", "ewma"])
def test_charts_with_memory_after_a_join_that_becomes_a_broadcast(spark, chart):
    """Spark drops a repartition by the join's key, and a join that turns out small leaves a series in several tasks."""
    rows = frame(spark, [(7 * i) % 11 for i in range(800)]).repartition(8)
    flat = rows.withColumns({"mu": F.lit(5.0), "sd": F.lit(3.0)})
    want = sorted(map(tuple, getattr(sequential, chart)(flat.coalesce(1), "mu", "sd").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        facts = flat.groupBy("series").agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"))
        joined = getattr(sequential, chart)(rows.join(facts, "series"), "mu", "sd")
        assert "REPARTITION_BY_COL" in joined._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == want


def test_ar_fit_recovers(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for e in rng.normal(size=4000):
        x.append(0.6 * x[-1] + e)
    row = sequential.ar_fit(frame(spark, x), 1).first()
    assert row["phi"][0] == pytest.approx(0.6, abs=0.05) and row["sigma_e"] == pytest.approx(1, abs=0.05)


def test_weibull_fit_recovers(spark):
    x = np.random.default_rng(3).weibull(1.7, 4000) * 5
    row = fits.weibull_fit(frame(spark, x)).first()
    assert row["a"] == pytest.approx(1.7, rel=0.05) and row["b"] == pytest.approx(5, rel=0.05)


def test_ranking_prefers_the_right_family(spark):
    x = np.random.default_rng(3).lognormal(1, 0.6, 3000)
    first = fits.ranked(fits.closed_fits(frame(spark, x))).filter("rank = 1").first()
    assert first["family"] == "lognormal"


def test_fits_of_series_with_a_zero(spark):
    """Exponential and Rayleigh hold a 0; the lognormal and the gamma get their formulas' limits, as the SQL gives them."""
    got = {r.family: r for r in fits.ranked(fits.closed_fits(frame(spark, [0.0, 1.0, 2.0, 5.0]))).collect()}
    assert set(got) == {"normal", "lognormal", "gamma", "exponential", "rayleigh"}
    assert got["exponential"].a == 2.0 and got["exponential"].loglik == pytest.approx(-4 * (np.log(2) + 1))
    assert got["rayleigh"].a == pytest.approx(np.sqrt(30 / 8)) and got["rayleigh"].loglik == -np.inf
    assert got["lognormal"].a == -np.inf and np.isnan(got["lognormal"].b) and np.isnan(got["lognormal"].loglik)
    assert got["gamma"].loglik == np.inf and got["gamma"].rank == 1 and got["lognormal"].rank == 5


def test_fitted_chart_of_a_series_with_a_zero(spark):
    """A likelihood without a bound is no fit, and the exponential beats the normal."""
    rows = frame(spark, [0.0, *(-np.log(1 - (np.arange(1, 60) - 0.5) / 60)).tolist()])
    got = pearson.fitted_chart(rows).collect()
    assert {r.family for r in got} == {"exponential"} and all(0 < r.lcl < r.ucl < 10 for r in got)


def test_correlation_and_distance_of_a_series_with_a_zero(spark):
    rows = frame(spark, [0.0, 1.0, 2.0, 5.0, 9.0])
    f = fits.closed_fits(rows).filter("family in ('normal', 'lognormal', 'exponential')")
    corr = {r.family: r.corr_all for r in order.plot_correlation(rows, f).collect()}
    assert np.isnan(corr["lognormal"]) and corr["exponential"] > 0.9 and corr["normal"] > 0.9
    a2 = {r.family: r.a2 for r in order.anderson_darling(rows, f).collect()}
    assert a2["lognormal"] == pytest.approx(-5 - 5 * np.log(1e-12), rel=1e-6) and set(a2) == {"normal", "lognormal", "exponential"}


def test_box_cox_of_lognormal_is_near_zero(spark):
    x = np.random.default_rng(6).lognormal(1, 0.6, 3000)
    assert abs(fits.box_cox(frame(spark, x)).first()["lambda"]) < 0.08


def test_nested_components_of_a_balanced_layout(spark):
    rng = np.random.default_rng(8)
    rows, a = [], rng.normal(0, 3, 30)
    for i in range(30):
        for j, b in enumerate(rng.normal(0, 2, 10)):
            rows += [(i, i * 10 + j, float(a[i] + b + e)) for e in rng.normal(0, 1, 4)]
    got = {r["level"]: r["variance"] for r in studies.nested_anova(spark.createDataFrame(rows, "g int, h int, value double"), "g", "h").collect()}
    assert got["error"] == pytest.approx(1, rel=0.15) and got["h"] == pytest.approx(4, rel=0.25) and got["g"] == pytest.approx(9, rel=0.6)


def test_kappa_textbook(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    assert studies.cohen_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["kappa"] == pytest.approx(0.4)


def test_readings_are_judged_in_order(spark):
    rows = [("n", 1, "1.5", True, 10, 10), ("n", 2, "x", True, 11, 11), ("n", 3, "2", False, 12, 12), ("n", 4, "2", True, None, 13), ("n", 5, "2", True, 1000, 14), ("n", 6, "2", True, 10, 15), ("n", 7, "2", True, 16, 9000), ("n", 8, "2", True, 17, 17)]
    r = spark.createDataFrame(rows, "node string, serial long, value string, good boolean, s long, a long").select("node", "serial", "value", "good", F.timestamp_seconds("s").alias("source_time"), F.timestamp_seconds("a").alias("arrived_at"))
    got = [x["reason"] for x in monitors.guarded_readings(r).orderBy("serial").collect()]
    assert got == [None, "not_numeric", "bad_quality", "no_timestamp", "future", "old_or_repeated", "stale", None]


def test_lots_without_points(spark):
    lots = spark.createDataFrame([("a", 1, 0, 2), ("a", 2, 50, 60)], "series string, lot long, seq_from long, seq_to long")
    points = frame(spark, [1, 2, 9, 4]).select("series", "pos", (F.col("value") > 8).alias("alarm"))
    assert {(r["lot"], r["points"], r["state"]) for r in monitors.lot_evidence(lots, points).collect()} == {(1, 3, "blocked"), (2, 0, "no_points")}


def test_gauge_studies_that_are_refused(spark):
    rows = spark.range(60).selectExpr("id % 5 as part", "id % 2 as op", "cast(id % 7 as double) as value")
    assert gauges.gauge_verdict(rows, "part", "op").count() == 1
    for few in (rows.filter("part < 4"), rows.filter("op = 0"), rows.filter("part > 0 or op > 0"), rows.withColumn("value", rows.part.cast("double"))):
        with pytest.raises(ValueError):
            gauges.gauge_verdict(few, "part", "op")


def test_samples_that_do_not_fit(spark):
    rows = [("p", [3.0, 20.0], None), ("p", [3.0], "wrong_value_count"), ("p", [3.5, 20.0], "bad_count"), ("p", [30.0, 20.0], "bad_count"), ("u", [3.0, 2.5], None), ("np", [5.0], "bad_count"), ("c", [-1.0], "bad_count")]
    rows += [("xbar-s", [1.0, 2.0, 3.0, 4.0], None), ("xbar-s", [1.0, 2.0], "wrong_value_count"), ("imr", [float("nan")], "wrong_value_count"), ("imr", None, "wrong_value_count"), ("imr", [2.5], None)]
    df = spark.createDataFrame([(i, k, 4, v, w) for i, (k, v, w) in enumerate(rows)], "i int, kind string, n int, values array<double>, want string")
    got = df.withColumn("got", gauges.sample_check(F.col("kind"), F.col("n"), F.col("values"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    stats = {r["kind"]: (r["location"], r["variation"]) for r in gauges.sample_statistics(df.filter("want is null").withColumn("previous", F.lit(2.0))).collect()}
    assert stats["p"] == (0.15, None) and stats["imr"] == (2.5, 0.5) and stats["xbar-s"][0] == 2.5


def test_lots_and_restarts_by_counting(spark):
    points = spark.range(200_000).selectExpr("'s' as series", "id as pos", "id % 1000 = 7 as alarm", "0.0 as value")
    lots = spark.createDataFrame([("s", "a", 0, 6), ("s", "b", 7, 70_000), ("s", "c", 199_000, 300_000), ("s", "d", 400_000, 400_001)], "series string, lot string, seq_from long, seq_to long")
    got = {r["lot"]: (r["points"], r["alarms"], r["state"]) for r in monitors.lot_evidence(lots, points).collect()}
    assert got == {"a": (7, 0, "free"), "b": (69_994, 70, "blocked"), "c": (1000, 1, "blocked"), "d": (0, 0, "no_points")}
    starts = spark.createDataFrame([("s", 5, False), ("s", 100_000, True)], "series string, pos long, new_phase boolean")
    rows = measurements.with_segments(points.select("series", "pos", "value"), starts)
    assert {(r["segment"], r["phase"]): r["n"] for r in rows.groupBy("segment", "phase").agg(F.count("*").alias("n")).collect()} == {(0, 0): 5, (1, 0): 99_995, (2, 1): 100_000}


@pytest.mark.parametrize(("stage", "cls", "n", "p", "pk"), [("machine", "major", 45, 2.06, 1.72), ("machine", "major", 40, 2.13, 1.78), ("machine", "major", 35, 2.22, 1.86), ("machine", "major", 30, 2.35, 1.96), ("preliminary", "critical", 75, 2.18, 1.82), ("production", "critical", 125, 1.67, 1.67)])
def test_targets_of_small_studies(spark, stage, cls, n, p, pk):
    from steadyline.operators.analysis import with_targets

    got = with_targets(spark.createDataFrame([(stage, cls, n)], "stage string, class string, n long")).first()
    assert abs(got["p_target"] - p) < 0.006 and abs(got["pk_target"] - pk) < 0.006 and got["target_state"] == ("raised" if n < 125 and stage != "production" else "table")


def test_targets_that_there_are_not(spark):
    from steadyline.operators.analysis import with_targets

    rows = [("machine", "critical", 40), ("machine", "critical", 50), ("machine", "major", 1), ("other", "major", 60), (None, "major", 60), ("machine", None, 60), ("machine", "major", None)]
    studies = spark.createDataFrame(rows, "stage string, class string, n long")
    got = {(x["stage"], x["class"], x["n"]): (x["target_state"], x["pk_target"]) for x in with_targets(studies).collect()}
    assert got == {rows[0]: ("too_few", None), rows[1]: ("table", 2.0), rows[2]: ("too_few", None), rows[3]: ("unknown", None), rows[4]: ("unknown", None), rows[5]: ("unknown", None), rows[6]: ("unknown", None)}
    assert with_targets(studies.limit(0)).count() == 0
    more = with_targets(studies.filter("n = 50"), agreed={"machine": {"critical": (3.0, 2.5)}}).first()
    assert (more["p_target"], more["pk_target"]) == (3.0, 2.5)


@pytest.mark.parametrize("effect", [0.0, 3.0])
def test_gauge_components_by_hand(spark, effect):
    """Balanced cells, once without and once with an interaction, against sums of squares from plain loops."""
    import random

    rng = random.Random(4)
    rows = [(p, o, 5.0 * p + o + effect * ((p * o) % 3) + rng.gauss(0, 1)) for p in range(6) for o in range(3) for _ in range(2)]
    got = gauges.gauge_verdict(spark.createDataFrame(rows, "part int, op int, value double"), "part", "op").first()
    mean = lambda keep: (lambda v: sum(v) / len(v))([x[2] for x in rows if keep(x)])
    m, mp, mo = mean(lambda x: True), [mean(lambda x, p=p: x[0] == p) for p in range(6)], [mean(lambda x, o=o: x[1] == o) for o in range(3)]
    cell = {(p, o): mean(lambda x, p=p, o=o: x[:2] == (p, o)) for p in range(6) for o in range(3)}
    ss_i = 2 * sum((cell[p, o] - mp[p] - mo[o] + m) ** 2 for p, o in cell)
    ss_e = sum((x[2] - cell[x[:2]]) ** 2 for x in rows)
    ms_p, ms_o, ms_i, ms_e = 6 * sum((a - m) ** 2 for a in mp) / 5, 12 * sum((a - m) ** 2 for a in mo) / 2, ss_i / 10, ss_e / 18
    pooled = effect == 0.0
    ev2 = (ss_i + ss_e) / 28 if pooled else ms_e
    low = ev2 if pooled else ms_i
    grr2 = ev2 + max(0, (ms_o - low) / 12) + (0 if pooled else max(0, (ms_i - ms_e) / 2))
    assert got["pooled"] == pooled
    for name, want in {"ms_parts": ms_p, "ms_operators": ms_o, "ms_interaction": ms_i, "ms_error": ms_e, "ev": ev2**0.5, "grr": grr2**0.5, "pv": max(0, (ms_p - low) / 6) ** 0.5}.items():
        assert abs(got[name] - want) < 1e-9 * max(1, want), name
