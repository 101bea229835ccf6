import math
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lofted.functions import atmos, gauss, geo
from lofted.operators import ellipse, interp, ranges, sample, series
from lofted.plans import bank, replay, sim, synth, validate
from lofted.sources import store, text


def test_atmosphere_inverse_and_twin(spark):
    z = np.linspace(-4900, 85_900, 400)
    df = spark.createDataFrame([(float(x),) for x in z], "z double").select("z", atmos.pressure(F.col("z")).alias("p"), atmos.temperature(F.col("z")).alias("t")).withColumn("back", atmos.pressure_altitude(F.col("p")))
    rows = df.collect()
    t, p, _ = atmos.state_np(z)
    assert max(abs(r.back - r.z) for r in rows) < 1e-6
    assert np.allclose([r.p for r in rows], p, rtol=1e-12) and np.allclose([r.t for r in rows], t, rtol=1e-12)


def test_geodesy(spark):
    r = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(179.5), F.lit(0.0), F.lit(-179.5)).alias("d"), geo.wrap180(F.lit(190.0)).alias("w")).first()
    assert r.d == pytest.approx(math.radians(1) * geo.EARTH_RADIUS_M) and r.w == -170


def test_ellipse_recovers_a_known_cloud_across_the_antimeridian(spark):
    rng = np.random.default_rng(1)
    u, v, a = 8000 * rng.standard_normal(20_000), 2500 * rng.standard_normal(20_000), math.radians(35)
    east, north = u * math.sin(a) + v * math.cos(a), u * math.cos(a) - v * math.sin(a)
    lon = (179.99 + east / (geo.METRES_PER_DEGREE * math.cos(math.radians(20))) + 180) % 360 - 180
    pts = spark.createDataFrame([(1, float(20 + n / geo.METRES_PER_DEGREE), float(x)) for n, x in zip(north, lon)], "g int, lat double, lon double")
    e = ellipse.fit(pts, ["g"])
    r, k = e.first(), math.sqrt(-2 * math.log(0.05))
    assert r.semi_major_m == pytest.approx(8000 * k, rel=0.02) and r.semi_minor_m == pytest.approx(2500 * k, rel=0.02) and r.azimuth_deg == pytest.approx(35, abs=1)
    assert ellipse.containment(pts, e, ["g"]).first().contained == pytest.approx(0.95, abs=0.01)


def test_design_has_one_point_in_each_stratum(spark):
    rows = sample.unit_design(spark, 100, 3, 9).collect()
    for d in range(3):
        assert sorted(int(r.u * 100) for r in rows if r.dim == d) == list(range(100))


def test_burst_detection(spark):
    rng = np.random.default_rng(2)
    alt = np.concatenate([np.arange(0, 2000, 5.0), 2000 - 20 * np.arange(100.0)]) + 3 * rng.standard_normal(500)
    df = spark.createDataFrame([(1, float(i), float(a)) for i, a in enumerate(alt)], "f int, s double, alt double")
    r = series.detect_burst(df, ["f"], ["s"], "alt", "s").first()
    assert abs(r.peak_s - 400) <= 2 and 400 <= r.detected_s <= 412


def test_validation_suite(spark):
    checks = validate.judged(validate.flight_checks(spark, sim.Config(), 0.5, (0.5, 0.25))).collect()
    assert len(checks) == 8 and all(r.passed for r in checks)
    table = spark.createDataFrame([(0.0, 288.15, 101325.0, 1.225), (11_019.0, 216.65, 22632.0, 0.36391)], "altitude_m double, temperature_k double, pressure_pa double, density_kg_m3 double")
    assert all(r.passed for r in validate.judged(validate.atmosphere_checks(table)).collect())


def test_resumed_flights_land_where_they_would():
    config, settings = sim.Config(burst_diameter_m=3.0), sim.Settings(step_s=0.5)
    whole = sim.Lanes(config, settings, sim.nominal(config))
    whole.land()
    for stop in (300.0, 1500.0):
        first = sim.Lanes(config, settings, sim.nominal(config))
        first.advance_to(stop)
        rest = sim.Lanes(config, settings, sim.nominal(config), first.y, first.phase, first.diameter())
        rest.land()
        assert np.allclose(rest.y, whole.y, rtol=1e-9) and rest.t[0] + stop == pytest.approx(whole.t[0], rel=1e-9)


def test_lanes_do_not_depend_on_each_other():
    config, settings = sim.Config(burst_diameter_m=3.0), sim.Settings(step_s=0.5, wind=sim.Wind((0.0, 3000.0), (5.0, 15.0), (1.0, -2.0)))
    lift = np.array([0.7, 1.1, 1.6, -3.0])
    theta = {p: np.full(4, float(getattr(config, p, 1.0))) for p in sim.PARAMETERS} | {"free_lift_kg": lift}
    all_of = sim.Lanes(config, settings, theta)
    all_of.land()
    assert all_of.phase.tolist()[:3] == [sim.LANDED] * 3 and (all_of.held[:3] > 0).all() and all_of.phase[3] != sim.LANDED
    for k in range(3):
        one = sim.Lanes(config, settings, {p: v[k : k + 1] for p, v in theta.items()})
        one.land()
        assert np.allclose(one.y[:, 0], all_of.y[:, k], rtol=1e-12) and one.t[0] == all_of.t[k]
    unstable = sim.Lanes(config, sim.Settings(step_s=5.0), sim.nominal(config))
    unstable.land()
    assert unstable.failed.all()


def test_normal_functions(spark):
    from statistics import NormalDist

    unit, z = NormalDist(), np.linspace(-6, 6, 61)
    df = spark.createDataFrame([(float(x),) for x in z], "z double")
    rows = df.select("z", gauss.cdf(F.col("z")).alias("p"), gauss.upper_tail(F.col("z")).alias("q")).collect()
    assert all(r.p == pytest.approx(unit.cdf(r.z), rel=1e-9) and r.q == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-9) for r in rows)
    u = np.array([0.0, 1e-12, 0.01, 0.3, 0.5, 0.975, 1.0, 1.5])
    got = [r.z for r in spark.createDataFrame([(float(x),) for x in u], "u double").select(gauss.inverse_cdf(F.col("u")).alias("z")).collect()]
    want = [-8.0, *(unit.inv_cdf(float(x)) for x in u[1:6]), 8.0, None]
    assert got[-1] is None and got[:-1] == pytest.approx(want[:-1], rel=1e-9) and gauss.inverse_np(u)[:-1] == pytest.approx(want[:-1], rel=1e-9)


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k % 50 == 0 else int(rng.integers(0, 3)), k, int(rng.integers(0, 9))) for k in range(1500)]
    out = ranges.running(spark.createDataFrame(rows, "g int, k int, v int"), ["g"], ["k"], {"c": F.col("v")}, 16).collect()
    seen, total = {}, {}
    for g, _, v in rows:
        total[g] = total.get(g, 0) + v
    for r in sorted(out, key=lambda r: r.k):
        assert (r.c_before, r.c_total) == (seen.get(r.g, 0), total[r.g])
        seen[r.g] = seen.get(r.g, 0) + r.v
        assert r.c == seen[r.g]
    assert len(out) == 1500


def test_lookup_equals_interpolation(spark):
    rng = np.random.default_rng(4)
    nodes = {g: np.sort(rng.choice(5000, 300, replace=False)).astype(float) for g in (1, 2)} | {3: np.array([7.0])}
    values = {g: rng.standard_normal(len(x)) for g, x in nodes.items()}
    table = spark.createDataFrame([(g, float(a), float(b)) for g in nodes for a, b in zip(nodes[g], values[g])], "g int, x double, y double")
    at = [(int(rng.integers(1, 5)), float(rng.integers(-50, 5050))) for _ in range(600)] + [(1, None), (3, 7.0)]
    rows = interp.lookup(spark.createDataFrame(at, "g int, at double"), F.col("at"), table, "x", ["y"], ["g"]).collect()
    assert len(rows) == len(at)
    for r in rows:
        if r.at is None or r.g not in nodes:
            assert r.y is None
        else:
            assert r.y == pytest.approx(np.interp(r.at, nodes[r.g], values[r.g])) and r.extrapolated == (r.at < nodes[r.g][0] or r.at > nodes[r.g][-1])


def test_throttle_and_due_updates(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{g}", float(s), float(rng.integers(0, 2000)), bool(rng.random() < 0.05)) for g in range(3) for s in np.cumsum(rng.integers(1, 30, 200))]
    got = sorted(tuple(r) for r in replay.due_updates(spark.createDataFrame(rows, "flight string, s double, alt_m double, burst boolean"), ["flight"], 50.0, 500.0).collect())
    want, ends = [], {f: max(r[1] for r in rows if r[0] == f) for f in ("f0", "f1", "f2")}
    for f in ends:
        last = -math.inf
        for _, s, alt, burst in sorted(r for r in rows if r[0] == f):
            if alt > 550 and (s - last >= 50 or burst or s == ends[f]):
                want.append((f, s))
                last = s
    assert got == sorted(want)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.insert("run", spark.createDataFrame([(1, 7, "RUNNING"), (2, 7, "RUNNING")], "id long, mission_id long, status string"))
    s.insert("estimate", spark.createDataFrame([(1, "A", float("nan")), (2, "B", 2.0)], "run_id long, param_name string, median double"))
    assert s.find("estimate", median=None).first().run_id == 1
    with pytest.raises(store.StoreError):
        s.delete("mission", spark.createDataFrame([(7,)], "id long"))
    s.delete("run", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in s.read("run").collect()] == [2] and [r.run_id for r in s.read("estimate").collect()] == [2]
    s.finish_run(2, "OK", 5)
    assert s.find("run", status="OK").first().wall_clock_ms == 5 and s.read("mission").count() == 0


def test_filter_root_and_refutation():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4, 50))
    x[2] = 0
    cov = np.cov(x)
    assert np.allclose(bank.semidefinite_root(cov) @ bank.semidefinite_root(cov).T, cov)
    f = bank.Filter(sim.Config(), sim.Settings(step_s=5.0), 8, 1)
    with pytest.raises(sim.ConvergenceError):
        f.update(SimpleNamespace(s=500.0, lat=0.0, lon=0.0, alt_m=0.0, rate=0.0, span_s=1.0, by_pressure=False))
    with pytest.raises(ValueError):
        bank.check_prior(sim.Config(), 1)


def test_replay_narrows_and_repredicts(spark):
    config, settings = sim.Config(burst_diameter_m=3.0), sim.Settings(step_s=0.5)
    log = sim.synthetic_log(spark, config, settings, seed=5, every=60)
    out = replay.run(log, config, settings, filters=2, particles=40, every=4, gap_s=600.0, members=30)
    assert out["burst"].count() == 1
    ellipses = out["ellipses"].where("confidence = 0.95").orderBy("s").collect()
    end = sim.trajectory(config, settings, every=10_000).iloc[-1]
    actual = spark.createDataFrame([("", float(end.lat), float(end.lon))], "flight string, lat double, lon double")
    frozen = out["ellipses"].where("ordinal = 0").select("flight", "centre_lat", "centre_lon", "confidence")
    burst = out["burst"].select("flight", F.col("detected_s").alias("burst_s"))
    scored = replay.score(out["ellipses"].join(burst, "flight"), frozen, actual, ["flight"])
    assert len(ellipses) >= 4 and ellipses[-1].semi_major_m < ellipses[0].semi_major_m
    last = replay.moments(scored, ["flight"]).first()
    assert last.at_burst_m is not None and last.last_m < 5000


def test_evaluation_set(spark):
    seeds = spark.createDataFrame([("a", 3, datetime(2026, 9, 14, 4, 30)), ("b", 4, datetime(2026, 9, 14, 4, 30))], "name string, seed long, launch_epoch_utc timestamp")
    config, settings = sim.Config(burst_diameter_m=3.0), sim.Settings(step_s=0.5)
    truth = synth.truths(seeds, config, settings)
    log = synth.telemetry(truth, config, settings, interval_s=5.0)
    rows = log.groupBy("flight").agg(F.count("*").alias("n"), F.max("s").alias("end")).collect()
    ends = {r["name"]: r.landing_s for r in truth.collect()}
    assert {r.flight for r in rows} == {"a", "b"} and all(r.end == pytest.approx(ends[r.flight], rel=1e-9) for r in rows)


def test_telemetry_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\nTime,seq,latitude,lon,alt,pressure,extra\n2026-09-14T04:30:00Z,1,23,77,500,95000,x\n2026-09-14T04:30:03,2,23,77,,90000,x\n2026-09-14T04:30:01Z,2,23,77,1,1,x\n2026-09-14T04:30:02Z,3,23,77,nan,-,x\nbad,4,23,77\n2026-09-14T04:30:05Z,5,99,77,1,1\n")
    good, bad = text.read_telemetry(spark, str(tmp_path / "a.csv"))
    rows = {r.packet_id: r for r in good.collect()}
    assert set(rows) == {1, 2, 3} and rows[2].flags == 6 and rows[2].alt_m > 900 and rows[3].flags == 3 and rows[3].alt_m is None
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(5, "duplicate packet_id"), (7, "too few columns"), (8, "lat out of range")]
    (tmp_path / "c.csv").write_text("time,packet,lat,lon,alt,pressure\n2026-09-14T04:30:00Z,1,23,77,,300000\n2026-09-14T04:30:00Z,2,23,77,high,1\n")
    good, bad = text.read_telemetry(spark, str(tmp_path / "c.csv"))
    assert good.first().alt_m is None and sorted((r.line, r.reason) for r in bad.collect()) == [(2, "pressure_pa is outside the model"), (3, "alt_gps_m is no number")]
    (tmp_path / "d.csv").write_text("time,packet,lat,lon\nbad,1,23,77\n")
    with pytest.raises(text.DataFormatError):
        text.read_telemetry(spark, str(tmp_path / "d.csv"))
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(text.DataFormatError):
        text.read_telemetry(spark, str(tmp_path / "b.csv"))


def test_entry_without_text_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    monkeypatch.setattr(importlib.util, "find_spec", lambda *a: None)
    assert "ellipse" in e.queries() and not any(k.startswith("op") for k in e.queries())


def test_bank_skips_only_absent_channels(spark):
    config, settings = sim.Config(), sim.Settings(step_s=0.5)
    log = sim.synthetic_log(spark, config, settings, seed=5, every=120).where("s < 900").withColumn("alt_m", F.when(F.col("packet_id") % 4 != 2, F.col("alt_m")))
    n = log.count()
    out = bank.run(log, config, settings, filters=1, particles=8).select("update", "q50").collect()
    assert {r.update for r in out} == set(range(n)) and log.where("alt_m is null").count() > 0
    assert all(math.isfinite(r.q50) for r in out)


def test_bank_channels():
    import pandas as pd

    log = bank.rates(pd.DataFrame({"s": [0.0, 1.0, 2.0, 3.0, 4.0], "lat": 0.0, "lon": 0.0, "alt_m": [0.0, 6.0, np.nan, 18.0, 24.0], "by_pressure": [False] * 4 + [True]}))
    assert np.allclose(log.rate, [6, np.nan, 6, np.nan, 6], equal_nan=True) and np.allclose(log.span_s, [1, np.nan, 2, np.nan, 1], equal_nan=True)
    y = np.array([[0.0, 0.0, 12.0, 6.0], [0.0, 0.0, 12.0, 16.0]]).T
    rows = list(log.itertuples())
    got = bank.log_likelihood(y, rows[2], (0.0, 0.0, 0.0))
    assert np.isclose(got[0] - got[1], 0.5 * 100 / (4 + (10 * math.sqrt(2) / 2) ** 2))
    assert np.isclose(bank.log_likelihood(y, rows[3], (0.0, 0.0, 0.0))[0], -0.5 * 0.6**2 - math.log(10) - math.log(8))
    wide = math.hypot(2, 40 * math.sqrt(2))
    assert np.isclose(bank.log_likelihood(y, rows[4], (0.0, 0.0, 0.0))[0], -0.5 * 0.3**2 - math.log(40) - math.log(wide) - math.log(8))
