"""Effectiveness, health, scoring, episodes and matching on hand-computed rows."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millwright.operators import episodes as ep
from millwright.operators import health, matching, oee, scoring
from millwright.params import EpisodeParams, SensorParams
from millwright.plans.pipeline import run_anomaly_pipeline

T0 = dt.datetime(2024, 1, 1)


def production(table, *shifts):
    return table([dict(asset_id=a, line_id="L1", shift_date=d, shift=s, planned_time_min=p, run_time_min=r,
                       downtime_min=p - r, ideal_cycle_time_s=12, total_count=t, good_count=g)
                  for a, d, s, p, r, t, g in shifts], "production_log")


def test_oee_by_hand(table):
    log = production(table, ("P1", "2024-01-05", "A", 450, 400, 1800, 1780), ("P1", "2024-01-05", "B", 450, 410, 1900, 1850),
                     ("P2", "2024-01-05", "A", 0, 0, 0, 0), ("XX", "2024-01-05", "A", 10, 10, 1, 1))
    assets = table([dict(asset_id=a, asset_name=a, asset_type="PRESS") for a in ("P1", "P2")], "assets")
    got = {r.asset_id: r for r in oee.oee_daily(log, assets).collect()}
    assert set(got) == {"P1", "P2"}
    p1 = got["P1"]
    assert (p1.shifts, p1.scrap_count) == (2, 70)
    assert [round(x, 6) for x in (p1.availability, p1.performance, p1.quality, p1.oee)] == [0.9, 0.91358, 0.981081, 0.806667]
    assert (got["P2"].availability, got["P2"].performance, got["P2"].quality, got["P2"].oee) == (0, 0, 0, 0)
    one = oee.oee_for(log, "P1", dt.date(2024, 1, 5)).first()
    assert round(one.oee, 6) == 0.806667
    assert oee.oee_line_daily(log).count() == 1


def test_last_days_counts_from_the_data(table):
    log = production(table, *[("P1", f"2024-01-{d:02d}", "A", 10, 10, 1, 1) for d in range(1, 21)])
    kept = rows(oee.last_days(log, "shift_date", 7), "shift_date")
    assert kept[0] == (dt.date(2024, 1, 14),) and len(kept) == 7


def readings(table, spec):
    return table([dict(asset_id=a, ts=t, vibration_rms=v, temperature_c=50, pressure_bar=p, current_a=c)
                  for a, t, v, p, c in spec], "sensor_readings")


def test_latest_and_running(table):
    df = readings(table, [("A", T0 + dt.timedelta(minutes=5 * i), float(i), None, 10.0 if i % 4 else 1.0) for i in range(8)])
    newest = health.latest_per_key(df, "asset_id", "ts").first()
    assert newest.vibration_rms == 7.0 and newest.pressure_bar is None
    assert health.running_only(df, "asset_id", "current_a", 0.5).count() == 6


def test_asset_health_status(table):
    step = dt.timedelta(minutes=30)
    spec = []
    for i in range(9 * 48):
        t = T0 + i * step
        last = i >= 9 * 48 - 12
        spec.append(("HOT", t, 1.10 if last else 1.0, 5.0, 10.0))
        spec.append(("WARM", t, 1.05 if last else 1.0, 5.0, 10.0))
        spec.append(("COLD", t, 1.0, None, 10.0))
    assets = table([dict(asset_id=a, asset_name=a, line_id="L1") for a in ("HOT", "WARM", "COLD")], "assets")
    got = {r.asset_id: r for r in health.asset_health(readings(table, spec), assets).collect()}
    assert [got[a].health_status for a in ("HOT", "WARM", "COLD")] == ["ALERT", "WATCH", "OK"]
    assert got["HOT"].vib_6h_pct == pytest.approx(10) and got["COLD"].pres_6h_pct is None


def series(spark, n=700, assets=("A", "B"), seed=3):
    rng = random.Random(seed)
    data, hole = [], 0
    for a in assets:
        for i in range(n):
            hole += rng.random() < 0.1
            p = None if a == "B" else rng.gauss(0, 1)
            data.append((a, T0 + dt.timedelta(hours=i + hole), rng.gauss(0, 1), rng.gauss(0, 1), p, rng.gauss(0, 1), 1.0, 1.0))
    names = [f"s_{c}" for c in (*scoring.LEVELS, *scoring.NOISE)]
    return spark.createDataFrame(data, "asset_id STRING, hr TIMESTAMP_NTZ, " + ", ".join(f"{c} DOUBLE" for c in names))


def test_baseline_forms_agree(spark):
    df = series(spark)
    cols = ["asset_id", "hr", "n_base"] + [f"{p}_{c}" for c in scoring.LEVELS for p in ("m", "sd")]
    base = {(r.asset_id, r.hr): r for r in scoring.rolling_baseline(df, method="direct").select(*cols).collect()}
    for method, args in (("blocks", {}), ("chunked", {"block_rows": 200})):
        other = scoring.rolling_baseline(df, method=method, **args).select(*cols).collect()
        assert len(other) == len(base)
        for r in other:
            want = base[(r.asset_id, r.hr)]
            for c in cols[2:]:
                assert (r[c] is None) == (want[c] is None), (method, c)
                if r[c] is not None:
                    assert r[c] == pytest.approx(want[c], rel=1e-9, abs=1e-9), (method, c)


@pytest.mark.parametrize("bad", [1e9, float("nan"), float("inf"), None])
def test_baseline_forgets_bad_values(spark, bad):
    """A spike, NaN, infinity or gap counts in the frames that hold it and in no other."""
    from pyspark.sql import functions as F
    df = series(spark, 700, ("A", "B")).withColumn("__nr", F.row_number().over(scoring._by_asset()))
    for c in scoring.LEVELS:
        df = df.withColumn(f"s_{c}", F.when(F.col("__nr").isin(1, 50, 169, 170, 339), F.lit(bad).cast("double")).otherwise(F.col(f"s_{c}")))
    df = df.drop("__nr").cache()
    cols = ["n_base", *[f"{p}_{c}" for c in scoring.LEVELS for p in ("m", "sd")]]
    want = scoring.rolling_baseline(df, method="direct").orderBy("asset_id", "hr").select(*cols).collect()
    got = scoring.rolling_baseline(df).orderBy("asset_id", "hr").select(*cols).collect()
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for c in cols:
            assert (g[c] is None) == (w[c] is None), c
            assert g[c] is None or g[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9, nan_ok=True), c


def test_baseline_frame_by_row(spark):
    df = series(spark, 300, ("A",)).orderBy("hr")
    first = df.first().s_vib
    got = scoring.rolling_baseline(df).orderBy("hr").collect()
    assert got[23].n_base == 0 and got[23].m_vib is None
    assert got[24].n_base == 1 and got[24].m_vib == pytest.approx(first) and got[24].sd_vib is None
    assert got[299].n_base == 169


def flag_row(spark, z_vib, n_base):
    cols = {"asset_id": "A", "hr": T0, "vib": 1.0, "temp": 1.0, "pres": None, "curr": 1.0, "n_base": n_base,
            **{f"s_{c}": 1.0 for c in ("vib", "temp", "curr", "curr_noise")}, "s_pres": None, "s_pres_noise": None,
            "z_vib": z_vib, "z_temp": 0.0, "z_pres": None, "z_curr": 0.0}
    kinds = {"asset_id": "STRING", "hr": "TIMESTAMP_NTZ", "n_base": "BIGINT"}
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} {kinds.get(c, 'DOUBLE')}" for c in cols))


def test_flags_are_three_valued(spark):
    up = scoring.flags(flag_row(spark, 3.2, 72))
    r = up.first()
    assert (r.f_vib_up, r.f_pres_down, r.f_pres_noisy) == (True, None, False)
    assert ep.anomaly_hours(up).count() == 1
    assert ep.anomaly_hours(scoring.flags(flag_row(spark, 1.0, 72))).count() == 0
    cold = scoring.flags(flag_row(spark, 3.2, 71)).first()
    assert [cold[f] for f in scoring.FLAGS] == [False] * 6


def hours_frame(table, marks, vib=lambda h: 10.0):
    return table([dict(asset_id=a, hr=T0 + dt.timedelta(hours=h), vib_resid_pct=vib(h), temp_resid_c=1.0,
                       f_vib_up=True, f_temp_up=h >= 3, f_pres_down=None, f_curr_up=False, f_curr_noisy=False,
                       f_pres_noisy=False) for a, h in marks], "anomaly_hours")


def test_islands_and_episodes(table):
    raw = hours_frame(table, [("A", h) for h in (0, 1, 4, 8)]).drop("island", "start_hr", "age_h")
    got = ep.with_age(ep.islands(raw, "asset_id", "hr", 3))
    assert rows(got, "island", "age_h") == [(1, 0), (1, 1), (1, 4), (2, 0)]
    durations = [(r.island, r.duration_h) for r in ep.episodes(got).orderBy("island").collect()]
    assert durations == [(1, 5), (2, 1)]
    assets = table([dict(asset_id="A", asset_type="PRESS", line_id="L1")], "assets")
    hourly = table([dict(asset_id="A", hr=T0 + dt.timedelta(hours=9))], "sensor_hourly")
    found = ep.anomalies(got, hourly, assets).collect()
    assert [r.anomaly_id for r in found] == ["A-A-2024010100"]
    r = found[0]
    assert (r.is_active, r.sensors, r.severity, r.vib_shape, r.temp_lag_h) == (False, "vibration temperature", "MEDIUM", "STEP", 4)
    assert ep.anomalies(got, hourly, assets, live="last").first().is_active


def test_ramp_slope_and_edges(table):
    raw = hours_frame(table, [("A", h) for h in range(10)], vib=lambda h: 2.0 * h).drop("island", "start_hr", "age_h")
    got = ep.with_age(ep.islands(raw, "asset_id", "hr", 3))
    e = ep.edge_means(got).first()
    assert (e.vib_first, e.vib_last) == (2.0, 16.0)
    assets = table([dict(asset_id="A")], "assets")
    hourly = table([dict(asset_id="A", hr=T0 + dt.timedelta(hours=10))], "sensor_hourly")
    r = ep.anomalies(got, hourly, assets).first()
    assert (r.vib_slope_pct_h, r.vib_shape, r.is_active, r.severity) == (14 / 8, "RAMP", True, "HIGH")


def test_prefailure_is_a_forward_asof_join(table, spark):
    def orders(*items):
        return table([dict(wo_id=w, asset_id="A", wo_type=k, reported_at=f"2024-01-01 {t}", failure_mode_code="M",
                           technician_id="T1") for w, k, t in items], "work_orders")
    found = spark.createDataFrame([("E", "A", dt.datetime(2024, 1, 1, 4), dt.datetime(2024, 1, 1, 10), False)],
                                  "anomaly_id STRING, asset_id STRING, start_hr TIMESTAMP_NTZ, end_hr TIMESTAMP_NTZ, is_active BOOLEAN")
    c = "CORRECTIVE"
    got = matching.prefailure(found, orders(("W9", c, "09:00:00"), ("W2", c, "22:00:00"), ("W3", c, "22:30:00"),
                                            ("W4", "PREVENTIVE", "11:00:00"))).collect()
    assert [(r.wo_id, r.hours_start_to_failure) for r in got] == [("W2", 18)]
    assert matching.prefailure(found, orders(("W3", c, "22:30:00"))).count() == 0
    tie = matching.prefailure(found, orders(("W6", c, "12:00:00"), ("W5", c, "12:00:00"))).first()
    assert tie.wo_id == "W5"


def signature(spark, name, bits, slope, lag, id_col):
    cols = {id_col: name, **{b: int(b in bits) for b in ep.BITS}, "temp_lag_h": lag, "vib_slope_pct_h": slope}
    return spark.createDataFrame([tuple(cols.values())], f"{id_col} STRING, " + ", ".join(f"{b} INT" for b in ep.BITS)
                                 + ", temp_lag_h BIGINT, vib_slope_pct_h DOUBLE")


def score(spark, hist, live):
    sig = signature(spark, "L", *hist, "live_id")
    return matching.match_score(matching.similarity(sig, signature(spark, "L", *live, "anomaly_id"))).first()


def test_similarity(spark):
    vt = ("s_vib_up", "s_temp_up")
    r = score(spark, ((*vt, "s_curr_up"), 0.45, 10), (vt, 0.5, 12))
    assert [round(x, 4) for x in (r.channel_sim, r.slope_sim, r.lag_sim, r.score)] == [0.6667, 0.9, 0.8333, 0.77]
    assert r.is_match
    assert score(spark, (vt, 0.5, None), (vt, 0.5, None)).lag_sim == 1
    assert score(spark, (vt, 0.5, 1), (vt, 0.5, None)).lag_sim == 0
    assert score(spark, ((), None, None), ((), 9.0, None)).slope_sim == 1


@pytest.mark.parametrize("mode,slope,want", [("BEARING_WEAR", 0.5, (24, 46)), ("BEARING_WEAR", 0.04, (24, 24)),
                                             ("SEAL_LEAK", 0.5, (24, 24))])
def test_failure_window(spark, mode, slope, want):
    an = spark.createDataFrame([("E", "A", True, 12.0, slope, 24, "HIGH")], "anomaly_id STRING, asset_id STRING, is_active "
                               "BOOLEAN, vib_rise_pct DOUBLE, vib_slope_pct_h DOUBLE, duration_h BIGINT, severity STRING")
    m = spark.createDataFrame([("E", mode, 0.8, True, h) for h in (40, 48, 60)] + [("E", "OTHER", 0.99, True, 1),
                              ("E", mode, 0.1, False, 500)],
                              "anomaly_id STRING, failure_mode STRING, score DOUBLE, is_match BOOLEAN, hours_start_to_failure BIGINT")
    w = matching.failure_windows(an, matching.best_mode(m))
    r = w.first()
    assert (r.failure_mode, r.n_matches, r.eta_low_h, r.eta_high_h) == (mode, 3, *want)
    assert matching.active_anomalies(an, w).first().priority == "CRITICAL"


def test_pipeline_finds_the_live_repeat_of_a_failure(spark, table, tmp_path):
    """Two bearing-like ramps on one asset: the first ends in a breakdown, the second is still running."""
    rng = random.Random(5)
    spec, n = [], 24 * 40
    ramps = [(24 * 20, 24 * 20 + 40), (24 * 40 - 30, 24 * 40)]
    for h in range(n):
        rise = max([(h - a) * 0.6 for a, b in ramps if a <= h < b] or [0])
        for q in range(6):
            t = T0 + dt.timedelta(hours=h, minutes=10 * q)
            spec.append(("P1", t, 10 * (1 + rise / 100) + rng.gauss(0, 0.01), 5 + rng.gauss(0, 0.01), 20 + rng.gauss(0, 0.05)))
    assets = table([dict(asset_id="P1", asset_type="PRESS", line_id="L1")], "assets")
    broke = T0 + dt.timedelta(hours=24 * 20 + 42)
    orders = table([dict(wo_id="WO-1", asset_id="P1", wo_type="CORRECTIVE", failure_mode_code="BEARING_WEAR",
                         reported_at=broke, technician_id="T1")], "work_orders")
    t = run_anomaly_pipeline(readings(table, spec), assets, orders, str(tmp_path))
    live = t["anomalies"].filter("is_active").collect()
    assert len(live) == 1 and "vibration" in live[0].sensors and live[0].vib_shape == "RAMP"
    window = t["failure_windows"].first()
    assert (window.failure_mode, window.n_matches) == ("BEARING_WEAR", 1)
    assert 0 < window.eta_low_h <= window.eta_high_h
    traces = matching.aligned_traces(t["sensor_scores"], t["anomalies"], t["anomaly_matches"])
    spans = {r["live"]: (r["lo"], r["hi"]) for r in traces.groupBy("live").agg(
        F.min("hours_since_start").alias("lo"), F.max("hours_since_start").alias("hi")).collect()}
    assert spans[True][0] == -12 and spans[False][0] == -12 and 0 < spans[False][1] <= 48


def test_params_are_used(spark):
    scored = scoring.zscores(scoring.rolling_baseline(series(spark, 120, ("A",))), SensorParams(sd_floor={
        "vib": 1e9, "temp": 1, "pres": 1, "curr": 1}))
    assert abs(scored.orderBy(F.desc("hr")).first().z_vib) < 1e-6
    assert EpisodeParams().weights == (0.5, 0.3, 0.2)
