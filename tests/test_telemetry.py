import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import TEL, telemetry
from stintwise.operators import corners as C
from stintwise.operators import telemetry as T


def series(df, c):
    return [r[0] for r in df.orderBy("time_s").select(c).collect()]


def test_duplicate_timestamp_keeps_the_first(spark):
    tel = telemetry(spark, [100, 150, 999, 200], time=[0, 1, 1, 2])
    assert series(T.dedupe_samples(tel), "speed") == [100.0, 150.0, 200.0]


def test_speed_is_clipped_and_distance_never_falls(spark):
    tel = telemetry(spark, [100, 999, -5, 120], distance=[0, 100, 80, 150])
    out = T.clean(tel)
    assert series(out, "speed") == [100.0, 380.0, 0.0, 120.0]
    assert series(out, "distance") == [0.0, 100.0, 100.0, 150.0]


def test_missing_channel_is_named(spark):
    with pytest.raises(ValueError, match="throttle"):
        T.clean(telemetry(spark, [1, 2]).drop("throttle"))


def test_gap_fill_equals_pandas(spark):
    rng = np.random.default_rng(3)
    for trial in range(4):
        speed = [None if rng.random() < 0.55 else float(rng.integers(50, 300)) for _ in range(60)]
        want = pd.Series([np.nan if v is None else v for v in speed]).interpolate(method="linear", limit=5, limit_area="inside")
        got = series(T.fill_gaps(telemetry(spark, speed)), "speed")
        assert [None if np.isnan(v) else round(v, 9) for v in want] == [None if v is None else round(v, 9) for v in got]


def test_resample_equals_interp(spark):
    rng = np.random.default_rng(5)
    d = np.cumsum(rng.integers(0, 40, 50)).astype(float)  # some samples share a distance
    v = rng.integers(50, 300, 50).astype(float)
    out = T.resample(T.clean(telemetry(spark, list(v), distance=list(d))), 5.0).orderBy("distance").collect()
    grid = np.arange(d.min(), d.max(), 5.0)
    assert [r.distance for r in out] == pytest.approx(list(grid))
    assert [r.speed for r in out] == pytest.approx(list(np.interp(grid, d, v)))


def test_motion_features(spark):
    speed = [100, 136, 172, 136, 100]
    brake = [0, 0, 0, 100, 100]
    pairs = T.with_pairs(T.clean(telemetry(spark, speed, brake=brake)))
    row = pairs.groupBy("driver", "lap_number").agg(*T.motion_aggregates()).first()
    assert row.avg_speed_kph == pytest.approx(np.mean(speed)) and row.max_speed_kph == 172.0
    assert row.max_acceleration_ms2 == pytest.approx(10.0) and row.longitudinal_accel_ms2 == pytest.approx(10.0)
    assert row.avg_braking_decel_ms2 == pytest.approx(10.0) and row.peak_braking_decel_ms2 == pytest.approx(10.0)
    # Energy looks at the earlier sample's brake: only the last drop counts.
    want = 0.5 * 860 * ((136 / 3.6) ** 2 - (100 / 3.6) ** 2) / 1000
    assert row.brake_energy_estimate_kj == pytest.approx(want)


def test_no_braking_gives_null_deceleration_and_no_energy(spark):
    pairs = T.with_pairs(T.clean(telemetry(spark, [100, 120, 140])))
    row = pairs.groupBy("driver", "lap_number").agg(*T.motion_aggregates()).first()
    assert row.avg_braking_decel_ms2 is None and row.peak_braking_decel_ms2 is None and row.brake_energy_estimate_kj == 0.0


def test_single_sample_lap(spark):
    pairs = T.with_pairs(T.clean(telemetry(spark, [100])))
    row = pairs.groupBy("driver", "lap_number").agg(*T.motion_aggregates()).first()
    assert row.brake_energy_estimate_kj is None and row.max_acceleration_ms2 is None and row.avg_speed_kph == 100.0


def test_drs_zones(spark):
    drs = [1, 12, 12, 8, 10, 14, 1, 1]
    pairs = T.with_pairs(T.clean(telemetry(spark, [100] * 8, drs=drs)))
    assert pairs.groupBy("driver", "lap_number").agg(T.drs_aggregate()).first().num_drs_zones == 2


def brute_corner(d, v, corner):
    grid = np.arange(d.min(), d.max(), 2.0)
    speed = np.interp(grid, d, v)

    def at(x):
        return None if x < grid.min() or x > grid.max() else float(np.interp(x, grid, speed))

    near = (grid >= corner - 15) & (grid <= corner + 15)
    return at(corner - 50), float(speed[near].min()) if near.any() else None, at(corner + 50)


def test_corner_windows_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    d = np.cumsum(rng.integers(0, 30, 80)).astype(float)
    v = rng.integers(50, 300, 80).astype(float)
    where = [10.0, float(d.max()) - 20.0, 301.0, 302.5, 333.25, 600.0, 5000.0]
    corners = spark.createDataFrame([("C0", i, x) for i, x in enumerate(where)], "circuit string, number int, distance double")
    pairs = T.with_pairs(T.clean(telemetry(spark, list(v), distance=list(d))))
    got = {r.number: (r.entry_speed, r.apex_speed, r.exit_speed) for r in C.corner_windows(pairs, corners).collect()}
    for i, x in enumerate(where):
        want = brute_corner(d, v, x)
        have = got.get(i, (None, None, None))
        for a, b in zip(have, want):
            assert (a is None and b is None) or a == pytest.approx(b), (x, have, want)
    at = {r.number: r.speed_at_corner for r in C.speed_at_corners(pairs, corners).collect()}
    for i, x in enumerate(where):
        inside = d.min() <= x <= d.max()
        assert (i in at) == inside
        if inside:
            assert at[i] == pytest.approx(float(np.interp(x, d, v)))
    row = C.motion_summary(pairs, corners).first()
    apex = [brute_corner(d, v, x)[1] for x in where]
    assert row.apex_speed_kph == pytest.approx(np.mean([a for a in apex if a is not None]))
    assert row.avg_speed_kph == pytest.approx(v.mean())


def test_lap_without_corners_keeps_its_motion(spark):
    corners = spark.createDataFrame([("elsewhere", 1, 100.0)], "circuit string, number int, distance double")
    row = C.motion_summary(T.with_pairs(T.clean(telemetry(spark, [100, 120]))), corners).first()
    assert row.avg_speed_kph == 110.0 and row.apex_speed_kph is None


def test_laps_do_not_leak_into_each_other(spark):
    one, two = telemetry(spark, [100, None, 200], driver="A"), telemetry(spark, [50, None], driver="B")
    out = {(r.driver, r.time_s): r.speed for r in T.clean(one.unionByName(two)).collect()}
    assert out[("A", 1.0)] == 150.0 and out[("B", 1.0)] is None


def test_samples_of_a_lap_shuffle_once(spark):
    corners = spark.createDataFrame([("C0", 1, 100.0)], "circuit string, number int, distance double")
    pairs = T.with_pairs(T.clean(telemetry(spark, [100, 120])))
    plan = C.motion_summary(pairs, corners)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(driver") == 1
