"""The same driver and lap number in two sessions are two laps."""

import pytest
from pyspark.sql import functions as F

from stintwise.operators import telemetry as T
from stintwise.plans import lap_record as R

from frames import by, lap, laps, telemetry


def two_sessions(spark):
    rows = [lap(n, 90.0 + n, round_number=r, lap_end_us=n * 90_000_000) for r in (1, 2) for n in (1, 2, 3)]
    tel = None
    for r, speed in ((1, 100), (2, 200)):
        one = telemetry(spark, [speed] * 12, number=2).withColumns(
            {"season": F.lit(2023), "round_number": F.lit(r), "session_name": F.lit("R")}
        )
        tel = one if tel is None else tel.unionByName(one)
    weather = spark.createDataFrame(
        [], "season int, round_number int, session_name string, w_us long, w_seq long, air_temp double, track_temp double, rainfall boolean"
    )
    corners = spark.createDataFrame([("C0", 1, 500.0)], "circuit string, number int, distance double")
    return R.SessionTables(laps(spark, rows), weather, tel, corners)


def test_samples_of_two_sessions_do_not_merge(spark):
    kept = T.dedupe_samples(two_sessions(spark).telemetry)
    assert by(kept.groupBy("round_number").count(), "round_number", "count") == {1: 12, 2: 12}


def test_each_session_has_its_own_features(spark):
    out = R.lap_records(two_sessions(spark)).filter("lap_number = 2")
    assert by(out, "round_number", "avg_speed_kph") == {1: pytest.approx(100.0), 2: pytest.approx(200.0)}


def test_samples_without_a_session_need_a_single_one(spark):
    t = two_sessions(spark)
    loose = t.telemetry.filter("round_number = 2").drop("season", "round_number", "session_name")
    with pytest.raises(ValueError, match="several sessions"):
        R.lap_records(R.SessionTables(t.laps, t.weather, loose, t.corners))
