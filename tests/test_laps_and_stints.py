import pytest
from pyspark.sql import functions as F

from frames import by, lap, laps
from stintwise.functions import laps as L
from stintwise.operators import stints


@pytest.mark.parametrize("status,expected", [("1", False), ("12", False), ("14", True), ("5", True), ("6", True), ("167", True), (None, False)])
def test_caution_codes(spark, status, expected):
    df = laps(spark, [lap(2, 90.0, track_status=status)])
    assert df.select(L.is_under_caution()).first()[0] is expected


def test_single_rules(spark):
    df = laps(
        spark,
        [lap(1, 90.0), lap(2, 90.0, deleted=True), lap(3, 90.0, deleted=None), lap(4, 90.0, pit_in_time=1), lap(5, 90.0, pit_out_time=1)],
    )
    flags = by(df.select("lap_number", L.is_deleted().alias("d"), L.is_pit_lap().alias("p"), L.is_race_start().alias("s")), "lap_number", "d", "p", "s")
    assert flags == {
        1: (False, False, True), 2: (True, False, False), 3: (False, False, False), 4: (False, True, False), 5: (False, True, False),
    }


def test_outlier_is_strict_and_null_time_is_one(spark):
    df = laps(spark, [lap(2, 115.0), lap(3, 115.0001), lap(4, None)])
    out = by(df.select("lap_number", L.is_outlier(F.lit(100.0)).alias("o")), "lap_number", "o")
    # 100 * 1.15 is a hair below 115 in binary, as it is in the formula's definition
    assert out == {2: 115.0 > 100.0 * 1.15, 3: True, 4: True}


def test_race_start_is_not_a_baseline(spark):
    df = laps(spark, [lap(1, 96.0), lap(2, 90.0), lap(3, 90.2), lap(4, 90.4), lap(20, 90.9, stint=2), lap(21, 91.0, stint=2)])
    out = by(stints.stint_laps(df), "lap_number", "is_valid_lap", "lap_time_delta_s")
    assert out[1][0] is False and out[1][1] == pytest.approx(6.0)
    assert out[2] == (True, pytest.approx(0.0)) and out[4] == (True, pytest.approx(0.4))
    assert out[20][0] is True


def test_median_ignores_caution_and_pit_laps(spark):
    rows = [lap(1, 120.0, track_status="4"), lap(2, 118.0, track_status="4"), lap(3, 119.0, track_status="14"),
            lap(4, 85.0), lap(5, 85.5), lap(6, 86.0)]
    out = stints.stint_laps(laps(spark, rows))
    assert {r.reference_s for r in out.collect()} == {85.5}
    assert {r.lap_number for r in out.filter("is_valid_lap").collect()} == {4, 5, 6}


def test_even_median_is_averaged_and_stint_without_times_is_invalid(spark):
    rows = [lap(2, 90.0), lap(3, 91.0), lap(8, None, stint=2), lap(9, 95.0, stint=2, pit_in_time=1)]
    out = by(stints.stint_laps(laps(spark, rows)), "lap_number", "reference_s", "is_valid_lap")
    assert out[2] == (90.5, True) and out[8] == (None, False) and out[9] == (None, False)


def test_completeness_length_and_remaining_life(spark):
    rows = [lap(i, 90.0, stint=1) for i in (2, 3, 4)] + [lap(i, 90.0, stint=2, tyre_life=i - 4) for i in (5, 6)]
    out = by(stints.stint_laps(laps(spark, rows)), "lap_number", "stint_length_laps", "remaining_tire_life_laps")
    assert out[3] == (3, 0) and out[4] == (3, -1)  # a used set can outlive its stint's length
    assert out[5] == (None, None)


def test_mixed_compounds_drop_the_driver_and_laps_without_stint_vanish(spark):
    rows = [lap(2, 90.0), lap(3, 90.0, compound="HARD"), lap(9, 90.0, stint=2),
            lap(2, 91.0, driver="BBB", compound=None), lap(3, 91.0, driver="BBB", compound=None), lap(4, 91.0, driver="BBB", stint=None)]
    df = laps(spark, rows)
    kept = stints.stint_laps(df).select("driver", "lap_number", "stint_compound").collect()
    assert sorted(tuple(r) for r in kept) == [("BBB", 2, "UNKNOWN"), ("BBB", 3, "UNKNOWN")]
    assert [(r.driver, r.stint) for r in stints.mixed_stint_drivers(df).collect()] == [("AAA", 1)]


def test_consistency_needs_two_laps(spark):
    rows = [lap(2, 90.0), lap(3, 92.0), lap(9, 90.0, stint=2)]
    out = by(stints.stint_laps(laps(spark, rows)), "lap_number", "driver_consistency_std_s")
    assert out[2] == pytest.approx(2**0.5) and out[9] is None


def test_fuel_never_negative_and_one_lap_apart(spark):
    df = laps(spark, [lap(1, 90.0), lap(2, 90.0), lap(80, 90.0), lap(3, 90.0, driver="X").copy() | {"lap_number": None, "tyre_life": None}])
    out = {r[0]: (r[1], r[2]) for r in df.select("lap_number", L.fuel_load(), L.fuel_load_at_age(F.col("tyre_life"))).collect()}
    assert out[1] == (100.0, pytest.approx(98.4)) and out[2] == (pytest.approx(98.4), pytest.approx(96.8))
    assert out[80] == (0.0, 0.0) and out[None] == (None, None)


def test_age_brackets_are_right_closed(spark):
    df = spark.createDataFrame([(a,) for a in (0, 1, 5, 6, 40, 41, 100, 101)], "tire_age_laps int")
    out = by(df.withColumn("b", L.age_bracket()), "tire_age_laps", "b")
    assert out == {0: None, 1: "1-5", 5: "1-5", 6: "6-10", 40: "36-40", 41: "41+", 100: "41+", 101: None}


def test_session_key_and_seconds(spark):
    df = spark.sql("SELECT 2024 AS season, 3 AS round_number, 'R' AS session_name, INTERVAL '1 02:03:04.5' DAY TO SECOND AS i")
    key, sec = df.select(L.session_key(), L.seconds(F.col("i"))).first()
    assert key == "2024_03_R" and sec == pytest.approx(93784.5)


def test_a_lap_listed_twice_counts_once(spark):
    rows = [lap(2, 90.0), lap(2, 95.0, lap_end_us=999_000_000), lap(3, 90.4), lap(9, 90.0, stint=2)]
    df = laps(spark, rows)
    out = by(stints.stint_laps(df), "lap_number", "lap_time_s", "stint_length_laps")
    assert out[2] == (90.0, 2) and len(out) == 3
    assert [(r.lap_number, r.n_copies) for r in stints.duplicate_laps(df).collect()] == [(2, 2)]
