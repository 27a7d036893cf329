"""Work that is spread by the number of rows, and lap conditions that are worked out once."""

from catalog import all_queries, models
from stintwise.operators import lookup
from stintwise.operators import splits
from stintwise.plans import lap_record as R
from stintwise.schema import TEL_LAP
from stintwise.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def tables(spark):
    return R.SessionTables.of(D.laps(spark, SF), D.weather(spark, SF), D.telemetry(spark, SF), D.corners(spark, SF))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_samples(spark, monkeypatch):
    t = tables(spark)
    few = R.telemetry_features(t.telemetry, t.corners)
    monkeypatch.setattr(lookup, "ROWS_EACH", 500)
    many = R.telemetry_features(t.telemetry, t.corners)
    assert many.rdd.getNumPartitions() == -(-t.telemetry.count() // 500) > 4
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_tasks_grow_with_the_laps(spark, monkeypatch):
    few = sorted(map(str, R.lap_records(tables(spark)).collect()))
    monkeypatch.setattr(lookup, "ROWS_EACH", 50)
    many = R.lap_records(tables(spark))
    assert many.rdd.getNumPartitions() > 4
    assert sorted(map(str, many.collect())) == few


def test_laps_meet_the_weather_once(spark):
    """Two unions are one nearest join: its slices, and its rows with the samples."""
    assert plan(R.lap_conditions(tables(spark))).count("Union") == 2


def test_race_keys_are_not_read_from_unwritten_conditions(spark, monkeypatch):
    seen = []
    split = splits.split_chronological
    monkeypatch.setattr(models.splits, "split_chronological", lambda df, *a: seen.append(plan(df)) or split(df, *a))
    for name in ("a28_f7_standardisation", "m5_gram_sums"):
        all_queries()[name](spark, SF)
    assert len(seen) == 2 and not any("Window" in p or "Join" in p for p in seen)


def test_telemetry_that_no_lap_names_is_not_cleaned(spark, monkeypatch):
    t, cleaned = tables(spark), []
    clean = R.T.clean
    monkeypatch.setattr(R.T, "clean", lambda tel, *a: cleaned.append(tel) or clean(tel, *a))
    R.lap_records(t)
    laps = cleaned[0].select(*TEL_LAP).distinct()
    named = t.laps.select(*R.TEL_NAMES).distinct()
    assert 0 < laps.count() < t.telemetry.select(*TEL_LAP).distinct().count()
    assert laps.subtract(named).isEmpty() and named.intersect(t.telemetry.select(*TEL_LAP)).count() == laps.count()
