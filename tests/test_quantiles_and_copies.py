"""Joint quantiles, infinities, laps listed twice, pooled moments, and what a stopped build leaves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import all_queries
from stintwise.operators import linear as M
from stintwise.operators import quantiles as Q
from stintwise.operators import stints
from stintwise.sources import dataset
from stintwise.sources import driver_tables as D

SF = "/root/testdata/sf0.001"
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def jobs_of(spark, fn):
    spark.sparkContext.setJobGroup("counted", "")
    out = fn()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("others", "")
    return out, n


def test_two_columns_in_a_handful_of_jobs(spark):
    df = spark.range(50_000).select((F.sin("id") * 1e6).alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(None).cast("double").alias("c")).persist()
    df.count()
    got, jobs = jobs_of(spark, lambda: Q.quantiles(df, ["a", "b", "c"], PROBS))
    a = np.sin(np.arange(50_000)) * 1e6
    assert got["a"] == pytest.approx(list(np.quantile(a, PROBS)), rel=1e-12)
    assert got["b"] == list(np.quantile(np.arange(50_000) % 7, PROBS)) and got["c"] == [None] * 7
    assert jobs <= 12  # adaptive execution makes a job of every shuffle


def test_infinite_values_are_counted_apart(spark):
    x = np.concatenate([np.arange(20_000.0), [math.inf] * 3, [-math.inf]])
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x")).unionByName(spark.createDataFrame([(math.inf,)] * 3 + [(-math.inf,), (math.nan,), (None,)], "x double"))
    s = np.sort(x)
    got = Q.exact_quantiles(df, "x", [0.0, 0.5, 0.9, 1.0])
    assert got[0] == -math.inf and got[3] == math.inf
    for value, p in zip(got[1:3], (0.5, 0.9)):
        at = p * (len(s) - 1)
        assert value == pytest.approx(s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at)))
    only = spark.createDataFrame([(math.inf,)] * 2, "x double")
    assert Q.exact_quantiles(only, "x", [0.5]) == [math.inf]


def test_the_widest_range_ends(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1.7e308)).otherwise(F.lit(1.7e308) - F.col("id")).alias("x"))
    assert Q.exact_quantiles(df, "x", [0.0, 0.25, 1.0]) == [-1.7e308, -1.7e308, 1.7e308]


def test_lengths_are_equal_for_laps_listed_twice(spark):
    laps = D.laps(spark, SF)
    listed = laps.unionByName(laps.filter("lap_number % 2 = 0").withColumn("lap_end_us", F.col("lap_end_us") + 5))
    key = ["season", "round_number", "session_name", "driver", "stint"]
    table = {tuple(r[k] for k in key): r["stint_laps"] for r in stints.stint_table(listed).filter("not driver_has_mixed").collect()}
    rows = {tuple(r[k] for k in key): r["stint_laps"] for r in stints.with_stints(listed).select(*key, "stint_laps").distinct().collect()}
    lists = {tuple(r[k] for k in key): len(r["lap_numbers"]) for r in stints.stint_lap_lists(listed).collect()}
    assert table == rows and all(lists[k] == n for k, n in table.items())


def test_fits_read_each_lap_once(spark):
    rows = spark.range(300).select(F.element_at(F.array(F.lit("SOFT"), F.lit("HARD")), (F.col("id") % 2 + 1).cast("int")).alias(M.COMPOUND), (F.col("id") % 13).cast("double").alias(M.AGE), (F.sin("id") + F.col("id") % 13).alias("lap_time_delta_s"), F.lit(True).alias("is_valid_lap"))
    for degree in (1, 2):
        fit = M.polynomial_coefficients(rows, degree)
        assert "Expand" not in fit._jdf.queryExecution().executedPlan().toString()
        i = np.arange(300)
        for r in fit.collect():
            pick = i if r["is_pooled"] else i[i % 2 == (0 if r[M.COMPOUND] == "SOFT" else 1)]
            want = np.polyfit(pick % 13, np.sin(pick) + pick % 13, degree)[::-1]
            assert [r[f"b{k}"] for k in range(degree + 1)] == pytest.approx(list(want), abs=1e-9) and r["n_rows"] == len(pick)


def test_a_small_session_is_one_file(spark, tmp_path):
    records = all_queries()["d5_lap_record"](spark, SF)
    dataset.write_sessions(records, f"{tmp_path}/laps")
    sessions = records.select("season", "round_number", "session_name").distinct().count()
    assert len(list(tmp_path.glob("laps/*/*/*/*.parquet"))) == sessions


def test_a_build_stopped_before_its_mark_leaves_nothing(spark, tmp_path, monkeypatch):
    records = all_queries()["d5_lap_record"](spark, SF)
    keys = records.select("season", "round_number", "session_name").distinct()
    paths = f"{tmp_path}/laps", f"{tmp_path}/manifest"
    build = lambda wanted: records.join(wanted, ["season", "round_number", "session_name"], "left_semi")
    dataset.build_pending(keys.filter("season = 2023"), build, *paths)
    first = dataset.load_built(spark, *paths).count()
    with monkeypatch.context() as m:
        m.setattr(dataset, "mark_built", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            dataset.build_pending(keys, build, *paths)
    assert dataset.load_dataset(spark, paths[0]).count() > first
    assert dataset.load_built(spark, *paths).count() == first
    dataset.build_pending(keys, build, *paths)
    assert dataset.load_built(spark, *paths).count() == dataset.load_dataset(spark, paths[0]).count() == records.count()
