"""Rows that a split, a build or a stream must not lose, and values that must not stop a plan."""

from pyspark.sql import functions as F

from stintwise.operators import linear, quality, splits
from stintwise.operators import telemetry as T
from stintwise.schema import LAP_FEATURES, SESSION
from stintwise.sources import dataset
from stintwise.streaming.sessions import stream_sessions

from frames import telemetry


def races(spark, keys):
    return spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "season int, round_number int, session_name string, n int")


def test_null_race_keys_are_on_one_side(spark):
    keys = [(2023, 1, "R"), (2023, None, "R"), (None, 2, "R"), (2024, 1, None), (2024, 1, "R"), (2024, 2, "R")]
    df = races(spark, keys)
    for share in (0.2, 0.5, 0.9):
        for train, test in (splits.split_chronological(df, share), splits.split_random(df, share, seed=3)):
            assert sorted(r["n"] for r in train.unionByName(test).collect()) == list(range(6))
            assert test.select(*SESSION).distinct().count() == splits.holdout_count(6, share)


def test_indicator_columns_have_no_size_limit(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "c string")
    small = quality.DEFAULTS.__class__(lookup_max_rows=1)
    out = quality.one_hot(df, df, "c", small)
    assert out.columns == ["c", "is_a", "is_b"] and out.agg(F.sum("is_a"), F.sum("is_b")).first() == (1.0, 1.0)


def test_no_drs_channel_gives_null_zones(spark):
    pairs = T.with_pairs(T.clean(telemetry(spark, [100] * 8).drop("drs")))
    assert pairs.groupBy("driver", "lap_number").agg(T.drs_aggregate()).first().num_drs_zones is None


def test_a_compound_with_one_age_is_predicted(spark):
    coefs = spark.createDataFrame([("SOFT", 40, 5.0, 0.0, 20.0, 2.0, 1.0, 0.0, 0.0, 0.5)], "tire_compound string, n_rows long, age_mean double, age_scale double, f_mean double, f_scale double, intercept double, age_std double, age_std_x_f double, f_std double")
    df = spark.createDataFrame([("SOFT", 7, 24.0)], "tire_compound string, tire_age_laps int, track_temp_c double")
    assert linear.predict_single_feature(coefs, "track_temp_c", df).first()[linear.PREDICTED] == 2.0


def lap_rows(spark, season, n):
    empty = [f.name for f in LAP_FEATURES.fields if f.name not in (*SESSION, "lap_number")]
    rows = spark.createDataFrame([(season, 1, "R", i) for i in range(n)], "season int, round_number int, session_name string, lap_number int")
    return rows.select("*", *[F.lit(None).cast(LAP_FEATURES[c].dataType).alias(c) for c in empty])


def test_only_sessions_of_this_build_are_marked(spark, tmp_path):
    store, manifest = f"{tmp_path}/store", f"{tmp_path}/manifest"
    dataset.write_sessions(lap_rows(spark, 2023, 2), store)  # there from before
    pending = spark.createDataFrame([(2023, 1, "R"), (2024, 1, "R")], "season int, round_number int, session_name string")
    dataset.build_pending(pending, lambda _: lap_rows(spark, 2024, 3), store, manifest)
    assert [r["season"] for r in dataset.load_manifest(spark, manifest).collect()] == [2024]


def test_a_session_is_rebuilt_when_more_of_it_lands(spark, tmp_path):
    landing, store, manifest = (f"{tmp_path}/{x}" for x in ("landing", "store", "manifest"))
    for n in (2, 4):
        lap_rows(spark, 2024, n).filter(F.col("lap_number") >= n - 2).write.mode("append").parquet(landing)
        build = lambda keys: spark.read.parquet(landing).join(keys, SESSION, "left_semi")
        stream_sessions(spark, landing, LAP_FEATURES, build, store, manifest, f"{tmp_path}/checkpoint").awaitTermination()
        assert dataset.load_dataset(spark, store).count() == n
