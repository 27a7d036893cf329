import pytest
from pyspark.sql import functions as F

from frames import lap, laps, telemetry
from stintwise.operators import quality as Q
from stintwise.operators import splits
from stintwise.plans import lap_record as R
from stintwise.plans import report as P
from stintwise.schema import LAP_FEATURES, SESSION, candidate_features, require_columns, required_columns, safe_features, to_schema
from stintwise.sources import dataset as DS
from stintwise.streaming.sessions import stream_sessions

KEYED = "season int, round_number int, session_name string, tire_compound string, lap int"


def races(spark, n=5, laps_each=3):
    rows = [(2023 + i // 3, i % 3 + 1, "R", ["SOFT", "HARD"][i % 2], k) for i in range(n) for k in range(laps_each)]
    return spark.createDataFrame(rows, KEYED)


def keys(df):
    return {tuple(r) for r in splits.race_keys(df).collect()}


def test_chronological_split_holds_out_the_latest(spark):
    df = races(spark)
    train, test = splits.split_chronological(df, 0.4)
    assert keys(train) == {(2023, 1, "R"), (2023, 2, "R"), (2023, 3, "R")} and keys(test) == {(2024, 1, "R"), (2024, 2, "R")}
    assert splits.split_summary(train, test).first().asDict() == {"train_races": 3, "test_races": 2, "train_laps": 9, "test_laps": 6}


@pytest.mark.parametrize("n,share,want", [(5, 0.5, 2), (7, 0.5, 4), (5, 0.01, 1), (5, 0.99, 4), (2, 0.5, 1), (3, 0.5, 2)])
def test_holdout_rounds_half_to_even_and_keeps_both_sides(n, share, want):
    assert splits.holdout_count(n, share) == want


def test_one_race_cannot_be_split(spark):
    with pytest.raises(ValueError):
        splits.split_chronological(races(spark, 1))
    with pytest.raises(ValueError):
        splits.split_random(races(spark, 1))


def test_random_split_is_disjoint_complete_and_reproducible(spark):
    df = races(spark, 9)
    (tr, te), (tr2, te2) = (splits.split_random(df, 0.3, seed=7) for _ in range(2))
    assert keys(te) == keys(te2) and not keys(tr) & keys(te) and keys(tr) | keys(te) == keys(df)
    assert len(keys(te)) == 3 and tr.count() + te.count() == df.count()
    assert any(keys(splits.split_random(df, 0.3, seed=s)[1]) != keys(te) for s in range(5))


def test_season_split_and_its_errors(spark):
    train, test = splits.split_by_season(races(spark), [2023], [2024])
    assert {k[0] for k in keys(train)} == {2023} and {k[0] for k in keys(test)} == {2024}
    with pytest.raises(ValueError, match="test"):
        splits.split_by_season(races(spark), [2023], [1999])


def test_missing_key_column_is_named(spark):
    with pytest.raises(ValueError, match="session_name"):
        splits.split_chronological(races(spark).drop("session_name"))


def test_uncovered_and_null_keys(spark):
    df = races(spark)
    soft, hard = df.filter("tire_compound = 'SOFT'"), df.filter("tire_compound = 'HARD'")
    assert [r[0] for r in splits.uncovered_compounds(soft, df).collect()] == ["HARD"]
    assert splits.uncovered_compounds(df, hard).isEmpty()
    with_null = df.unionByName(spark.createDataFrame([(None, 1, "R", "SOFT", 1)], KEYED))
    assert splits.split_by_keys(with_null, splits.race_keys(with_null)).count() == with_null.count()


def test_race_order(spark):
    got = {tuple(r)[:3]: r.race_rank for r in splits.chronological_rank(races(spark)).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(got)


def test_roles_and_schema(spark):
    assert len(LAP_FEATURES) == 37 and len(candidate_features()) == 28
    assert "stint_length_laps" in candidate_features() and "stint_length_laps" not in safe_features()
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1), ["b"])
    rows = spark.createDataFrame([(1, None), (2, 0.5)], "a long, b double")
    assert [tuple(r) for r in required_columns(rows, ["a", "b", "c", "a"]).collect()] == [("a", True, 2), ("b", True, 1), ("c", False, 0)]
    assert [r["n_values"] for r in required_columns(rows.limit(0), ["a", "c"]).collect()] == [0, 0]
    assert to_schema(spark.range(1)).schema == LAP_FEATURES


def record(spark, season, rnd, n=2, time=90.0):
    df = spark.range(n).select(
        F.lit(season).alias("season"), F.lit(rnd).alias("round_number"), F.lit("R").alias("session_name"),
        F.lit("AAA").alias("driver_code"), F.col("id").cast("int").alias("lap_number"), F.lit(time).alias("lap_time_s"),
    )
    return to_schema(df)


def test_store_round_trip_overwrites_only_its_session(spark, tmp_path):
    path = str(tmp_path / "laps")
    assert DS.load_dataset(spark, path).count() == 0
    DS.write_sessions(record(spark, 2023, 1).unionByName(record(spark, 2023, 2)), path)
    DS.write_sessions(record(spark, 2023, 2, n=5, time=91.0), path)
    back = DS.load_dataset(spark, path)
    assert back.schema == LAP_FEATURES
    assert {(r.round_number, r["count"]) for r in back.groupBy("round_number").count().collect()} == {(1, 2), (2, 5)}
    one = DS.load_session(spark, path, 2023, 2, "R")
    assert one.count() == 5 and {r.lap_time_s for r in one.collect()} == {91.0}


def test_manifest_is_idempotent_and_build_is_incremental(spark, tmp_path):
    data, manifest = str(tmp_path / "laps"), str(tmp_path / "manifest")
    sessions = record(spark, 2023, 1).unionByName(record(spark, 2023, 2)).unionByName(record(spark, 2023, 3)).select(*SESSION).distinct()
    built = []

    def build(pending):
        built.append(sorted(r.round_number for r in pending.collect()))
        rows = record(spark, 2023, 1).unionByName(record(spark, 2023, 2))  # round 3 yields nothing
        return rows.join(pending, SESSION, "left_semi")

    DS.build_pending(sessions.filter("round_number = 1"), build, data, manifest)
    DS.build_pending(sessions, build, data, manifest)
    DS.mark_built(sessions.filter("round_number = 1"), manifest)
    assert built == [[1], [2, 3]]
    assert sorted(r.round_number for r in DS.load_manifest(spark, manifest).collect()) == [1, 2]
    DS.build_pending(sessions, build, data, manifest, force=True)
    assert built[-1] == [1, 2, 3] and DS.load_dataset(spark, data).count() == 4


def test_stream_builds_what_landed(spark, tmp_path):
    landing, data, manifest = (str(tmp_path / n) for n in ("in", "laps", "manifest"))
    record(spark, 2023, 1).write.mode("append").parquet(landing)

    def run():
        query = stream_sessions(
            spark, landing, LAP_FEATURES, lambda k: DS._read_or_empty(spark, landing, LAP_FEATURES).join(k, SESSION, "left_semi"),
            data, manifest, str(tmp_path / "checkpoint"),
        )
        query.awaitTermination()

    run()
    record(spark, 2023, 2, n=3).write.mode("append").parquet(landing)
    run()
    run()
    assert DS.load_dataset(spark, data).count() == 5
    assert DS.load_manifest(spark, manifest).count() == 2


def build_inputs(spark):
    rows = [lap(1, 95.0), lap(2, 90.0), lap(3, 90.3), lap(4, 90.6, tel_lap=99), lap(5, 91.0, stint=2, tyre_life=1)]
    tel = None
    for n in (1, 2, 3, 5):
        one = telemetry(spark, [100 + 10 * i for i in range(12)], number=n, drs=[1, 12] * 6)
        tel = one if tel is None else tel.unionByName(one)
    weather = spark.createDataFrame(
        [(2023, 1, "R", 100_000_000, 1, 20.0, 30.0, False), (2023, 1, "R", 400_000_000, 2, 21.0, None, True)],
        "season int, round_number int, session_name string, w_us long, w_seq long, air_temp double, track_temp double, rainfall boolean",
    )
    corners = spark.createDataFrame([("C0", 1, 500.0), ("C0", 2, 9000.0)], "circuit string, number int, distance double")
    return R.SessionTables(laps(spark, rows), weather, tel, corners)


def test_lap_record_end_to_end(spark):
    out = {r.lap_number: r for r in R.lap_records(build_inputs(spark)).collect()}
    assert len(out) == 5 and set(out[1].asDict()) == set(LAP_FEATURES.fieldNames())
    assert out[2].lap_time_delta_s == pytest.approx(0.0) and out[4].lap_time_delta_s == pytest.approx(0.6)
    assert out[1].is_valid_lap is False and out[3].is_valid_lap is True
    assert out[4].avg_speed_kph is None and out[3].avg_speed_kph == pytest.approx(155.0)
    assert out[3].apex_speed_kph is not None and out[3].driver_consistency_std_s is not None
    assert out[2].stint_length_laps == 4 and out[5].stint_length_laps is None
    assert (out[1].weather, out[1].track_temp_c) == ("dry", 30.0) and (out[5].weather, out[5].track_temp_c) == ("rain", None)
    # The reference lap is lap 2: one of two corners lies on it.
    assert out[1].num_corners == 2 and out[1].avg_corner_speed_kph == pytest.approx(150.0) and out[1].is_high_speed_circuit is False
    assert out[1].num_drs_zones == 6


def test_defaults_fall_back_level_by_level(spark):
    df = spark.createDataFrame(
        [("A", "SOFT", 10.0, True), ("A", "SOFT", 20.0, False), ("A", "HARD", 40.0, True), ("B", "WET", 100.0, True), ("B", "WET", None, True)],
        "circuit string, tire_compound string, temp double, wet boolean",
    )
    table = P.default_table(df, ["temp"], ["wet"])
    ask = spark.createDataFrame([(1, "A", "SOFT"), (2, "A", "WET"), (3, "Z", "WET"), (4, "Z", "NEW")], "i int, circuit string, tire_compound string")
    got = {r.i: (r.temp, r.wet) for r in P.with_defaults(ask, table, ["temp", "wet"]).collect()}
    assert got == {1: (15.0, False), 2: (pytest.approx(70 / 3), True), 3: (100.0, True), 4: (42.5, True)}
    own = P.with_defaults(ask.withColumn("temp", F.when(F.col("i") == 1, 7.0)), table, ["temp"])
    assert {r.i: r.temp for r in own.collect()}[1] == 7.0
    known, rejected = P.split_known(ask, table)
    assert {r.i for r in known.collect()} == {1, 2} and {r.i for r in rejected.collect()} == {3, 4}


def test_cleanest_stints_use_the_whole_key(spark):
    rows = [(2023, r, "R", "AAA", 1, "SOFT", True, i) for r, n in ((1, 3), (2, 5)) for i in range(n)] + [(2023, 1, "R", "BBB", 1, "WET", True, i) for i in range(9)]
    df = spark.createDataFrame(rows, "season int, round_number int, session_name string, driver_code string, stint_number int, tire_compound string, is_valid_lap boolean, i int")
    top = Q.cleanest_stints(df, 1)
    assert top.first().n_valid == 5 and Q.laps_of_stints(df, top).count() == 5
