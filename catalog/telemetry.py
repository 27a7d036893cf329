"""Telemetry cleaning, resampling and lap features; corners and tracks; the full record."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, tables
from catalog.sql import SES, TEL, r
from stintwise.functions import laps as L
from stintwise.operators import corners as C
from stintwise.operators import telemetry as T
from stintwise.plans import lap_record as R
from stintwise.schema import LAP, LAP_FEATURES, SESSION, TEL_LAP, candidate_features
from stintwise.sources import driver_tables as D


# The key as the SQL selects it: in these tables a driver's telemetry belongs to one session.
NAMED = ["driver", "lap_number"]


def _pairs(spark, d):
    return T.with_pairs(T.clean(D.telemetry(spark, d)))


@query("w1_dedupe_samples", f"SELECT {TEL}, time_s, seq FROM deduped")
def w1(spark, d):
    return T.dedupe_samples(D.telemetry(spark, d)).select(*NAMED, "time_s", "seq")


@query("w2_gap_fill", f"SELECT {TEL}, time_s, rn, {r('speed')}, {r('throttle')}, {r('brake')}, {r('n_gear')} FROM filled")
def w2(spark, d):
    filled = T.fill_gaps(T.dedupe_samples(D.telemetry(spark, d)))
    filled = filled.withColumn("rn", F.col("rn").cast("long"))
    return rounded(filled.select(*NAMED, "time_s", "rn", "speed", "throttle", "brake", "n_gear"))


@query("w3_clip_speed", f"SELECT {TEL}, time_s, {r('speed')} FROM cleaned")
def w3(spark, d):
    return rounded(T.clean(D.telemetry(spark, d)).select(*NAMED, "time_s", "speed"))


@query("w4_monotone_distance", f"SELECT {TEL}, time_s, {r('distance')} FROM cleaned")
def w4(spark, d):
    return rounded(T.monotone_distance(T.dedupe_samples(D.telemetry(spark, d))).select(*NAMED, "time_s", "distance"))


@query("w5_acceleration", f"SELECT {TEL}, time_s, {r('accel')} FROM pairs")
def w5(spark, d):
    return rounded(_pairs(spark, d).select(*NAMED, "time_s", "accel"))


@query("w6_braking", f"SELECT {TEL}, count(*) FILTER (WHERE braking) AS n_braking, count(*) AS n_samples FROM pairs GROUP BY {TEL}")
def w6(spark, d):
    return _pairs(spark, d).groupBy(*TEL_LAP).agg(
        F.count_if("braking").alias("n_braking"), F.count("*").alias("n_samples")
    ).drop(*SESSION)


_SEG = """SELECT p.driver, p.lap_number, CASE WHEN x = distance THEN speed ELSE speed + (to_speed - speed) * (x - distance) / (to_distance - distance) END AS speed,
 CASE WHEN x = distance THEN throttle ELSE throttle + (to_throttle - throttle) * (x - distance) / (to_distance - distance) END AS throttle, x
FROM (SELECT *, d_min + k * 5.0e0 AS x FROM (SELECT *, lead(throttle) OVER (PARTITION BY driver, lap_number ORDER BY rn) AS to_throttle FROM pairs) q,
 generate_series(CAST(ceil((q.distance - q.d_min) / 5.0e0) AS BIGINT), CAST(ceil((q.to_distance - q.d_min) / 5.0e0) AS BIGINT) - 1) AS g(k)
 WHERE q.to_distance > q.distance) p"""


@query("w7_resample_by_distance", f"""
SELECT {TEL}, count(*) AS n_points, count(speed) AS n_known, {r('min(x)', 'first_m')}, {r('max(x)', 'last_m')}, {r('avg(speed)', 'avg_speed')},
 {r('min(speed)', 'min_speed')}, {r('max(speed)', 'max_speed')}, {r('avg(throttle)', 'avg_throttle')} FROM ({_SEG}) GROUP BY {TEL}""")
def w7(spark, d):
    grid = T.resample(T.clean(D.telemetry(spark, d)))
    return rounded(
        grid.groupBy(*TEL_LAP).agg(
            F.count("*").alias("n_points"), F.count("speed").alias("n_known"),
            F.min("distance").alias("first_m"), F.max("distance").alias("last_m"),
            F.avg("speed").alias("avg_speed"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"),
            F.avg("throttle").alias("avg_throttle"),
        ).drop(*SESSION)
    )


@query("w8_speed_at_corner", f"SELECT {TEL}, number, {r('speed_at_corner')} FROM at_corner")
def w8(spark, d):
    return rounded(C.speed_at_corners(_pairs(spark, d), D.corners(spark, d)).drop(*SESSION))


@query(
    "j6_corner_windows",
    f"SELECT {TEL}, number, {r('entry_speed')}, {r('apex_speed')}, {r('exit_speed')} FROM corner_windows "
    "WHERE entry_speed IS NOT NULL OR apex_speed IS NOT NULL OR exit_speed IS NOT NULL",
)
def j6(spark, d):
    windows = C.corner_windows(_pairs(spark, d), D.corners(spark, d))
    known = windows.filter(F.coalesce("entry_speed", "apex_speed", "exit_speed").isNotNull())
    return rounded(known.select(*NAMED, "number", "entry_speed", "apex_speed", "exit_speed"))


def _motion(name, columns):
    @query(name, f"SELECT {TEL}, {', '.join(r(c) for c in columns)} FROM motion")
    def run(spark, d):
        return rounded(_pairs(spark, d).groupBy(*TEL_LAP).agg(*T.motion_aggregates()).select(*NAMED, *columns))


_motion("a8_lap_speed_and_throttle", ["avg_speed_kph", "max_speed_kph", "avg_throttle_pct"])
_motion("a9_braking_deceleration", ["avg_braking_decel_ms2", "peak_braking_decel_ms2"])
_motion("a10_acceleration", ["max_acceleration_ms2", "longitudinal_accel_ms2"])
_motion("a11_brake_energy", ["brake_energy_estimate_kj"])


@query("a12_corner_summary", f"""
SELECT m.driver, m.lap_number, {r('corner_entry_speed_kph')}, {r('apex_speed_kph')}, {r('corner_exit_speed_kph')}
FROM motion m LEFT JOIN corner_means c ON m.driver = c.driver AND m.lap_number = c.lap_number""")
def a12(spark, d):
    out = C.motion_summary(_pairs(spark, d), D.corners(spark, d))
    return rounded(out.select(*NAMED, "corner_entry_speed_kph", "apex_speed_kph", "corner_exit_speed_kph"))


@query("a13_track_summary", f"SELECT {SES}, num_corners, {r('avg_corner_speed_kph')}, is_high_speed_circuit, num_drs_zones FROM track")
def a13(spark, d):
    return rounded(R.track_features(tables(spark, d)))


@query("a14_drs_zones", "SELECT tel_driver AS driver, tel_lap AS lap_number, num_drs_zones FROM tel_track")
def a14(spark, d):
    return _pairs(spark, d).groupBy(*TEL_LAP).agg(T.drs_aggregate()).drop(*SESSION)


@query("f4_fast_circuit", f"SELECT tel_driver AS driver, tel_lap AS lap_number, avg_corner_speed_kph >= 200.0e0 AS is_fast FROM tel_track")
def f4(spark, d):
    track = C.track_summary(_pairs(spark, d), D.corners(spark, d))
    return track.select(*NAMED, L.is_fast_circuit(F.col("avg_corner_speed_kph")).alias("is_fast"))


@query("f6_units", f"""
SELECT {TEL}, {r('max(speed / 3.6e0)', 'max_speed_ms')}, {r('max(0.5e0 * 860.0e0 * (speed / 3.6e0) * (speed / 3.6e0)) / 1000.0e0', 'peak_kinetic_kj')} FROM cleaned GROUP BY {TEL}""")
def f6(spark, d):
    v = L.kph_to_ms(F.col("speed"))
    return rounded(
        T.clean(D.telemetry(spark, d)).groupBy(*TEL_LAP).agg(
            F.max(v).alias("max_speed_ms"), F.max(L.kinetic_kj(v)).alias("peak_kinetic_kj")
        ).drop(*SESSION)
    )


@query("j3_io8_telemetry_lookup", f"""
SELECT l.season, l.round_number, l.session_name, l.driver, l.lap_number, {r('m.avg_speed_kph', 'avg_speed_kph')}, m.driver IS NOT NULL AS has_telemetry
FROM laps l LEFT JOIN motion m ON l.tel_driver = m.driver AND l.tel_lap = m.lap_number""")
def j3(spark, d):
    features = _pairs(spark, d).groupBy(*TEL_LAP).agg(*T.motion_aggregates()).select(
        *[F.col(c).alias(n) for c, n in zip(TEL_LAP, R.TEL_NAMES)], "avg_speed_kph", F.lit(True).alias("has_telemetry")
    )
    joined = D.laps(spark, d).join(features, R.TEL_NAMES, "left")
    return rounded(joined.select(*LAP, "avg_speed_kph", F.coalesce("has_telemetry", F.lit(False)).alias("has_telemetry")))


@query("j4_track_features_on_laps", f"""
SELECT {SES}, count(*) AS n_laps, {r('avg(avg_corner_speed_kph)', 'avg_corner_speed_kph')}, max(num_drs_zones) AS num_drs_zones FROM cond GROUP BY {SES}""")
def j4(spark, d):
    laps = R.lap_conditions(tables(spark, d))
    return rounded(
        laps.groupBy(*SESSION).agg(
            F.count("*").alias("n_laps"), F.avg("avg_corner_speed_kph").alias("avg_corner_speed_kph"),
            F.max("num_drs_zones").alias("num_drs_zones"),
        )
    )


_REC = ", ".join(
    r(f.name) if f.dataType.typeName() == "double" else f.name for f in LAP_FEATURES.fields
)


@query("d5_lap_record", f"SELECT {_REC} FROM rec")
def d5(spark, d):
    return rounded(R.lap_records(tables(spark, d)))


@query("io4_record_schema", f"SELECT {_REC} FROM (SELECT * FROM rec WHERE is_valid_lap)")
def io4(spark, d):
    from stintwise.operators.evaluate import valid_rows

    return rounded(valid_rows(R.lap_records(tables(spark, d))))


@query("p10_candidate_features", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n_known FROM rec" for c in candidate_features()))
def p10(spark, d):
    rec = R.lap_records(tables(spark, d)).select(*candidate_features())
    counts = rec.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_known")) for c in rec.columns]).alias("f"))
    return counts.select(F.explode("f").alias("f")).select("f.*")
