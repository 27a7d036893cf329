"""The lap feature table: every input joined into one row per lap, all sessions in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.functions import laps as L
from stintwise.operators import corners as C
from stintwise.operators import telemetry as T
from stintwise.operators.asof import nearest_join
from stintwise.operators.lookup import join_pinned, pin_small, settle, spread
from stintwise.operators.splits import split_by_keys
from stintwise.operators.stints import stint_laps
from stintwise.schema import SESSION, TEL_LAP, to_schema
from stintwise.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class SessionTables:
    """Inputs of a build, keyed by session; `laps` names each lap's telemetry by
    (tel_driver, tel_lap) in the lap's own session, or in the one that tel_season, tel_round
    and tel_session name, and its corners by `circuit`. Telemetry without session columns
    is that of the only session in `laps`."""

    laps: DataFrame
    weather: DataFrame
    telemetry: DataFrame
    corners: DataFrame

    @classmethod
    def of(cls, *tables: DataFrame) -> SessionTables:
        """Tables as delivered: a NaN is a missing value, and becomes null once, here."""
        return cls(*[nan_to_null(t) for t in tables])


# What a lap calls the key of its telemetry, in the order of TEL_LAP.
TEL_NAMES = ["tel_season", "tel_round", "tel_session", "tel_driver", "tel_lap"]


def with_tel_session(laps: DataFrame) -> DataFrame:
    """Laps with the session of their telemetry: their own where they name none."""
    return laps.withColumns({n: F.col(c) for n, c in zip(TEL_NAMES, SESSION) if n not in laps.columns})


def samples_by_session(t: SessionTables) -> DataFrame:
    """Telemetry with its session. Without one it is clear only if there is one session."""
    missing = [c for c in SESSION if c not in t.telemetry.columns]
    if not missing:
        return t.telemetry
    keys = with_tel_session(t.laps).select(*TEL_NAMES[: len(SESSION)]).distinct().take(2)
    if len(keys) > 1:
        raise ValueError(f"telemetry of several sessions lacks {missing}")
    only = keys[0] if keys else [None] * len(SESSION)
    types = [t.laps.schema[c].dataType for c in SESSION]
    named = {c: F.lit(v).cast(kind) for c, v, kind in zip(SESSION, only, types) if c in missing}
    return t.telemetry.withColumns(named)


def of_sessions(t: SessionTables, sessions: DataFrame) -> SessionTables:
    """The tables cut to some sessions, and to the telemetry that their laps name."""
    laps = with_tel_session(split_by_keys(t.laps, sessions))
    telemetry = t.telemetry
    if set(SESSION) <= set(telemetry.columns):
        named = laps.select(*[F.col(n).alias(c) for n, c in zip(TEL_NAMES, SESSION)]).distinct()
        telemetry = telemetry.join(named, SESSION, "left_semi")
    return SessionTables(laps, split_by_keys(t.weather, sessions), telemetry, t.corners)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in floats}) if floats else df


def reference_laps(laps: DataFrame) -> DataFrame:
    """Fastest timed lap of each session that was not deleted; of equals the lowest
    (driver, lap)."""
    timed = laps.filter(~L.is_deleted() & F.col("lap_time_s").isNotNull())
    order = F.struct("lap_time_s", "driver", "lap_number")
    picked = F.struct("circuit", "driver", "lap_number", *TEL_NAMES, "lap_time_s")
    return with_tel_session(timed).groupBy(*SESSION).agg(F.min_by(picked, order).alias("p")).select(
        *SESSION,
        "p.circuit",
        F.col("p.driver").alias("ref_driver"),
        F.col("p.lap_number").alias("ref_lap"),
        *[f"p.{n}" for n in TEL_NAMES],
        F.col("p.lap_time_s").alias("ref_time_s"),
    )


def track_features(t: SessionTables, s: Settings = DEFAULTS) -> DataFrame:
    """Corner count, mean corner speed, speed class and DRS zones of each session, read from
    its reference lap. One row per session; only the reference laps' samples are cleaned."""
    ref, pinned = pin_small(reference_laps(t.laps), s)
    wanted = ref.select(*[F.col(n).alias(c) for n, c in zip(TEL_NAMES, TEL_LAP)]).distinct()
    samples = join_pinned(samples_by_session(t), wanted, pinned, TEL_LAP, "inner")
    pairs = T.with_pairs(T.clean(samples, s), s)
    per_lap = C.track_summary(pairs, t.corners, s).withColumnsRenamed(dict(zip(TEL_LAP, TEL_NAMES)))
    counts = t.corners.groupBy("circuit").agg(F.count("*").cast("int").alias("num_corners"))
    return (
        ref.join(per_lap, TEL_NAMES, "left")
        .join(counts, "circuit", "left")
        .withColumn("is_high_speed_circuit", L.is_fast_circuit(F.col("avg_corner_speed_kph"), s))
        .select(
            *SESSION, "num_corners", "avg_corner_speed_kph", "is_high_speed_circuit", "num_drs_zones"
        )
    )


def telemetry_features(tel: DataFrame, corners: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Driver and vehicle features of each telemetry lap; the samples shuffle once, over tasks
    whose number grows with theirs."""
    # Not by the session's name: where it is one constant, Spark drops it from the windows' keys and would deal again.
    by = [c for c in TEL_LAP if c in tel.columns and c != "session_name"]
    return C.motion_summary(T.with_pairs(T.clean(spread(tel, by, tel.count()), s), s), corners, s)


def with_weather(laps: DataFrame, weather: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    near = nearest_join(
        laps, weather, SESSION, "lap_end_us", "w_us", "w_seq", ["w_seq", "air_temp", "track_temp", "rainfall"], s
    )
    sampled = F.col("w_us").isNotNull()
    raining = F.when(sampled, F.coalesce("rainfall", F.lit(False)))
    return (
        near.withColumn("is_raining", raining)
        .withColumn("weather", L.weather_class(raining, sampled))
        .withColumnsRenamed({"air_temp": "air_temp_c", "track_temp": "track_temp_c"})
        .drop("rainfall")
    )


def with_laps_written(t: SessionTables) -> SessionTables:
    """The tables with their laps written once: reference laps, time slices and stints read them."""
    return replace(t, laps=settle(t.laps))


def lap_conditions(t: SessionTables, s: Settings = DEFAULTS) -> DataFrame:
    """Laps with targets, weather, strategy and track features: all the wear models but the
    forest need, without touching the telemetry of ordinary laps."""
    return _conditions(with_laps_written(t), s)


def _conditions(t: SessionTables, s: Settings) -> DataFrame:
    track, pinned = pin_small(track_features(t, s), s)
    laps = stint_laps(with_weather(t.laps, t.weather, s), s, t.laps)
    return (
        join_pinned(laps, track, pinned, SESSION, "left")
        .withColumn("is_pit_lap", L.is_pit_lap())
        .withColumn("is_safety_car_lap", L.is_under_caution())
        .withColumn("fuel_load_estimate_kg", L.fuel_load(s=s))
        .withColumnsRenamed(
            {
                "driver": "driver_code",
                "stint_compound": "tire_compound",
                "tyre_life": "tire_age_laps",
                "stint": "stint_number",
            }
        )
    )


def lap_records(t: SessionTables, s: Settings = DEFAULTS) -> DataFrame:
    """The full record. A lap without telemetry keeps its row with null features, and telemetry
    that no lap names is not cleaned. The features of few laps are broadcast."""
    t = with_laps_written(t)
    named = with_tel_session(t.laps).select(*[F.col(n).alias(c) for n, c in zip(TEL_NAMES, TEL_LAP)]).distinct()
    wanted, few = pin_small(named, s)
    samples = samples_by_session(t)
    if few:
        samples = join_pinned(samples, wanted, few, TEL_LAP, "left_semi")
    features = telemetry_features(samples, t.corners, s).withColumnsRenamed(dict(zip(TEL_LAP, TEL_NAMES)))
    laps = with_tel_session(_conditions(t, s))
    if few:
        return to_schema(join_pinned(laps, *pin_small(features, s), TEL_NAMES))
    return to_schema(laps.join(features, TEL_NAMES, "left"))
