"""Table schemas and column roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION = ["season", "round_number", "session_name"]
LAP = [*SESSION, "driver", "lap_number"]
STINT = [*SESSION, "driver", "stint"]
TEL_LAP = [*SESSION, "driver", "lap_number"]

# Names and types of the published lap feature table.
LAP_FEATURES = T.StructType(
    [
        T.StructField("season", T.IntegerType()),
        T.StructField("round_number", T.IntegerType()),
        T.StructField("session_name", T.StringType()),
        T.StructField("driver_code", T.StringType()),
        T.StructField("lap_number", T.IntegerType()),
        T.StructField("tire_compound", T.StringType()),
        T.StructField("tire_age_laps", T.IntegerType()),
        T.StructField("stint_number", T.IntegerType()),
        T.StructField("stint_length_laps", T.IntegerType()),
        T.StructField("avg_braking_decel_ms2", T.DoubleType()),
        T.StructField("peak_braking_decel_ms2", T.DoubleType()),
        T.StructField("avg_throttle_pct", T.DoubleType()),
        T.StructField("max_acceleration_ms2", T.DoubleType()),
        T.StructField("driver_consistency_std_s", T.DoubleType()),
        T.StructField("avg_speed_kph", T.DoubleType()),
        T.StructField("max_speed_kph", T.DoubleType()),
        T.StructField("brake_energy_estimate_kj", T.DoubleType()),
        T.StructField("longitudinal_accel_ms2", T.DoubleType()),
        T.StructField("corner_entry_speed_kph", T.DoubleType()),
        T.StructField("apex_speed_kph", T.DoubleType()),
        T.StructField("corner_exit_speed_kph", T.DoubleType()),
        T.StructField("circuit", T.StringType()),
        T.StructField("num_corners", T.IntegerType()),
        T.StructField("avg_corner_speed_kph", T.DoubleType()),
        T.StructField("is_high_speed_circuit", T.BooleanType()),
        T.StructField("num_drs_zones", T.IntegerType()),
        T.StructField("air_temp_c", T.DoubleType()),
        T.StructField("track_temp_c", T.DoubleType()),
        T.StructField("weather", T.StringType()),
        T.StructField("is_raining", T.BooleanType()),
        T.StructField("is_pit_lap", T.BooleanType()),
        T.StructField("fuel_load_estimate_kg", T.DoubleType()),
        T.StructField("is_safety_car_lap", T.BooleanType()),
        T.StructField("is_valid_lap", T.BooleanType()),
        T.StructField("lap_time_s", T.DoubleType()),
        T.StructField("lap_time_delta_s", T.DoubleType()),
        T.StructField("remaining_tire_life_laps", T.IntegerType()),
    ]
)

# Identifiers, row filter and targets, never model inputs.
NON_FEATURES = (
    "season",
    "round_number",
    "session_name",
    "driver_code",
    "lap_number",
    "is_valid_lap",
    "lap_time_s",
    "lap_time_delta_s",
    "remaining_tire_life_laps",
)

# Known only once a stint is over, or shared by a whole stint: they name the stint
# rather than describe the lap, so a model must not see them.
HINDSIGHT = ("stint_length_laps", "driver_consistency_std_s")


def candidate_features() -> list[str]:
    """Every published column that is neither an identifier nor a target."""
    return [c for c in LAP_FEATURES.fieldNames() if c not in NON_FEATURES]


def safe_features() -> list[str]:
    """Candidate features without the hindsight columns."""
    return [c for c in candidate_features() if c not in HINDSIGHT]


def to_schema(df: DataFrame, schema: T.StructType = LAP_FEATURES) -> DataFrame:
    """Select and cast to a fixed schema; a column the input lacks becomes typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def lap_key(tel: DataFrame) -> list[str]:
    """Columns that name a lap in telemetry. Samples of a single session may come without
    the session's."""
    return [c for c in TEL_LAP if c in tel.columns or c not in SESSION]


def required_columns(df: DataFrame, columns) -> DataFrame:
    """(column_name, present, n_values): which of the required columns a table has, and in how many
    rows each holds a value. One aggregate; a column that is missing holds none."""
    names = list(dict.fromkeys(columns))
    count = [F.count(c) if c in df.columns else F.lit(0).cast("long") for c in names]
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), n.alias("n_values")) for c, n in zip(names, count)]
    return df.agg(F.array(*each).alias("found")).select(F.explode("found").alias("f")).select("f.*")


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
