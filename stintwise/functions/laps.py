"""Lap rules and scalar lap features as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintwise.settings import DEFAULTS, Settings

CAUTION_CODES = "[4-7]"  # fixed values: safety car, red flag, virtual safety car and its end


def is_deleted(deleted="deleted") -> Column:
    return F.coalesce(F.col(deleted), F.lit(False))


def is_pit_lap(pit_in="pit_in_time", pit_out="pit_out_time") -> Column:
    return F.col(pit_in).isNotNull() | F.col(pit_out).isNotNull()


def is_under_caution(status="track_status") -> Column:
    return F.coalesce(F.col(status).rlike(CAUTION_CODES), F.lit(False))


def is_race_start(lap_number="lap_number") -> Column:
    return F.coalesce(F.col(lap_number) == 1, F.lit(False))


def is_outlier(reference: Column, s: Settings = DEFAULTS, lap_time="lap_time_s") -> Column:
    t = F.col(lap_time)
    return t.isNull() | (t > reference * F.lit(s.outlier_factor))


def is_valid_lap(reference: Column, s: Settings = DEFAULTS) -> Column:
    """None of the exclusion rules holds; without a reference time no lap is valid."""
    excluded = is_deleted() | is_pit_lap() | is_under_caution() | is_race_start() | is_outlier(reference, s)
    return F.coalesce(~excluded, F.lit(False))


def counts_for_reference() -> Column:
    """Laps whose time enters the stint's reference median."""
    return ~is_pit_lap() & ~is_under_caution()


def _burned_down(laps_done: Column, s: Settings) -> Column:
    left = F.lit(s.start_fuel_kg) - laps_done * F.lit(s.fuel_per_lap_kg)
    return F.when(laps_done.isNotNull(), F.greatest(left, F.lit(0.0)))


def fuel_load(lap_number="lap_number", s: Settings = DEFAULTS) -> Column:
    """Fuel at the start of a race lap: lap 1 carries the full load."""
    n = F.col(lap_number)
    return _burned_down(F.when(n.isNotNull(), F.greatest(n - 1, F.lit(0))), s)


def fuel_load_at_age(age: Column, s: Settings = DEFAULTS) -> Column:
    """Fuel when a swept tire age stands in for the laps driven; one lap off `fuel_load`."""
    return _burned_down(age, s)


def weather_class(raining: Column, sampled: Column) -> Column:
    return F.when(sampled, F.when(raining, "rain").otherwise("dry"))


def is_fast_circuit(speed: Column, s: Settings = DEFAULTS) -> Column:
    return speed >= F.lit(s.fast_circuit_kph)


def seconds(duration: Column) -> Column:
    """Seconds in a day-time interval, fraction kept."""
    day_part = F.extract(F.lit("DAY"), duration).cast("double") * 86400.0
    hour_part = F.extract(F.lit("HOUR"), duration).cast("double") * 3600.0
    minute_part = F.extract(F.lit("MINUTE"), duration).cast("double") * 60.0
    return day_part + hour_part + minute_part + F.extract(F.lit("SECOND"), duration).cast("double")


def kph_to_ms(speed: Column) -> Column:
    return speed / F.lit(3.6)


def session_key(season="season", round_number="round_number", session_name="session_name") -> Column:
    return F.format_string("%d_%02d_%s", F.col(season), F.col(round_number), F.col(session_name))


def kinetic_kj(speed_ms: Column, s: Settings = DEFAULTS) -> Column:
    """The car's kinetic energy in kJ."""
    return 0.5 * F.lit(s.car_mass_kg) * speed_ms * speed_ms / 1000.0


def holdout_size(n: Column, share: Column | float) -> Column:
    """Number of held-out races: rounded half to even, and both sides keep at least one."""
    part = share if isinstance(share, Column) else F.lit(share)
    return F.greatest(F.lit(1), F.least(F.bround(n * part).cast("int"), n.cast("int") - 1))


def age_bracket(age="tire_age_laps") -> Column:
    """Right-closed age brackets; ages outside (0, 100] have none."""
    # Upper edge and label of each bracket.
    brackets = [
        (5, "1-5"), (10, "6-10"), (15, "11-15"), (20, "16-20"), (25, "21-25"),
        (30, "26-30"), (35, "31-35"), (40, "36-40"), (100, "41+"),
    ]
    a = F.col(age)
    chain = F.when(a <= 0, None)
    for upper, label in brackets:
        chain = chain.when(a <= upper, label)
    return chain
