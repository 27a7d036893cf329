"""Stints: reconstruction, reference times, validity, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stintwise.functions import laps as L
from stintwise.operators.lookup import spread
from stintwise.schema import LAP, SESSION, STINT
from stintwise.settings import DEFAULTS, Settings

DRIVER = [*SESSION, "driver"]


def of_stint() -> WindowSpec:
    """All laps of a stint: a few dozen at most, as many as one set of tires can run."""
    return Window.partitionBy(*STINT)


def first_copies(laps: DataFrame, listed: list[str] | None = None, rows: int = 0) -> DataFrame:
    """Of a lap listed more than once the first copy, by its end, then its time, then all else, or
    all of the columns `listed`. Laps are dealt by stint, so what is grouped by stint afterwards
    does not move them again, and over more tasks if there are many `rows`. Laps without a stint
    belong to none and are left out."""
    copies = Window.partitionBy(*STINT, "lap_number").orderBy("lap_end_us", "lap_time_s", F.xxhash64(*(listed or laps.columns)))
    dealt = spread(laps.filter(F.col("stint").isNotNull()).repartition(*STINT), STINT, rows)
    return dealt.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").drop("_copy")


def stint_table(laps: DataFrame) -> DataFrame:
    """One row per stint: length, first and last lap, whether a later stint followed, whether
    it mixes compounds, whether any stint of the driver does. A lap listed twice is one lap."""
    return _table(first_copies(laps))


def _table(laps: DataFrame) -> DataFrame:
    """The stints of laps that are listed once. Compounds are compared by hash, as strings would
    force a sort."""
    code = F.when(F.col("compound").isNotNull(), F.xxhash64("compound"))
    stints = (
        laps.groupBy(*STINT)
        .agg(
            F.count("*").cast("int").alias("stint_laps"),
            F.min("lap_number").alias("first_lap"),
            F.max("lap_number").alias("last_lap"),
            F.coalesce(F.min(code) != F.max(code), F.lit(False)).alias("is_mixed"),
        )
    )
    drivers = stints.groupBy(*DRIVER).agg(
        F.max("stint").alias("_last_stint"), F.bool_or("is_mixed").alias("driver_has_mixed")
    )
    return (
        stints.join(drivers, DRIVER)
        .withColumn("is_complete", F.col("stint") < F.col("_last_stint"))
        .drop("_last_stint")
    )


def stint_lap_lists(laps: DataFrame) -> DataFrame:
    """Stints with their compound and their lap numbers as an ordered list."""
    return (
        first_copies(laps)
        .groupBy(*STINT)
        .agg(
            F.coalesce(F.min("compound"), F.lit("UNKNOWN")).alias("compound"),
            F.sort_array(F.collect_list("lap_number")).alias("lap_numbers"),
        )
    )


def mixed_stint_drivers(laps: DataFrame) -> DataFrame:
    """Drivers of a session that lose all their laps there, with the stints at fault."""
    return stint_table(laps).filter("is_mixed").select(*STINT, "stint_laps")


def duplicate_laps(laps: DataFrame) -> DataFrame:
    """Laps listed more than once, and how often."""
    return laps.groupBy(*LAP).agg(F.count("*").alias("n_copies")).filter("n_copies > 1")


def with_stints(laps: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Laps with their stint's attributes; drivers with a mixed-compound stint are left out,
    and of a lap listed twice the first copy counts. `listed`: the laps as they were before
    columns were joined to them, written, so that the stints are read without that join."""
    rows, listed = (0, laps) if listed is None else (listed.count(), listed)
    once = first_copies(laps, listed.columns, rows)
    stints = _table(first_copies(listed, rows=rows)).filter(~F.col("driver_has_mixed"))
    return once.join(stints.select(*STINT, "is_complete"), STINT).withColumns(
        {
            "stint_laps": F.count("*").over(of_stint()).cast("int"),
            "stint_compound": F.coalesce(F.min("compound").over(of_stint()), F.lit("UNKNOWN")),
        }
    )


def with_validity(laps: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds the stint's exact median reference time and the valid-lap flag."""
    reference = F.median(F.when(L.counts_for_reference(), F.col("lap_time_s"))).over(of_stint())
    return laps.withColumn("reference_s", reference).withColumn(
        "is_valid_lap", L.is_valid_lap(F.col("reference_s"), s)
    )


def with_targets(laps: DataFrame) -> DataFrame:
    """Adds baseline, delta, consistency, remaining life and the masked stint length."""
    valid = F.col("is_valid_lap")
    baseline = F.min_by(F.when(valid, F.col("lap_time_s")), F.when(valid, F.col("lap_number"))).over(of_stint())
    spread = F.stddev_samp(F.when(valid, F.col("lap_time_s"))).over(of_stint())
    return (
        laps.withColumn("baseline_s", baseline)
        .withColumn("driver_consistency_std_s", spread)
        .withColumn("lap_time_delta_s", F.col("lap_time_s") - F.col("baseline_s"))
        .withColumn(
            "remaining_tire_life_laps",
            F.when(F.col("is_complete"), F.col("stint_laps") - F.col("tyre_life")),
        )
        .withColumn("stint_length_laps", F.when(F.col("is_complete"), F.col("stint_laps")))
    )


def stint_laps(laps: DataFrame, s: Settings = DEFAULTS, listed: DataFrame | None = None) -> DataFrame:
    """Laps with stint attributes, validity and targets: one shuffle of the laps by stint, and one
    of `listed`."""
    return with_targets(with_validity(with_stints(laps, listed), s))
