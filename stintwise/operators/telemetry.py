"""Telemetry of a lap: cleaning, resampling, and the features read from it.

Every step works on the samples of one lap, so all windows share the lap as partition and
the samples shuffle once. A lap is bounded by its duration and the sampling rate. Forward
steps use time order; steps that look ahead use the reverse order with running frames,
because a frame open towards the end is quadratic in the lap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stintwise.functions.laps import kph_to_ms
from stintwise.schema import lap_key, require_columns
from stintwise.settings import DEFAULTS, Settings

# Channels every lap must carry, channels whose gaps are filled, and the DRS
# codes that mean the flap is open.
REQUIRED = ("time_s", "speed", "throttle", "brake", "n_gear", "distance")
FILLED = ("speed", "throttle", "brake", "n_gear", "rpm", "x", "y", "z")
DRS_OPEN = (10, 12, 14)

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def of_lap(tel: DataFrame) -> WindowSpec:
    return Window.partitionBy(*lap_key(tel))


def forward(tel: DataFrame) -> WindowSpec:
    return of_lap(tel).orderBy("time_s")


def backward(tel: DataFrame) -> WindowSpec:
    return of_lap(tel).orderBy(F.col("time_s").desc())


def dedupe_samples(tel: DataFrame) -> DataFrame:
    """First sample of every timestamp; `seq` orders samples that share one."""
    recorded = of_lap(tel).orderBy("time_s", "seq")
    return (
        tel.filter(F.col("driver").isNotNull() & F.col("lap_number").isNotNull())
        .withColumn("_last_time", F.lag("time_s").over(recorded))
        .filter(F.col("_last_time").isNull() | (F.col("_last_time") != F.col("time_s")))
        .drop("_last_time")
    )


def fill_gaps(tel: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Linear by position between known samples, at most `max_fill_samples` from a gap's
    left edge; the rest of a longer gap stays null. Adds the sample position `rn`."""
    channels = [c for c in FILLED if c in tel.columns]
    known = {c: F.when(F.col(c).isNotNull(), F.struct("rn", F.col(c).cast("double").alias("v"))) for c in channels}
    ahead, back = forward(tel), backward(tel)
    out = tel.withColumn("rn", F.row_number().over(ahead))
    out = out.withColumns({f"_p_{c}": F.last(known[c], True).over(ahead.rowsBetween(*UP_TO_HERE)) for c in channels})
    out = out.withColumns({f"_n_{c}": F.last(known[c], True).over(back.rowsBetween(*UP_TO_HERE)) for c in channels})
    return out.withColumns({c: _filled(c, s) for c in channels}).drop(
        *[f"_{side}_{c}" for side in "pn" for c in channels]
    )


def _filled(c: str, s: Settings) -> Column:
    before, after = F.col(f"_p_{c}"), F.col(f"_n_{c}")
    near = (F.col("rn") - before["rn"]) <= s.max_fill_samples
    share = (F.col("rn") - before["rn"]) / (after["rn"] - before["rn"])
    between = before["v"] + (after["v"] - before["v"]) * share
    return F.coalesce(F.col(c).cast("double"), F.when(near & after.isNotNull(), between))


def clip_speed(tel: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    v = F.col("speed")
    inside = F.greatest(F.least(v, F.lit(s.max_speed_kph)), F.lit(s.min_speed_kph))
    return tel.withColumn("speed", F.when(v.isNotNull(), inside))


def monotone_distance(tel: DataFrame) -> DataFrame:
    d = F.col("distance")
    return tel.withColumn("distance", F.when(d.isNotNull(), F.max(d).over(forward(tel).rowsBetween(*UP_TO_HERE))))


def clean(tel: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """De-duplicate, fill short gaps, clip speed, make distance non-decreasing."""
    require_columns(tel, (*lap_key(tel), "seq", *REQUIRED))
    return clip_speed(fill_gaps(monotone_distance(dedupe_samples(tel)), s), s)


def with_pairs(cleaned: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Each sample with its neighbours: `accel` from the previous one, `to_speed` and
    `to_distance` of the next one, and whether the DRS flap opens here."""
    back = backward(cleaned)
    # In reverse order the sample before in time comes after in the window.
    dt = F.col("time_s") - F.lead("time_s").over(back)
    dv = kph_to_ms(F.col("speed")) - kph_to_ms(F.lead("speed").over(back))
    extra = {
        "braking": F.coalesce(F.col("brake") > 0, F.lit(False)),
        "accel": F.when(dt > s.min_dt_s, dv / dt),
        "to_speed": F.lag("speed").over(back),
        "to_distance": F.lag("distance").over(back),
    }
    if "drs" in cleaned.columns:
        is_open = F.coalesce(F.col("drs").isin(*DRS_OPEN), F.lit(False))
        extra["drs_opens"] = is_open & ~F.coalesce(F.lead(is_open).over(back), F.lit(False))
    else:
        extra["drs_opens"] = F.lit(None).cast("boolean")
    return cleaned.withColumns(extra)


def with_grid(pairs: DataFrame, step: float) -> DataFrame:
    """Grid cells a sample covers on the lap's even distance grid: indices `k_lo`..`k_hi`
    of the grid points in [distance, to_distance). The grid starts at the lap's smallest
    distance and excludes its largest."""
    start = F.min("distance").over(of_lap(pairs))
    out = pairs.withColumn("grid_start", start)
    lo = F.ceil((F.col("distance") - F.col("grid_start")) / F.lit(step))
    hi = F.ceil((F.col("to_distance") - F.col("grid_start")) / F.lit(step)) - 1
    return out.withColumn("k_lo", lo).withColumn("k_hi", hi)


def at_distance(x: Column, channel: Column, to_channel: Column) -> Column:
    """Linear value of a channel at distance x inside the sample's segment; on the sample
    itself its own value, so an unknown next sample does not erase it."""
    d0, d1 = F.col("distance"), F.col("to_distance")
    slope = (to_channel - channel) / (d1 - d0)
    return F.when(x == d0, channel).otherwise(channel + slope * (x - d0))


def resample(cleaned: DataFrame, step: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Channels on an even distance grid, one row per grid point. Each segment emits the
    grid points it contains, so there is no join of grid and samples."""
    step = s.resample_m if step is None else step
    channels = [c for c in FILLED if c in cleaned.columns]
    back = backward(cleaned)
    ahead = cleaned.withColumns(
        {f"_to_{c}": F.lag(c).over(back) for c in channels}
        | {"to_distance": F.lag("distance").over(back)}
    )
    cells = (
        with_grid(ahead, step)
        .filter(F.col("k_lo") <= F.col("k_hi"))
        .withColumn("k", F.explode(F.sequence("k_lo", "k_hi")))
        .withColumn("_x", F.col("grid_start") + F.col("k") * F.lit(step))
    )
    return cells.select(
        *lap_key(cleaned),
        "k",
        *[at_distance(F.col("_x"), F.col(c), F.col(f"_to_{c}")).alias(c) for c in channels],
        F.col("_x").alias("distance"),
    )


def motion_aggregates(s: Settings = DEFAULTS) -> list[Column]:
    """Speed, throttle, acceleration and braking figures of a lap."""
    decel = F.when(F.col("braking"), -F.col("accel"))
    v0, v1 = kph_to_ms(F.col("speed")), kph_to_ms(F.col("to_speed"))
    shed = F.when(F.col("braking") & (v1 < v0), 0.5 * F.lit(s.car_mass_kg) * (v0 * v0 - v1 * v1))
    energy = F.when(F.count("*") >= 2, F.coalesce(F.sum(shed), F.lit(0.0)) / 1000.0)
    return [
        F.avg(decel).alias("avg_braking_decel_ms2"),
        F.max(decel).alias("peak_braking_decel_ms2"),
        F.avg("throttle").alias("avg_throttle_pct"),
        F.max("accel").alias("max_acceleration_ms2"),
        F.avg("speed").alias("avg_speed_kph"),
        F.max("speed").alias("max_speed_kph"),
        energy.alias("brake_energy_estimate_kj"),
        F.avg(F.abs("accel")).alias("longitudinal_accel_ms2"),
    ]


def drs_aggregate() -> Column:
    """Number of unbroken runs of open DRS in a lap; null without a DRS channel."""
    return F.sum(F.col("drs_opens").cast("int")).cast("int").alias("num_drs_zones")
