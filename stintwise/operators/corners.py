"""One pass over a lap's samples: its motion figures and its speeds at and around corners.

Every corner contributes marks, stretches of distance whose speed is wanted. A sample goes
on under the marks its segment touches, and once under a mark for the lap itself. One
aggregate by (lap, corner, mark) and one by lap follow, both inside the lap partitioning
the cleaning already made, so the samples shuffle once for everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators import telemetry as tel
from stintwise.operators.lookup import join_pinned, pin_small
from stintwise.schema import lap_key
from stintwise.settings import DEFAULTS, Settings

LAP_MARK, ENTRY, APEX, EXIT, AT = "lap", "entry", "apex", "exit", "at"
WINDOWS = (ENTRY, APEX, EXIT)


def marks(corners: DataFrame, parts: tuple[str, ...], s: Settings = DEFAULTS) -> DataFrame:
    """Rows (circuit, bin, number, part, a, b): the distance range [a, b] each part asks for,
    once per distance bin it can touch."""
    offsets = {
        ENTRY: (-s.corner_entry_m, -s.corner_entry_m),
        APEX: (-s.corner_apex_m, s.corner_apex_m),
        EXIT: (s.corner_exit_m, s.corner_exit_m),
        AT: (0.0, 0.0),
    }
    d = F.col("distance")
    asked = [
        F.struct(F.lit(p).alias("part"), (d + offsets[p][0]).alias("a"), (d + offsets[p][1]).alias("b"))
        for p in parts
    ]
    first = F.floor((F.col("m.a") - s.corner_grid_m) / s.corner_bin_m)
    last = F.floor((F.col("m.b") + s.corner_grid_m) / s.corner_bin_m)
    return corners.select("circuit", "number", F.explode(F.array(*asked)).alias("m")).select(
        "circuit", "number", "m.*", first.alias("mark_bin"), F.explode(F.sequence(first, last)).alias("bin")
    )


def marked_points(
    pairs: DataFrame, corners: DataFrame, parts: tuple[str, ...], s: Settings = DEFAULTS
) -> DataFrame:
    """Samples under the marks they touch. Every sample appears once under the lap mark.

    Samples look marks up by (circuit, distance bin), so a sample meets the marks near it
    and not all of the circuit's; a pair that shares several bins meets in the first.
    Grid marks (entry, apex, exit) yield the 2 m grid points they need, `k`, with speed
    `v`; the full grid is never made. The mark at the corner yields one point on the raw
    samples.
    """
    step, width = s.corner_grid_m, s.corner_bin_m
    known, pinned = pin_small(corners, s)
    d0, d1 = F.col("distance"), F.col("to_distance")
    first = F.floor(d0 / width)
    covered = F.coalesce(F.sequence(first, F.floor(F.coalesce(d1, d0) / width)), F.array().cast("array<bigint>"))
    of_lap = F.lit(None).cast("bigint")  # matches no mark, so it stays as the lap's own row
    binned = tel.with_grid(pairs, step).select(
        "*", first.alias("first_bin"), F.explode(F.concat(F.array(of_lap), covered)).alias("bin")
    )
    met = join_pinned(binned, marks(known, parts, s), pinned, ["circuit", "bin"])
    rel_a = (F.col("a") - F.col("grid_start")) / F.lit(step)
    rel_b = (F.col("b") - F.col("grid_start")) / F.lit(step)
    apex = F.col("part") == APEX
    lo = F.greatest(F.when(apex, F.ceil(rel_a)).otherwise(F.floor(rel_a)), F.col("k_lo"))
    hi = F.least(F.when(apex, F.floor(rel_b)).otherwise(F.ceil(rel_b)), F.col("k_hi"))
    a = F.col("a")
    here = ((d0 <= a) & (a < d1)) | (d1.isNull() & (a == d0))  # the lap's end is its last sample
    on_grid = (F.col("k_lo") <= F.col("k_hi")) & (lo <= hi)
    touched = met.filter(
        F.col("bin").isNull()
        | (
            F.col("part").isNotNull()
            & (F.col("bin") == F.greatest("first_bin", "mark_bin"))
            & F.when(F.col("part") == AT, here).otherwise(on_grid)
        )
    )
    points = F.when(F.col("part").isin(*WINDOWS), F.sequence(lo, hi)).otherwise(F.array(F.lit(0).cast("long")))
    x = F.when(F.col("part") == AT, a).otherwise(F.col("grid_start") + F.col("k") * F.lit(step))
    v = tel.at_distance(x, F.col("speed"), F.col("to_speed"))
    return (
        touched.withColumn("k", F.explode(points))
        .withColumn("v", F.when(F.col("part").isNotNull(), v))
        .withColumns({"rel": rel_a, "part": F.coalesce("part", F.lit(LAP_MARK))})
    )


def speed_by_mark(points: DataFrame, *lap_aggregates: Column) -> DataFrame:
    """One row per lap, corner and mark with its `mark_speed`; the lap mark's row carries
    the lap aggregates.

    Entry and exit lie between two grid points; with either missing or unknown so are they.
    """
    below, above = F.floor("rel"), F.ceil("rel")
    grouped = points.groupBy(*lap_key(points), "number", "part").agg(
        F.min("v").alias("_low"),
        F.max(F.when(F.col("k") == below, F.col("v"))).alias("_v0"),
        F.max(F.when(F.col("k") == above, F.col("v"))).alias("_v1"),
        F.max(F.col("rel") - below).alias("_share"),
        *lap_aggregates,
    )
    share = F.col("_share")
    between = F.when(share == 0, F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    )
    speed = F.when(F.col("part").isin(APEX, AT), F.col("_low")).otherwise(between)
    return grouped.withColumn("mark_speed", speed).drop("_low", "_v0", "_v1", "_share")


def corner_windows(pairs: DataFrame, corners: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Entry, apex and exit speed of each corner of each lap."""
    by_mark = speed_by_mark(marked_points(pairs, corners, WINDOWS, s)).filter(F.col("part") != LAP_MARK)
    return by_mark.groupBy(*lap_key(by_mark), "number").agg(
        *[F.max(F.when(F.col("part") == p, F.col("mark_speed"))).alias(f"{p}_speed") for p in WINDOWS]
    )


def speed_at_corners(pairs: DataFrame, corners: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Speed at each corner mark inside the lap's distance range: (lap, number, speed)."""
    by_mark = speed_by_mark(marked_points(pairs, corners, (AT,), s))
    return by_mark.filter(F.col("part") == AT).select(*lap_key(by_mark), "number", F.col("mark_speed").alias("speed_at_corner"))


def lap_summary(
    pairs: DataFrame, corners: DataFrame, means: dict[str, str], lap_aggregates: list[Column], s: Settings = DEFAULTS
) -> DataFrame:
    """One row per lap: the lap aggregates, and for each (mark, name) of `means` the mean
    speed over the lap's corners."""
    by_mark = speed_by_mark(marked_points(pairs, corners, tuple(means), s), *lap_aggregates)
    of_lap = [c for c in by_mark.columns if c not in (*lap_key(by_mark), "number", "part", "mark_speed")]
    return by_mark.groupBy(*lap_key(by_mark)).agg(
        *[F.max(F.when(F.col("part") == LAP_MARK, F.col(c))).alias(c) for c in of_lap],
        *[F.avg(F.when(F.col("part") == p, F.col("mark_speed"))).alias(name) for p, name in means.items()],
    )


def motion_summary(pairs: DataFrame, corners: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Driver and vehicle features of each lap."""
    means = {ENTRY: "corner_entry_speed_kph", APEX: "apex_speed_kph", EXIT: "corner_exit_speed_kph"}
    return lap_summary(pairs, corners, means, tel.motion_aggregates(s), s)


def track_summary(pairs: DataFrame, corners: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Mean corner speed and DRS zones of each lap."""
    return lap_summary(pairs, corners, {AT: "avg_corner_speed_kph"}, [tel.drs_aggregate()], s)
