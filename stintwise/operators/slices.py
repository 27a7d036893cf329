"""Ordered work on groups too long for one task.

A race or a driver can hold any share of the rows, so nothing here sorts such a group as a
whole. Rows are cut into time slices; a slice is sorted on its own, and the little that
must cross a slice border (a row count, a last known sample) travels in a table with one
row per group and slice, whose size depends on the time span and not on the row count.
A slice that is itself crowded is found by counting and cut again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintwise.operators.lookup import join_pinned, pin_small, spread
from stintwise.settings import DEFAULTS, Settings

SLICE = "_slice"
FINER = 1000  # a crowded slice is cut into this many


def time_slice(t: str, width: int) -> Column:
    return F.floor(F.col(t) / F.lit(width)).cast("long")


def crowded_slices(df: DataFrame, keys: list[str], s: Settings = DEFAULTS) -> tuple[DataFrame, bool] | None:
    """Slices with more than `slice_rows` rows and their counts, or None. Counted by one
    aggregate over the key columns; at most one slice per `slice_rows` rows can be crowded."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_crowd"))
    table, pinned = pin_small(counts.filter(F.col("_crowd") > s.slice_rows), s)
    return None if pinned and table.isEmpty() else (table, pinned)


def number_within(
    df: DataFrame, keys: list[str], order: str, tie: str, out: str, s: Settings = DEFAULTS, width: int | None = None
) -> DataFrame:
    """row_number() of every row in its group, ordered by (order, tie); `tie` is unique.

    Rank inside the slice plus the number of rows in earlier slices. The rows shuffle once,
    by (keys, slice); the counts are combined before they shuffle. Rows of crowded slices
    are ranked by the same method on finer slices, in the end on blocks of `tie`, which
    cannot be crowded.
    """
    width = s.slice_us if width is None else width
    level = f"{SLICE}{len(keys)}"
    df = df.withColumn(level, time_slice(order, width))
    in_slice = Window.partitionBy(*keys, level).orderBy(order, tie)
    crowded = crowded_slices(df, [*keys, level], s)
    if crowded is None:
        ranked = spread(df, [*keys, level], df.count()).withColumn("_rank", F.row_number().over(in_slice))
    else:
        table, pinned = crowded[0].drop("_crowd"), crowded[1]
        calm = join_pinned(df, table, pinned, [*keys, level], "left_anti")
        busy = join_pinned(df, table, pinned, [*keys, level], "left_semi")
        finer = (tie, s.slice_rows) if width == 1 else (order, max(width // FINER, 1))
        ranked = spread(calm, [*keys, level], df.count()).withColumn("_rank", F.row_number().over(in_slice)).unionByName(
            number_within(busy, [*keys, level], finer[0], tie, "_rank", s, finer[1])
        )
    earlier = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*keys, level)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    # A left join, so that a reader without use for the number skips all of this.
    return (
        ranked.join(before, [*keys, level], "left")
        .withColumn(out, F.col("_rank") + F.col("_before"))
        .drop(*({"_rank", "_before", level} - {out}))
    )
