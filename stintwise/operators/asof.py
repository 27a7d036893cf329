"""Nearest-in-time join of rows with a sampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintwise.operators.lookup import join_pinned, spread
from stintwise.operators.slices import SLICE, crowded_slices, time_slice
from stintwise.settings import DEFAULTS, Settings


def nearest_join(
    rows: DataFrame,
    samples: DataFrame,
    keys: list[str],
    row_time: str,
    sample_time: str,
    sample_tie: str,
    values: list[str],
    s: Settings = DEFAULTS,
) -> DataFrame:
    """Each row with the sample of its group closest in time, before or after, without limit.

    Of two samples equally far the earlier wins, of two at one instant the lower tie value.
    Rows without time, and rows of a group without samples, get nulls. Adds `sample_time`
    and `values`.

    Each sample carries the one that follows it, so rows and samples meet per (group, time slice)
    in one sort. A slice that lacks a sample before or after a row takes it from the nearest
    earlier or later slice that has one; that table has one row per group and slice. Rows of a
    crowded slice are spread over several tasks, each with a copy of the slice's samples.
    """
    series = (
        samples.filter(F.col(sample_time).isNotNull())
        .groupBy(*keys, F.col(sample_time).alias("_t"))
        .agg(*[F.min_by(v, sample_tie).alias(v) for v in values])
        .withColumn(SLICE, time_slice("_t", s.slice_us))
    )
    placed = rows.withColumn(SLICE, time_slice(row_time, s.slice_us)).withColumn("_t", F.col(row_time))

    # Plain values instead of structs keep these aggregates in hash tables.
    ends = (
        series.unionByName(placed.select(*keys, SLICE), allowMissingColumns=True)
        .filter(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(
            F.min("_t").alias("_t_first"),
            F.max("_t").alias("_t_last"),
            *[F.min_by(v, "_t").alias(f"_first_{v}") for v in values],
            *[F.max_by(v, "_t").alias(f"_last_{v}") for v in values],
        )
    )
    slices = Window.partitionBy(*keys)
    earlier = slices.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = slices.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def end(side: str):
        t = F.col(f"_t_{side}")
        fields = [t.alias(sample_time), *[F.col(f"_{side}_{v}").alias(v) for v in values]]
        return F.when(t.isNotNull(), F.struct(*fields))

    carried = ends.select(
        *keys,
        SLICE,
        F.last(end("last"), True).over(earlier).alias("_carry_prev"),
        F.last(end("first"), True).over(later).alias("_carry_next"),
        end("first").alias("_first"),
    )

    fields = [F.col("_t").alias(sample_time), *[F.col(v) for v in values]]
    follows = F.lead(F.struct(*fields)).over(Window.partitionBy(*keys, SLICE).orderBy("_t"))
    placed = placed.withColumn("_row", F.lit(True))
    series = series.withColumn("_follows", follows).select(*keys, SLICE, "_t", F.struct(*fields, "_follows").alias("_sample"))
    place = [*keys, SLICE]
    crowded = crowded_slices(placed.filter(F.col(SLICE).isNotNull()), place, s)
    if crowded is not None:
        parts = crowded[0].select(*place, F.ceil(F.col("_crowd") / s.slice_rows).cast("int").alias("_parts"))
        n = F.coalesce("_parts", F.lit(1))
        mine = F.pmod(F.xxhash64(*rows.columns), n).cast("int")
        placed = join_pinned(placed, parts, crowded[1], place).withColumn("_part", mine).drop("_parts")
        series = join_pinned(series, parts, crowded[1], place).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), n - 1))
        ).drop("_parts")
        place = [*place, "_part"]

    # Of one instant the sample comes first, as its `_row` is null.
    so_far = Window.partitionBy(*place).orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (
        spread(placed.unionByName(series, allowMissingColumns=True), place, rows.count())
        .withColumn("_prev", F.last("_sample", True).over(so_far))
        .filter("_row")
        .join(carried, [*keys, SLICE], "left")
    )
    own = F.struct(*[F.col("_prev")[c].alias(c) for c in [sample_time, *values]])
    prev = F.when(F.col("_prev").isNotNull(), own).otherwise(F.col("_carry_prev"))
    here = F.when(F.col("_prev").isNotNull(), F.col("_prev")["_follows"]).otherwise(F.col("_first"))
    nxt = F.coalesce(here, "_carry_next")
    ahead = F.col("_after")[sample_time] - F.col("_t")
    behind = F.col("_t") - F.col("_before")[sample_time]
    chosen = F.when(F.col("_before").isNull(), F.col("_after")).when(ahead < behind, F.col("_after")).otherwise(
        F.col("_before")
    )
    return (
        met.withColumn("_before", prev)
        .withColumn("_after", nxt)
        .withColumn("_near", F.when(F.col("_t").isNotNull(), chosen))
        .select(*rows.columns, *[F.col("_near")[c].alias(c) for c in [sample_time, *values]])
    )
