"""Places of rows in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.lookup import settle

PART = "_part"


def salt() -> Column:
    """Parts rows that are equal in all that an order looks at. Which of them comes first makes
    no difference; it only has to be written down before it is used."""
    return F.xxhash64(F.monotonically_increasing_id())


def in_order(rows: DataFrame, order: list) -> DataFrame:
    """The rows dealt by ranges of `order` and written, with the number of their range in PART.
    `order` should end in a written `salt()`, so that equal rows can be parted too."""
    return settle(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def running(rows: DataFrame, groups: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over a group's earlier rows, for rows as `in_order` wrote them by `groups`
    and `order`. Groups are never null. A range is summed by itself, and one row per group and
    range carries its sums on."""
    keys = [*groups, PART]
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()})
    return inside.join(starts, keys).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(PART, *[f"_{n}" for n in sums])


def placed(rows: DataFrame, groups: list[str], order: list, at: str) -> DataFrame:
    """Adds each row's place in its group, from 0."""
    whole = [*groups, *order]
    return running(in_order(rows, whole), groups, order, {at: F.lit(1).cast("long")})
