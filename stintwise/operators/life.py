"""Stint-life estimates: sweep tire age through any scoring function and find the crossing.

A request row becomes one row per age. Requests are spread by their id before they grow, so
the ages of a request stay together and the window over them needs no further shuffle. They are
counted first: a task gets about REQUESTS of them however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintwise.operators.evaluate import PREDICTED
from stintwise.operators.linear import AGE
from stintwise.settings import DEFAULTS, Settings

Score = Callable[[DataFrame], DataFrame]

REQUESTS = 8192  # of a task; a million rows once they have grown


def half_lap_ages(s: Settings = DEFAULTS) -> Column:
    """1, 1.5, ... up to the largest age."""
    return F.transform(F.sequence(F.lit(2), F.lit(2 * s.max_age_laps)), lambda i: i / F.lit(2.0))


def whole_lap_ages(s: Settings = DEFAULTS) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(s.max_age_laps)), lambda i: i.cast("double"))


def sweep(
    requests: DataFrame,
    keys: list[str],
    ages: Column,
    by_age: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Requests times ages. `by_age` names inputs that follow from the age; they replace a
    fixed value of the same name."""
    parts = max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // REQUESTS))
    swept = requests.drop(AGE).repartition(parts, *keys).withColumn(AGE, F.explode(ages))
    for name, fn in (by_age or {}).items():
        swept = swept.withColumn(name, fn(F.col(AGE)))
    return swept


def crossing(scored: DataFrame, keys: list[str], threshold: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Age at which the prediction first rises through the threshold, between two adjacent
    ages, by linear interpolation. Null if it never does, also when it starts above, which
    `starts_above` tells apart. `keep` names columns constant within a request."""
    ordered = Window.partitionBy(*keys).orderBy(AGE)
    d0, d1 = F.lag(PREDICTED).over(ordered), F.col(PREDICTED)
    a0 = F.lag(AGE).over(ordered)
    steps = scored.withColumns({"_t": threshold, "_d0": d0, "_a0": a0})
    rises = (F.col("_d0") < F.col("_t")) & (F.col("_t") <= d1)
    at = F.col("_a0") + (F.col("_t") - F.col("_d0")) / F.nullif(d1 - F.col("_d0"), F.lit(0.0)) * (
        F.col(AGE) - F.col("_a0")
    )
    return steps.groupBy(*keys, *keep).agg(
        F.min_by(F.when(rises, at), F.when(rises, F.col(AGE))).alias("life_laps"),
        F.coalesce(F.min_by(PREDICTED, AGE) >= F.max("_t"), F.lit(False)).alias("starts_above"),
    )


def first_age_at(
    scored: DataFrame, keys: list[str], threshold: Column, support: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """First whole age whose delta, rounded to 3 decimals, reaches the threshold.

    `durable` when none does. With `support`, a boolean column that marks thin evidence,
    also whether any age up to that one is thin."""
    delta = F.round(PREDICTED, 3)
    reached = F.min(F.when(delta >= threshold, F.col(AGE))).alias("life_laps")
    aggs = [reached]
    if support:
        aggs.append(F.min(F.when(F.col(support), F.col(AGE))).alias("_thin_from"))
    out = scored.groupBy(*keys, *keep).agg(*aggs).withColumn("durable", F.col("life_laps").isNull())
    if support:
        thin = F.col("_thin_from") <= F.coalesce("life_laps", F.lit(float("inf")))
        out = out.withColumn("sparse_data", F.coalesce(thin, F.lit(False))).drop("_thin_from")
    return out


def estimate_life(
    requests: DataFrame,
    keys: list[str],
    score: Score,
    threshold: Column,
    by_age: dict[str, Callable[[Column], Column]] | None = None,
    keep: tuple[str, ...] = (),
    s: Settings = DEFAULTS,
) -> DataFrame:
    """Life in laps of every request."""
    return crossing(score(sweep(requests, keys, half_lap_ages(s), by_age)), keys, threshold, keep)


def best_compound(report: DataFrame, keys: list[str]) -> DataFrame:
    """Compound with the longest known life per request; the earlier listed wins a tie."""
    known = F.col("life_laps").isNotNull()
    rank = F.when(known, F.struct("life_laps", -F.col("pos")))
    return report.groupBy(*keys).agg(
        F.max_by("compound", rank).alias("best_compound"), F.max("life_laps").alias("best_life_laps")
    )


def ranked(report: DataFrame, keys: list[str]) -> DataFrame:
    """Compounds of a request from longest to shortest life, those that never wear out last."""
    order = Window.partitionBy(*keys).orderBy(F.col("life_laps").desc_nulls_last(), "pos")
    return report.withColumn("rank", F.row_number().over(order))
