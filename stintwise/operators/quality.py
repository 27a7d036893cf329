"""Counts, summaries and listings used to judge a lap table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.functions.laps import age_bracket
from stintwise.operators.lookup import join_pinned, pin_small
from stintwise.operators.quantiles import exact_quantiles
from stintwise.schema import SESSION
from stintwise.settings import DEFAULTS, Settings

STINT_KEYS = [*SESSION, "driver_code", "stint_number"]
DRY = ("SOFT", "MEDIUM", "HARD")  # fixed values


def delta_summary(df: DataFrame, by: list[str], c: str = "lap_time_delta_s") -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(c).alias("mean_s"),
        F.stddev_samp(c).alias("std_s"),
        F.min(c).alias("min_s"),
        F.max(c).alias("max_s"),
        F.count(c).alias("n_rows"),
    )


def round_counts(df: DataFrame) -> DataFrame:
    """Laps and caution laps per round of a season and compound."""
    return df.groupBy("season", "round_number", "tire_compound").agg(
        F.count("*").alias("n_laps"), F.count_if("is_safety_car_lap").alias("n_caution")
    )


def age_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, age_bracket().alias("age_bracket")).agg(F.count("*").alias("n_laps"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Circuits and drivers per compound. Each pair is reduced to one row first."""
    seen = df.groupBy("tire_compound", "circuit", "driver_code").agg(F.lit(1))
    return seen.groupBy("tire_compound").agg(
        F.count_distinct("circuit").alias("n_circuits"), F.count_distinct("driver_code").alias("n_drivers")
    )


def null_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def group_means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def feature_ranges(sides: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Smallest and largest value per column on each side."""
    aggs = [fn(c).alias(f"{name}_{c}") for c in columns for name, fn in (("min", F.min), ("max", F.max))]
    rows = [df.agg(*aggs).withColumn("side", F.lit(side)) for side, df in sides.items()]
    return reduce(DataFrame.unionByName, rows)


def describe(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a column."""
    p25, p50, p75 = exact_quantiles(df, c, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.lit(p25).cast("double").alias("p25"),
        F.lit(p50).cast("double").alias("p50"),
        F.lit(p75).cast("double").alias("p75"),
        F.max(c).alias("max"),
    )


def cleanest_stints(df: DataFrame, n: int) -> DataFrame:
    """The n stints with most valid laps on a dry compound."""
    dry = df.filter(F.col("tire_compound").isin(*DRY) & F.col("is_valid_lap"))
    counted = dry.groupBy(*STINT_KEYS).agg(F.count("*").alias("n_valid"))
    return counted.orderBy(F.col("n_valid").desc(), *STINT_KEYS).limit(n)


def laps_of_stints(df: DataFrame, stints: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """All laps of the listed stints."""
    keys, pinned = pin_small(stints.select(*STINT_KEYS), s)
    return join_pinned(df, keys, pinned, STINT_KEYS, "inner")


def one_hot(train: DataFrame, df: DataFrame, column: str, s: Settings = DEFAULTS) -> DataFrame:
    """Indicator columns for the values of training; a value it never saw sets none."""
    values = train.select(column).filter(F.col(column).isNotNull()).distinct()
    names = [row[0] for row in values.orderBy(column).collect()]  # one per column of the result
    hot = {f"is_{v.lower()}": F.coalesce(F.col(column) == v, F.lit(False)).cast("double") for v in names}
    return df.withColumns(hot)
