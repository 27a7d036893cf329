"""The driver's parquet tables seen as laps, weather, telemetry and corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.operators.slices import number_within
from stintwise.settings import DEFAULTS, Settings

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since the epoch, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def race_index(ts: str) -> Column:
    """Three calendar days make one race weekend."""
    return F.floor((F.dayofmonth(ts) - 1) / 3.0).cast("int")


def season_of(r: Column) -> Column:
    return F.when(r >= 5, 2024).otherwise(2023)


def laps(spark: SparkSession, sf_dir: str, s: Settings = DEFAULTS) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "value",
        (F.col("user_id") % 20).cast("int").alias("d"),
        race_index("ts").alias("r"),
        micros("ts").alias("lap_end_us"),
    )
    n = number_within(events, ["r", "d"], "lap_end_us", "event_id", "lap_number", s)
    n = n.withColumn("lap_number", F.col("lap_number").cast("int"))
    stint = (F.floor((F.col("lap_number") - 1) / 8.0) + 1).cast("int")
    pos = (F.col("lap_number") - 1) % 8 + 1
    n = n.withColumn("stint", stint).withColumn("pos", pos)
    d, r, event_id = F.col("d"), F.col("r"), F.col("event_id")
    mix = (d + F.col("stint") + r) % 3
    return n.select(
        season_of(r).alias("season"),
        (r % 5 + 1).alias("round_number"),
        F.lit("R").alias("session_name"),
        F.concat(F.lit("C"), r.cast("string")).alias("circuit"),
        F.concat(F.lit("D"), d.cast("string")).alias("driver"),
        "lap_number",
        "stint",
        F.when((d == 13) & (r == 2) & (F.col("lap_number") == 2), "HARD")
        .when((r == 9) & (d % 5 == 0), "INTERMEDIATE")
        .when((d == 7) & (F.col("stint") == 1), None)
        .when(mix == 0, "SOFT")
        .when(mix == 1, "MEDIUM")
        .otherwise("HARD")
        .alias("compound"),
        (F.col("pos") + d % 3).alias("tyre_life"),
        F.when(event_id % 41 == 0, None)
        .otherwise(F.lit(85.0) + F.col("value") * F.lit(0.05) + F.col("pos") * F.lit(0.08))
        .alias("lap_time_s"),
        F.when(F.col("pos") == 8, F.col("lap_end_us")).alias("pit_in_time"),
        F.when((F.col("pos") == 1) & (F.col("stint") > 1), F.col("lap_end_us")).alias("pit_out_time"),
        F.when((F.col("event_type") == "error") & (event_id % 2 == 0), "14")
        .when(F.col("event_type") == "signup", "12")
        .otherwise("1")
        .alias("track_status"),
        F.when(event_id % 37 == 0, True).when(event_id % 53 == 0, None).otherwise(False).alias("deleted"),
        "lap_end_us",
        # The eleventh weekend of a month reads the telemetry of the first.
        season_of(r % 10).alias("tel_season"),
        (r % 5 + 1).alias("tel_round"),
        F.lit("R").alias("tel_session"),
        F.concat(F.lit("S"), (r + 10 * (d % 10)).cast("string")).alias("tel_driver"),
        (F.col("lap_number") % 8 + 1).cast("int").alias("tel_lap"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    r = race_index("ts")
    return e.select(
        season_of(r).alias("season"),
        (r % 5 + 1).alias("round_number"),
        F.lit("R").alias("session_name"),
        micros("ts").alias("w_us"),
        F.col("event_id").alias("w_seq"),
        (F.lit(15.0) + F.col("event_id") % 20).alias("air_temp"),
        F.when(F.col("event_id") % 7 != 0, F.lit(25.0) + F.col("value") * F.lit(0.05)).alias("track_temp"),
        (F.col("event_id") % 10 == 0).alias("rainfall"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofyear("l_shipdate") - 1
    part = F.col("l_partkey")
    r = (F.col("l_suppkey") % 10).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        season_of(r).alias("season"),
        (r % 5 + 1).alias("round_number"),
        F.lit("R").alias("session_name"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("driver"),
        (F.year("l_shipdate") - 1994).alias("lap_number"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 10).cast("string")).alias("circuit"),
        (day * F.lit(0.25)).alias("time_s"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.when(part % 17 != 0, F.col("l_quantity") * F.lit(8.0)).alias("speed"),
        (F.col("l_discount") * F.lit(1000.0)).alias("throttle"),
        F.when(F.col("l_returnflag") == "R", 100.0).otherwise(0.0).alias("brake"),
        F.col("l_linenumber").cast("double").alias("n_gear"),
        (day * F.lit(15.0) - F.when(part % 23 == 0, 20.0).otherwise(0.0)).alias("distance"),
        F.when(F.col("l_linestatus") == "O", 12).otherwise(1).alias("drs"),
    )


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("number"))
        .select(
            F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("circuit"),
            "number",
            (F.col("number") * F.lit(900.0) + F.col("n_nationkey") * F.lit(31.0)).alias("distance"),
        )
    )
