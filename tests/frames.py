"""Small inputs for the tests."""

from pyspark.sql import types as T

LAPS = T.StructType(
    [
        T.StructField("season", T.IntegerType()),
        T.StructField("round_number", T.IntegerType()),
        T.StructField("session_name", T.StringType()),
        T.StructField("circuit", T.StringType()),
        T.StructField("driver", T.StringType()),
        T.StructField("lap_number", T.IntegerType()),
        T.StructField("stint", T.IntegerType()),
        T.StructField("compound", T.StringType()),
        T.StructField("tyre_life", T.IntegerType()),
        T.StructField("lap_time_s", T.DoubleType()),
        T.StructField("pit_in_time", T.LongType()),
        T.StructField("pit_out_time", T.LongType()),
        T.StructField("track_status", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("lap_end_us", T.LongType()),
        T.StructField("tel_driver", T.StringType()),
        T.StructField("tel_lap", T.IntegerType()),
    ]
)


def lap(number, time, stint=1, driver="AAA", compound="SOFT", **over):
    row = dict(
        season=2023, round_number=1, session_name="R", circuit="C0", driver=driver, lap_number=number, stint=stint,
        compound=compound, tyre_life=number, lap_time_s=time, pit_in_time=None, pit_out_time=None, track_status="1",
        deleted=False, lap_end_us=number * 90_000_000, tel_driver=driver, tel_lap=number,
    )
    row.update(over)
    return row


def laps(spark, rows):
    names = LAPS.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LAPS)


TEL = (
    "driver string, lap_number int, circuit string, time_s double, seq long, speed double, throttle double, "
    "brake double, n_gear double, distance double, drs int"
)


def telemetry(spark, speed, distance=None, brake=None, throttle=None, time=None, drs=None, driver="AAA", number=1):
    n = len(speed)
    time = time or [float(i) for i in range(n)]
    distance = distance or [100.0 * i for i in range(n)]
    rows = [
        (
            driver, number, "C0", float(time[i]), i,
            None if speed[i] is None else float(speed[i]),
            float((throttle or [50.0] * n)[i]), float((brake or [0.0] * n)[i]), 6.0, float(distance[i]),
            (drs or [1] * n)[i],
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, TEL)


def by(df, key, *values):
    rows = df.select(key, *values).collect()
    return {r[0]: (r[1] if len(values) == 1 else tuple(r[1:])) for r in rows}
