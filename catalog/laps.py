"""Lap rules, stints, targets, joins of laps with weather, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, tables
from catalog.sql import CAUTION, DELETED, PIT, SES, START, STINT, r
from stintwise.functions import laps as L
from stintwise.operators import evaluate as E
from stintwise.operators import splits, stints
from stintwise.operators.asof import nearest_join
from stintwise.plans import lap_record as R
from stintwise.schema import LAP, SESSION
from stintwise.schema import STINT as STINT_KEYS
from stintwise.sources import driver_tables as D

KEYS = f"{SES}, driver, lap_number"


def _flag(name, column, expr, build):
    @query(name, f"SELECT {KEYS}, {expr} AS {column} FROM laps")
    def run(spark, d):
        return D.laps(spark, d).select(*LAP, build().alias(column))


_flag("p1_deleted_lap", "is_deleted", DELETED, L.is_deleted)
_flag("p2_pit_lap", "is_pit_lap", PIT, L.is_pit_lap)
_flag("p3_under_caution", "is_under_caution", CAUTION, L.is_under_caution)
_flag("p5_race_start_lap", "is_race_start", START, L.is_race_start)


@query(
    "p4_lap_time_outlier",
    f"SELECT {KEYS}, lap_time_s IS NULL OR lap_time_s > reference_s * 1.15e0 AS is_outlier FROM vlaps WHERE reference_s IS NOT NULL",
)
def p4(spark, d):
    laps = stints.with_validity(stints.with_stints(D.laps(spark, d))).filter(F.col("reference_s").isNotNull())
    return laps.select(*LAP, L.is_outlier(F.col("reference_s")).alias("is_outlier"))


@query("p6_valid_lap", f"SELECT {KEYS}, {r('reference_s')}, is_valid_lap FROM vlaps")
def p6(spark, d):
    laps = stints.with_validity(stints.with_stints(D.laps(spark, d)))
    return rounded(laps.select(*LAP, "reference_s", "is_valid_lap"))


@query("p7_valid_rows", f"SELECT {SES}, count(*) AS n_valid FROM vlaps WHERE is_valid_lap GROUP BY {SES}")
def p7(spark, d):
    laps = stints.with_validity(stints.with_stints(D.laps(spark, d)))
    return E.valid_rows(laps).groupBy(*SESSION).agg(F.count("*").alias("n_valid"))


@query(
    "p8_training_rows",
    f"SELECT {KEYS}, {r('lap_time_delta_s')} FROM tlaps WHERE is_valid_lap AND lap_time_delta_s IS NOT NULL AND tyre_life IS NOT NULL AND compound IS NOT NULL",
)
def p8(spark, d):
    rows = E.training_rows(stints.stint_laps(D.laps(spark, d)), ["lap_time_delta_s", "tyre_life", "compound"])
    return rounded(rows.select(*LAP, "lap_time_delta_s"))


@query(
    "p12_analysis_filters",
    f"SELECT {KEYS}, compound, tyre_life FROM laps WHERE circuit = 'C3' AND compound IN ('SOFT', 'HARD') AND tyre_life BETWEEN 2 AND 7",
)
def p12(spark, d):
    keep = (F.col("circuit") == "C3") & F.col("compound").isin("SOFT", "HARD") & F.col("tyre_life").between(2, 7)
    return D.laps(spark, d).filter(keep).select(*LAP, "compound", "tyre_life")


@query(
    "p13_season_filter",
    "SELECT season, count(*) AS n_laps, count(lap_time_s) AS n_timed FROM laps WHERE season IN (2024) GROUP BY season",
)
def p13(spark, d):
    picked = D.laps(spark, d).filter(F.col("season").isin(2024))
    return picked.groupBy("season").agg(F.count("*").alias("n_laps"), F.count("lap_time_s").alias("n_timed"))


@query("a1_stint_table", f"""
SELECT {', '.join('s.' + k.strip() for k in STINT.split(','))}, s.stint_compound AS compound, s.stint_laps, l.lap_numbers, s.is_complete
FROM stints s JOIN (SELECT {STINT}, string_agg(CAST(lap_number AS VARCHAR), ',' ORDER BY lap_number) AS lap_numbers FROM laps GROUP BY {STINT}) l
USING ({STINT})""")
def a1(spark, d):
    laps = D.laps(spark, d)
    lists = stints.stint_lap_lists(laps).withColumn(
        "lap_numbers", F.concat_ws(",", F.col("lap_numbers").cast("array<string>"))
    )
    table = stints.stint_table(laps).withColumn("stint_laps", F.col("stint_laps").cast("long"))
    return table.join(lists, STINT_KEYS).select(*STINT_KEYS, "compound", "stint_laps", "lap_numbers", "is_complete")


@query("a1_laps_listed_twice", f"""
SELECT {', '.join('s.' + k.strip() for k in STINT.split(','))}, s.stint_laps, s.first_lap, s.last_lap, s.is_complete, l.n_laps, {r('l.sum_time', 'sum_time')}
FROM stints s LEFT JOIN (SELECT {STINT}, count(*) AS n_laps, sum(lap_time_s) AS sum_time FROM slaps GROUP BY {STINT}) l USING ({STINT})""")
def a1_twice(spark, d):
    """Every third lap listed again, later and slower: stints and laps are those of the first copies."""
    laps = D.laps(spark, d)
    again = laps.filter(F.col("lap_number") % 3 == 0).withColumns(
        {"lap_end_us": F.col("lap_end_us") + 1_000_000, "lap_time_s": F.col("lap_time_s") + 50.0}
    )
    listed = laps.unionByName(again)
    sums = stints.with_stints(listed).groupBy(*STINT_KEYS).agg(F.count("*").alias("n_laps"), F.sum("lap_time_s").alias("sum_time"))
    table = stints.stint_table(listed).withColumn("stint_laps", F.col("stint_laps").cast("long"))
    return rounded(table.join(sums, STINT_KEYS, "left").select(*STINT_KEYS, "stint_laps", "first_lap", "last_lap", "is_complete", "n_laps", "sum_time"))



@query("a2_mixed_compound_drivers", f"SELECT {STINT}, stint_laps FROM stints WHERE is_mixed")
def a2(spark, d):
    return stints.mixed_stint_drivers(D.laps(spark, d)).withColumn("stint_laps", F.col("stint_laps").cast("long"))


@query("a3_stint_complete", f"SELECT {STINT}, is_complete FROM stints")
def a3(spark, d):
    return stints.stint_table(D.laps(spark, d)).select(*STINT_KEYS, "is_complete")


@query("a4_stint_reference_time", f"SELECT {STINT}, {r('reference_s')} FROM refs")
def a4(spark, d):
    laps = stints.with_validity(stints.with_stints(D.laps(spark, d)))
    return rounded(laps.select(*STINT_KEYS, "reference_s").distinct())


@query("a5_stint_consistency", f"SELECT {STINT}, {r('driver_consistency_std_s')} FROM bases")
def a5(spark, d):
    laps = stints.stint_laps(D.laps(spark, d))
    return rounded(laps.groupBy(*STINT_KEYS).agg(F.max("driver_consistency_std_s").alias("driver_consistency_std_s")))


@query("a6_stint_baseline", f"SELECT {STINT}, {r('baseline_s')} FROM bases")
def a6(spark, d):
    laps = stints.stint_laps(D.laps(spark, d))
    return rounded(laps.groupBy(*STINT_KEYS).agg(F.max("baseline_s").alias("baseline_s")))


@query("a7_reference_lap", f"SELECT {SES}, ref_driver, ref_lap, {r('ref_time_s')} FROM ref_laps")
def a7(spark, d):
    return rounded(R.reference_laps(D.laps(spark, d)).select(*SESSION, "ref_driver", "ref_lap", "ref_time_s"))


@query(
    "w9_w10_w11_lap_targets",
    f"SELECT {KEYS}, {r('lap_time_delta_s')}, remaining_tire_life_laps, stint_length_laps FROM tlaps",
)
def w9(spark, d):
    laps = stints.stint_laps(D.laps(spark, d))
    whole = {c: F.col(c).cast("long") for c in ("remaining_tire_life_laps", "stint_length_laps")}
    return rounded(laps.withColumns(whole).select(*LAP, "lap_time_delta_s", *whole))


@query("j5_stint_aggregates_on_laps", f"""
SELECT {KEYS}, stint_compound, stint_laps, {r('reference_s')}, {r('baseline_s')}, {r('driver_consistency_std_s')} FROM tlaps""")
def j5(spark, d):
    laps = stints.stint_laps(D.laps(spark, d)).withColumn("stint_laps", F.col("stint_laps").cast("long"))
    return rounded(
        laps.select(*LAP, "stint_compound", "stint_laps", "reference_s", "baseline_s", "driver_consistency_std_s")
    )


@query("j1_race_key_semi_join", f"""
SELECT {SES}, count(*) AS n_laps FROM laps SEMI JOIN test_races t USING ({SES}) GROUP BY {SES}""")
def j1(spark, d):
    laps = D.laps(spark, d)
    _, test = splits.split_chronological(laps)
    picked = splits.split_by_keys(laps, splits.race_keys(test))
    return picked.groupBy(*SESSION).agg(F.count("*").alias("n_laps"))


@query("j2_nearest_weather", f"SELECT {KEYS}, w_us, w_seq, {r('air_temp')}, {r('track_temp')}, rainfall FROM near")
def j2(spark, d):
    near = nearest_join(
        D.laps(spark, d), D.weather(spark, d), SESSION, "lap_end_us", "w_us", "w_seq",
        ["w_seq", "air_temp", "track_temp", "rainfall"],
    )
    return rounded(near.select(*LAP, "w_us", "w_seq", "air_temp", "track_temp", "rainfall"))


@query("f3_weather_class", f"SELECT {KEYS}, is_raining, weather, {r('track_temp_c')} FROM wlaps")
def f3(spark, d):
    laps = R.with_weather(stints.with_stints(D.laps(spark, d)), D.weather(spark, d))
    return rounded(laps.select(*LAP, "is_raining", "weather", "track_temp_c"))


@query(
    "f1_fuel_load",
    f"SELECT {KEYS}, {r('greatest(100.0e0 - greatest(lap_number - 1, 0) * 1.6e0, 0.0e0)', 'fuel_load_estimate_kg')} FROM laps",
)
def f1(spark, d):
    return rounded(D.laps(spark, d).select(*LAP, L.fuel_load().alias("fuel_load_estimate_kg")))


@query(
    "f2_fuel_load_at_age",
    f"SELECT {KEYS}, {r('greatest(100.0e0 - tyre_life * 1.6e0, 0.0e0)', 'fuel_at_age_kg')} FROM laps",
)
def f2(spark, d):
    return rounded(D.laps(spark, d).select(*LAP, L.fuel_load_at_age(F.col("tyre_life")).alias("fuel_at_age_kg")))


@query("f5_duration_seconds", "SELECT event_id, " + r("(us - epoch_us(date_trunc('day', ts))) / 1e6", "into_day_s") + " FROM ev")
def f5(spark, d):
    events = D.table(spark, d, "events")
    into_day = F.col("ts") - F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    return rounded(events.select("event_id", L.seconds(into_day).alias("into_day_s")))


@query("f10_session_key", f"SELECT DISTINCT format('{{:d}}_{{:02d}}_{{}}', season, round_number, session_name) AS session_key FROM laps")
def f10(spark, d):
    return splits.race_keys(D.laps(spark, d)).select(L.session_key().alias("session_key"))


@query("f11_holdout_size", """
SELECT season, n_races, share, greatest(1, least(CAST(round_even(n_races * share, 0) AS BIGINT), n_races - 1)) AS n_test
FROM (SELECT season, count(DISTINCT round_number) AS n_races FROM laps GROUP BY season), (VALUES (0.1e0), (0.3e0), (0.5e0), (0.7e0)) v(share)""")
def f11(spark, d):
    shares = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7)]))
    races = splits.race_keys(D.laps(spark, d)).groupBy("season").agg(F.count("*").alias("n_races"))
    sized = races.withColumn("share", shares)
    return sized.withColumn("n_test", L.holdout_size(F.col("n_races"), F.col("share")).cast("long"))


@query("io6_select_sessions", """
SELECT DISTINCT season, r % 5 AS round_number FROM (SELECT CASE WHEN r >= 5 THEN 2024 ELSE 2023 END AS season, r FROM ev)
WHERE season IN (2023, 2024) AND r % 5 > 0 AND r % 5 IN (1, 3, 4)""")
def io6(spark, d):
    from stintwise.sources.dataset import select_sessions

    schedule = D.laps(spark, d).select("season", (F.col("round_number") - 1).alias("round_number")).distinct()
    return select_sessions(schedule, [2023, 2024], [1, 3, 4])


@query("io5_pending_sessions", f"SELECT DISTINCT {SES} FROM laps WHERE season <> 2023")
def io5(spark, d):
    from stintwise.sources.dataset import pending_sessions

    sessions = splits.race_keys(D.laps(spark, d))
    return pending_sessions(sessions, sessions.filter(F.col("season") == 2023))


@query("io7_session_inputs", f"""
SELECT {SES}, n_laps, n_weather, n_corners FROM (SELECT {SES}, circuit, count(*) AS n_laps FROM laps GROUP BY {SES}, circuit)
LEFT JOIN (SELECT {SES}, count(*) AS n_weather FROM weather GROUP BY {SES}) USING ({SES})
LEFT JOIN (SELECT circuit, count(*) AS n_corners FROM corners GROUP BY circuit) USING (circuit)""")
def io7(spark, d):
    t = tables(spark, d)
    laps = t.laps.groupBy(*SESSION, "circuit").agg(F.count("*").alias("n_laps"))
    weather = t.weather.groupBy(*SESSION).agg(F.count("*").alias("n_weather"))
    marks = t.corners.groupBy("circuit").agg(F.count("*").alias("n_corners"))
    joined = laps.join(weather, SESSION, "left").join(marks, "circuit", "left")
    return joined.select(*SESSION, "n_laps", "n_weather", "n_corners")
