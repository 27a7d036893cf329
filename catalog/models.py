"""Splits, metrics, analysis reports and wear models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded, stored_once, tables
from catalog.sql import ALPHAS, METRICS, SES, gram, r
from stintwise.functions import laps as L
from stintwise.operators import evaluate as E
from stintwise.operators import forest as RF
from stintwise.operators import linear as M
from stintwise.operators import quality as Q
from stintwise.operators import splits, stints
from stintwise.operators.lookup import settle
from stintwise.plans import lap_record as R
from stintwise.schema import SESSION, required_columns
from stintwise.sources import driver_tables as D

KEYS = f"{SES}, driver_code, lap_number"
LAP_KEYS = [*SESSION, "driver_code", "lap_number"]


def lap_rows(spark, d) -> DataFrame:
    """Laps with targets under the record's names, without weather, track or telemetry."""
    return stints.stint_laps(D.laps(spark, d)).withColumnsRenamed(
        {"stint_compound": "tire_compound", "tyre_life": "tire_age_laps", "driver": "driver_code", "stint": "stint_number"}
    ).withColumn("is_safety_car_lap", L.is_under_caution())


def lap_split(spark, d):
    """Laps, settled because a fit and its scoring both read them, split by time."""
    return splits.split_chronological(settle(lap_rows(spark, d)))


def condition_rows(spark, d) -> DataFrame:
    return R.lap_conditions(tables(spark, d))


def record_rows(spark, d) -> DataFrame:
    """Whole records, for fits on the features of the lap's own telemetry."""
    return R.lap_records(tables(spark, d))


def record_split(spark, d):
    return splits.split_chronological(settle(record_rows(spark, d)))


def condition_split(spark, d):
    return splits.split_chronological(settle(condition_rows(spark, d)))


# --- splits -------------------------------------------------------------------------------


@query("a29_t3_race_keys", f"SELECT DISTINCT {SES} FROM laps")
def a29(spark, d):
    return splits.race_keys(D.laps(spark, d)).orderBy(*SESSION)


@query("w14_race_order", f"SELECT {SES}, race_rank FROM ranked_races")
def w14(spark, d):
    return splits.chronological_rank(D.laps(spark, d)).withColumn("race_rank", F.col("race_rank").cast("long"))


@query("d1_split_chronological", f"""
SELECT 'train' AS side, {SES}, count(*) AS n_laps FROM ltr GROUP BY {SES}
UNION ALL SELECT 'test', {SES}, count(*) FROM lte GROUP BY {SES}""")
def d1(spark, d):
    train, test = splits.split_chronological(lap_rows(spark, d))
    sides = [s.groupBy(*SESSION).agg(F.count("*").alias("n_laps")).withColumn("side", F.lit(n)) for n, s in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


@query("d2_split_random", f"""
SELECT count(DISTINCT ({SES})) FILTER (NOT held) AS train_races, count(DISTINCT ({SES})) FILTER (held) AS test_races,
 count(*) FILTER (NOT held) AS train_laps, count(*) FILTER (held) AS test_laps
FROM (SELECT *, ({SES}) IN (SELECT ({SES}) FROM (SELECT DISTINCT {SES} FROM tlaps)
  ORDER BY md5(concat_ws('|', '42', season, round_number, session_name)), {SES}
  LIMIT (SELECT round_even(0.3 * count(DISTINCT ({SES})), 0)::bigint FROM tlaps)) AS held FROM tlaps)""")
def d2(spark, d):
    train, test = splits.split_random(lap_rows(spark, d), 0.3, seed=42)
    return splits.split_summary(train, test)


@query("d3_split_by_season", """
SELECT count(*) FILTER (WHERE season = 2023) AS train_laps, count(*) FILTER (WHERE season = 2024) AS test_laps FROM tlaps""")
def d3(spark, d):
    train, test = splits.split_by_season(lap_rows(spark, d), [2023], [2024])
    return splits.split_summary(train, test).select("train_laps", "test_laps")


_NESTED = f"""WITH k AS (SELECT *, count(*) OVER () AS m FROM (SELECT {SES}, race_rank FROM ranked_races
 WHERE race_rank <= n - greatest(1, least(CAST(round_even(n * 0.2e0, 0) AS BIGINT), n - 1))))
SELECT {SES}, CASE WHEN race_rank > m - greatest(1, least(CAST(round_even(m * 0.2e0, 0) AS BIGINT), m - 1)) THEN 'validation' ELSE 'tune' END AS side FROM k"""


@query("d4_nested_split", f"SELECT side, {SES} FROM ({_NESTED})")
def d4(spark, d):
    train, _ = splits.split_chronological(D.laps(spark, d))
    tune, validation = splits.split_chronological(train)
    return splits.race_keys(tune).withColumn("side", F.lit("tune")).unionByName(
        splits.race_keys(validation).withColumn("side", F.lit("validation"))
    )


@query("a27_split_summary", f"""
SELECT (SELECT count(DISTINCT ({SES})) FROM ltr) AS train_races, (SELECT count(DISTINCT ({SES})) FROM lte) AS test_races,
 (SELECT count(*) FROM ltr) AS train_laps, (SELECT count(*) FROM lte) AS test_laps""")
def a27(spark, d):
    return splits.split_summary(*splits.split_chronological(lap_rows(spark, d)))


@query("s2_uncovered_compounds", "SELECT DISTINCT tire_compound FROM lte WHERE tire_compound NOT IN (SELECT tire_compound FROM ltr) ORDER BY 1")
def s2(spark, d):
    return splits.uncovered_compounds(*splits.split_chronological(lap_rows(spark, d))).orderBy("tire_compound")


@query("s3_circuits_seen_and_unseen", """
SELECT DISTINCT circuit, circuit IN (SELECT circuit FROM laps WHERE season = 2023 OR round_number = 1) AS in_train
FROM laps WHERE season = 2024""")
def s3(spark, d):
    laps = D.laps(spark, d)
    train = laps.filter((F.col("season") == 2023) | (F.col("round_number") == 1))
    return splits.seen_and_unseen(train, laps.filter(F.col("season") == 2024))


@query("s4_unseen_categories", """
SELECT DISTINCT 'circuit' AS feature, circuit AS value FROM lte WHERE circuit NOT IN (SELECT circuit FROM ltr)
UNION SELECT DISTINCT 'tire_compound', tire_compound FROM lte WHERE tire_compound NOT IN (SELECT tire_compound FROM ltr)""")
def s4(spark, d):
    train, test = splits.split_chronological(lap_rows(spark, d))
    return splits.unseen_values(train, test, ["circuit", "tire_compound"])


@query("s1_union_fragments", f"SELECT {SES}, count(*) AS n_laps, count(reference_s) AS n_referenced FROM vlaps GROUP BY {SES}")
def s1(spark, d):
    laps = stints.with_validity(stints.with_stints(D.laps(spark, d)))
    fragments = [laps.filter(F.col("season") == y) for y in (2023, 2024)]
    both = fragments[0].unionByName(fragments[1].drop("pit_in_time"), allowMissingColumns=True)
    return both.groupBy(*SESSION).agg(F.count("*").alias("n_laps"), F.count("reference_s").alias("n_referenced"))


# --- analysis reports ---------------------------------------------------------------------


@query("a17_residual_summary", f"""
SELECT circuit, tire_compound, {r('avg(lap_time_delta_s - predicted)', 'mean_residual')}, {r('stddev_samp(lap_time_delta_s - predicted)', 'std_residual')}, count(*) AS n_rows
FROM lin_te WHERE lap_time_delta_s IS NOT NULL AND predicted IS NOT NULL GROUP BY circuit, tire_compound""")
def a17(spark, d):
    train, test = lap_split(spark, d)
    scored = M.predict_polynomial(M.fit_polynomial(train), test)
    return rounded(E.residual_summary(scored, ["circuit", "tire_compound"]))


_DELTA = f"{r('avg(lap_time_delta_s)', 'mean_s')}, {r('stddev_samp(lap_time_delta_s)', 'std_s')}, {r('min(lap_time_delta_s)', 'min_s')}, {r('max(lap_time_delta_s)', 'max_s')}, count(lap_time_delta_s) AS n_rows"


@query("a18_delta_by_compound", f"SELECT circuit, stint_compound AS tire_compound, {_DELTA} FROM tlaps WHERE is_valid_lap GROUP BY 1, 2")
def a18(spark, d):
    return rounded(Q.delta_summary(E.valid_rows(lap_rows(spark, d)), ["circuit", "tire_compound"]))


@query("a18_delta_by_age", f"SELECT tyre_life AS tire_age_laps, {_DELTA} FROM tlaps WHERE is_valid_lap AND stint_compound = 'HARD' GROUP BY 1")
def a18_age(spark, d):
    hard = E.valid_rows(lap_rows(spark, d)).filter(F.col("tire_compound") == "HARD")
    return rounded(Q.delta_summary(hard, ["tire_age_laps"]))


@query("a19_counts_per_round", """
SELECT season, round_number, stint_compound AS tire_compound, count(*) AS n_laps, count(*) FILTER (WHERE coalesce(regexp_matches(track_status, '[4-7]'), false)) AS n_caution
FROM slaps GROUP BY 1, 2, 3""")
def a19(spark, d):
    return Q.round_counts(lap_rows(spark, d))


@query("a20_age_histogram", """
SELECT circuit, CASE WHEN tyre_life <= 0 THEN NULL WHEN tyre_life <= 5 THEN '1-5' WHEN tyre_life <= 10 THEN '6-10' WHEN tyre_life <= 15 THEN '11-15'
 WHEN tyre_life <= 20 THEN '16-20' WHEN tyre_life <= 25 THEN '21-25' WHEN tyre_life <= 30 THEN '26-30' WHEN tyre_life <= 35 THEN '31-35'
 WHEN tyre_life <= 40 THEN '36-40' WHEN tyre_life <= 100 THEN '41+' END AS age_bracket, count(*) AS n_laps FROM vlaps WHERE is_valid_lap GROUP BY 1, 2""")
def a20(spark, d):
    return Q.age_histogram(E.valid_rows(lap_rows(spark, d)), ["circuit"])


@query("a21_distinct_counts", """
SELECT stint_compound AS tire_compound, count(DISTINCT circuit) AS n_circuits, count(DISTINCT driver) AS n_drivers FROM slaps GROUP BY 1""")
def a21(spark, d):
    return Q.distinct_counts(lap_rows(spark, d))


@query("a22_null_fraction", f"""
SELECT {r('avg(CASE WHEN lap_time_delta_s IS NULL THEN 1.0e0 ELSE 0.0e0 END)', 'lap_time_delta_s')},
 {r('avg(CASE WHEN remaining_tire_life_laps IS NULL THEN 1.0e0 ELSE 0.0e0 END)', 'remaining_tire_life_laps')},
 {r('avg(CASE WHEN driver_consistency_std_s IS NULL THEN 1.0e0 ELSE 0.0e0 END)', 'driver_consistency_std_s')} FROM tlaps""")
def a22(spark, d):
    return rounded(Q.null_fractions(lap_rows(spark, d), ["lap_time_delta_s", "remaining_tire_life_laps", "driver_consistency_std_s"]))


@query("p11_required_columns", """
SELECT 'stint_compound' AS column_name, true AS present, count(stint_compound) AS n_values FROM tlaps
UNION ALL SELECT 'tyre_life', true, count(tyre_life) FROM tlaps
UNION ALL SELECT 'lap_time_delta_s', true, count(lap_time_delta_s) FROM tlaps
UNION ALL SELECT 'avg_throttle_pct', false, 0""")
def p11(spark, d):
    return required_columns(stints.stint_laps(D.laps(spark, d)), ["stint_compound", "tyre_life", "lap_time_delta_s", "avg_throttle_pct"])


@query("a23_describe", f"""
SELECT count(x) AS n, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('min(x)', 'min')}, {r('quantile_cont(x, 0.25)', 'p25')},
 {r('quantile_cont(x, 0.5)', 'p50')}, {r('quantile_cont(x, 0.75)', 'p75')}, {r('max(x)', 'max')} FROM (SELECT lap_time_delta_s AS x FROM tlaps)""")
def a23(spark, d):
    return rounded(Q.describe(settle(lap_rows(spark, d).select("lap_time_delta_s")), "lap_time_delta_s"))


@query("a24_t8_group_means", f"""
SELECT circuit, {r('avg(avg_corner_speed_kph)', 'avg_corner_speed_kph')}, {r('avg(track_temp_c)', 'track_temp_c')} FROM cond GROUP BY circuit""")
def a24(spark, d):
    means = Q.group_means(condition_rows(spark, d), ["circuit"], ["avg_corner_speed_kph", "track_temp_c"])
    return rounded(means.orderBy("avg_corner_speed_kph", "circuit"))


_RANGE = "SELECT '{0}' AS side, " + ", ".join(
    f"{r(f'{fn}({c})', f'{fn}_{c}')}" for c in ("avg_corner_speed_kph", "track_temp_c") for fn in ("min", "max")
) + " FROM {1}"


@query("a24_feature_ranges", _RANGE.format("train", "tr") + " UNION ALL " + _RANGE.format("test", "te"))
def a24_ranges(spark, d):
    columns = ["avg_corner_speed_kph", "track_temp_c"]
    train, test = splits.split_chronological(settle(condition_rows(spark, d).select(*SESSION, *columns)))
    return rounded(Q.feature_ranges({"train": train, "test": test}, columns))


@query("a25_max_age_per_circuit", "SELECT circuit, max(tyre_life) AS max_age_laps FROM slaps GROUP BY circuit")
def a25(spark, d):
    from stintwise.plans.report import max_age_by_circuit

    return max_age_by_circuit(lap_rows(spark, d))


@query("a28_f7_standardisation", f"SELECT {', '.join(r(f'{a}_{k}', f'{c}_{k}') for a, c in (('age', 'tire_age_laps'), ('speed', 'avg_corner_speed_kph'), ('temp', 'track_temp_c')) for k in ('mean', 'std', 'lo', 'hi'))} FROM cstats")
def a28(spark, d):
    train, _ = condition_split(spark, d)
    return rounded(M.feature_stats_row(M.circuit_training(train), (M.AGE, *M.CIRCUIT_FEATURES)))


@query("t1_worst_residuals", f"""
SELECT {SES}, driver AS driver_code, lap_number, tire_compound, {r('lap_time_delta_s - predicted', 'residual')} FROM lin_te
WHERE lap_time_delta_s IS NOT NULL AND predicted IS NOT NULL
ORDER BY abs(lap_time_delta_s - predicted) DESC, {SES}, driver, lap_number LIMIT 10""")
def t1(spark, d):
    train, test = lap_split(spark, d)
    scored = M.predict_polynomial(M.fit_polynomial(train), test)
    return rounded(E.worst_residuals(scored, LAP_KEYS).select(*LAP_KEYS, "tire_compound", "residual"))


_BEST = f"""SELECT {SES}, driver, stint FROM (SELECT {SES}, driver, stint, count(*) AS n FROM vlaps
 WHERE is_valid_lap AND stint_compound IN ('SOFT', 'MEDIUM', 'HARD') GROUP BY {SES}, driver, stint ORDER BY n DESC, {SES}, driver, stint LIMIT 5)"""


_BEST_N = _BEST.replace(f"SELECT {SES}, driver, stint FROM", f"SELECT {SES}, driver, stint, n FROM", 1)


@query("t2_cleanest_stints", f"""
SELECT {SES}, driver AS driver_code, stint AS stint_number, tyre_life AS tire_age_laps, {r('lap_time_s')}, {r('lap_time_delta_s')}, is_valid_lap
FROM tlaps SEMI JOIN ({_BEST}) b USING ({SES}, driver, stint)""")
def t2(spark, d):
    rows = settle(lap_rows(spark, d))
    top = Q.cleanest_stints(rows, 5)
    picked = Q.laps_of_stints(rows, top)
    return rounded(picked.select(*Q.STINT_KEYS, "tire_age_laps", "lap_time_s", "lap_time_delta_s", "is_valid_lap"))


@query("t2_stint_list", f"SELECT {SES}, driver AS driver_code, stint AS stint_number, n AS n_valid FROM ({_BEST_N})")
def t2_list(spark, d):
    return Q.cleanest_stints(lap_rows(spark, d), 5)


@query("t2_best_stint_laps", f"""
SELECT {SES}, driver AS driver_code, stint AS stint_number, tyre_life AS tire_age_laps, {r('lap_time_s')}, {r('lap_time_delta_s')}, is_valid_lap
FROM tlaps SEMI JOIN (SELECT * FROM ({_BEST_N}) ORDER BY n DESC, {SES}, driver, stint LIMIT 1) b USING ({SES}, driver, stint)""")
def t2_best(spark, d):
    rows = settle(lap_rows(spark, d))
    picked = Q.laps_of_stints(rows, Q.cleanest_stints(rows, 1))
    return rounded(picked.select(*Q.STINT_KEYS, "tire_age_laps", "lap_time_s", "lap_time_delta_s", "is_valid_lap"))


# --- polynomial models --------------------------------------------------------------------


@query("m1_linear_fit", f"SELECT tire_compound, is_pooled, n_rows, {r('b0')}, {r('b1')} FROM lin")
def m1(spark, d):
    train, _ = splits.split_chronological(lap_rows(spark, d))
    return rounded(M.polynomial_coefficients(train, 1))


@query("m2_quadratic_fit", f"SELECT tire_compound, is_pooled, n_rows, {r('b0')}, {r('b1')}, {r('b2')} FROM quad")
def m2(spark, d):
    train, _ = splits.split_chronological(lap_rows(spark, d))
    return rounded(M.polynomial_coefficients(train, 2))


@query("m3_j7_linear_prediction", f"SELECT {SES}, driver AS driver_code, lap_number, {r('predicted')}, has_own_fit FROM lin_te")
def m3(spark, d):
    train, test = lap_split(spark, d)
    return rounded(M.predict_polynomial(M.fit_polynomial(train), test).select(*LAP_KEYS, "predicted", "has_own_fit"))


@query("m3_quadratic_prediction", f"SELECT {SES}, driver AS driver_code, lap_number, {r('predicted')} FROM quad_te")
def m3q(spark, d):
    train, test = lap_split(spark, d)
    return rounded(M.predict_polynomial(M.fit_polynomial(train, 2), test).select(*LAP_KEYS, "predicted"))


@query("m4_rate_table", f"SELECT tire_compound, {r('b1', 'rate_s_per_lap')} FROM lin WHERE NOT is_pooled")
def m4(spark, d):
    train, _ = splits.split_chronological(lap_rows(spark, d))
    fit = M.fit_polynomial(train)
    return rounded(fit.coefficients().select("tire_compound", F.col("b1").alias("rate_s_per_lap")))


@query("a15_metrics", f"SELECT {METRICS} FROM lin_te WHERE is_valid_lap")
def a15(spark, d):
    train, test = lap_split(spark, d)
    return rounded(E.metrics(M.predict_polynomial(M.fit_polynomial(train), E.valid_rows(test))))


@query("a16_metrics_by_compound", f"SELECT tire_compound, {METRICS} FROM lin_te WHERE is_valid_lap GROUP BY tire_compound")
def a16(spark, d):
    train, test = lap_split(spark, d)
    return rounded(E.metrics(M.predict_polynomial(M.fit_polynomial(train), E.valid_rows(test)), ["tire_compound"]))


@query("m20_j8_compound_mean", f"""
SELECT {METRICS} FROM (SELECT t.*, m.predicted FROM lte t LEFT JOIN (SELECT tire_compound, avg(lap_time_delta_s) AS predicted FROM ltr
 WHERE is_valid_lap AND lap_time_delta_s IS NOT NULL GROUP BY 1) m ON t.tire_compound = m.tire_compound) WHERE is_valid_lap""")
def m20(spark, d):
    train, test = lap_split(spark, d)
    return rounded(E.metrics(M.predict_compound_mean(train, E.valid_rows(test))))


@query("m21_fit_per_round", f"""
SELECT season, round_number, stint_compound AS tire_compound, count(*) AS n_rows, {r('regr_intercept(lap_time_delta_s, CAST(tyre_life AS DOUBLE))', 'b0')},
 {r('regr_slope(lap_time_delta_s, CAST(tyre_life AS DOUBLE))', 'b1')}, coalesce(count(*) >= 2 AND regr_slope(lap_time_delta_s, CAST(tyre_life AS DOUBLE)) IS NOT NULL, false) AS is_fitted
FROM tlaps WHERE is_valid_lap AND lap_time_delta_s IS NOT NULL GROUP BY 1, 2, 3""")
def m21(spark, d):
    return rounded(M.fit_per_group(lap_rows(spark, d), ["season", "round_number"]))


@query("m22_valid_against_all", f"SELECT is_valid_lap, {METRICS} FROM lin_te GROUP BY is_valid_lap UNION ALL SELECT NULL, {METRICS} FROM lin_te")
def m22(spark, d):
    train, test = lap_split(spark, d)
    scored = M.predict_polynomial(M.fit_polynomial(train), test)
    both = E.metrics(scored, ["is_valid_lap"])
    return rounded(both.unionByName(E.metrics(scored).withColumn("is_valid_lap", F.lit(None).cast("boolean"))))


@query("m23_model_comparison", f"""
SELECT 'linear' AS model, {METRICS} FROM lin_te WHERE is_valid_lap UNION ALL SELECT 'quadratic', {METRICS} FROM quad_te WHERE is_valid_lap""")
def m23(spark, d):
    train, test = lap_split(spark, d)
    valid = E.valid_rows(test)
    scored = {
        "linear": M.predict_polynomial(M.fit_polynomial(train, 1), valid),
        "quadratic": M.predict_polynomial(M.fit_polynomial(train, 2), valid),
    }
    return rounded(E.comparison(scored))


@query("m24_fitted_curve", f"""
SELECT s.tire_compound, CAST(i AS INT) AS i, {r('lo + (hi - lo) * i / 49.0e0', 'tire_age_laps')},
 {r('coalesce(o.b0, g.b0) + coalesce(o.b1, g.b1) * (lo + (hi - lo) * i / 49.0e0)', 'predicted')}
FROM (SELECT tire_compound, min(tire_age_laps) * 1.0e0 AS lo, max(tire_age_laps) * 1.0e0 AS hi FROM ltrain GROUP BY 1) s, generate_series(0, 49) AS x(i)
LEFT JOIN (SELECT * FROM lin WHERE NOT is_pooled) o ON s.tire_compound = o.tire_compound CROSS JOIN (SELECT * FROM lin WHERE is_pooled) g""")
def m24(spark, d):
    train, _ = lap_split(spark, d)
    curve = M.fitted_curve(M.fit_polynomial(train), train)
    return rounded(curve.select("tire_compound", "i", "tire_age_laps", "predicted"))


@query("m25_residual_rows", f"""
SELECT {SES}, driver AS driver_code, lap_number, {r('lap_time_delta_s - predicted', 'residual')} FROM lin_te
WHERE is_valid_lap AND lap_time_delta_s IS NOT NULL AND predicted IS NOT NULL""")
def m25(spark, d):
    train, test = lap_split(spark, d)
    scored = M.predict_polynomial(M.fit_polynomial(train), E.valid_rows(test))
    return rounded(E.with_residual(scored).select(*LAP_KEYS, "residual"))


# --- circuit-aware and ridge --------------------------------------------------------------

_COEF = ", ".join(r(f"b{i}", n) for i, n in enumerate(M.NAMES))


@query("m5_gram_sums", "SELECT tire_compound, is_pooled, n_rows, n_circuits, " + ", ".join(
    r(f"a_{i}_{j}", f"g_{i}_{j}", 4) for i in range(6) for j in range(i, 6)) + ", " + ", ".join(
    r(f"a_{i}_6", f"h_{i}", 4) for i in range(6)) + " FROM ols_g")
def m5_gram(spark, d):
    train, _ = condition_split(spark, d)
    stats = M.feature_stats(M.circuit_training(train), M.CIRCUIT_FEATURES)
    return rounded(M.circuit_gram(train, stats, scaled_age=False), 4)


@query("m5_m11_circuit_aware_fit", f"SELECT tire_compound, {_COEF} FROM ols WHERE NOT is_pooled")
def m5(spark, d):
    train, _ = condition_split(spark, d)
    return rounded(M.fit_circuit_aware(train).fit.coefficients())


@query("m6_m8_p9_circuit_prediction", f"SELECT {KEYS}, {r('predicted')}, has_own_fit FROM ols_te")
def m6(spark, d):
    train, test = condition_split(spark, d)
    scored = M.predict_circuit(M.fit_circuit_aware(train), test)
    return rounded(scored.select(*LAP_KEYS, "predicted", "has_own_fit"))


@query("m7_extrapolation_flag", f"SELECT {KEYS}, is_extrapolating FROM te_flag")
def m7(spark, d):
    train, test = condition_split(spark, d)
    model = M.fit_circuit_aware(train)
    return test.select(*LAP_KEYS, M.is_extrapolating(model).alias("is_extrapolating"))


@query("m7_extrapolation_summary", " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {r(f'max({a}_lo)', 'train_lo')}, {r(f'max({a}_hi)', 'train_hi')}, count(*) FILTER (WHERE {f} < {a}_lo OR {f} > {a}_hi) AS n_outside,
 {r(f'min({f}) FILTER (WHERE {f} < {a}_lo OR {f} > {a}_hi)', 'outside_lo')}, {r(f'max({f}) FILTER (WHERE {f} < {a}_lo OR {f} > {a}_hi)', 'outside_hi')} FROM te CROSS JOIN cstats"""
    for f, a in (("avg_corner_speed_kph", "speed"), ("track_temp_c", "temp"))))
def m7_summary(spark, d):
    train, test = condition_split(spark, d)
    return rounded(M.extrapolation_summary(M.fit_circuit_aware(train), test))


@query("m9_effective_rate", f"""
SELECT t.season, t.round_number, t.session_name, t.driver_code, t.lap_number,
 {r('coalesce(o.b1, g.b1) + coalesce(o.b2, g.b2) * (t.avg_corner_speed_kph - s.speed_mean) / s.speed_std + coalesce(o.b3, g.b3) * (t.track_temp_c - s.temp_mean) / s.temp_std', 'rate_s_per_lap')}
FROM te t CROSS JOIN cstats s LEFT JOIN (SELECT * FROM ols WHERE NOT is_pooled) o ON t.tire_compound = o.tire_compound CROSS JOIN (SELECT * FROM ols WHERE is_pooled) g""")
def m9(spark, d):
    train, test = condition_split(spark, d)
    return rounded(M.effective_rate(M.fit_circuit_aware(train), test).select(*LAP_KEYS, "rate_s_per_lap"))


@query("m9_ridge_effective_rate", f"""
SELECT t.season, t.round_number, t.session_name, t.driver_code, t.lap_number,
 {r('(coalesce(o.b1, g.b1) + coalesce(o.b2, g.b2) * (t.avg_corner_speed_kph - s.speed_mean) / s.speed_std + coalesce(o.b3, g.b3) * (t.track_temp_c - s.temp_mean) / s.temp_std) / s.age_std', 'rate_s_per_lap')}
FROM te t CROSS JOIN cstats s LEFT JOIN (SELECT * FROM rid WHERE NOT is_pooled AND alpha = 1.0e0) o ON t.tire_compound = o.tire_compound
CROSS JOIN (SELECT * FROM rid WHERE is_pooled AND alpha = 1.0e0) g""")
def m9_ridge(spark, d):
    train, test = condition_split(spark, d)
    return rounded(M.effective_rate(M.fit_ridge(train, 1.0), test).select(*LAP_KEYS, "rate_s_per_lap"))


@query("m10_m11_ridge_fit", f"SELECT tire_compound, {_COEF} FROM rid WHERE NOT is_pooled AND alpha = 5.0e0")
def m10(spark, d):
    train, _ = condition_split(spark, d)
    return rounded(M.fit_ridge(train, 5.0).fit.coefficients())


@query("m12_ridge_sweep", f"SELECT alpha, {METRICS} FROM rid_in GROUP BY alpha")
def m12(spark, d):
    train, test = condition_split(spark, d)
    ols = M.fit_circuit_aware(train)
    in_range = E.valid_rows(test).filter(~M.is_extrapolating(ols))
    scored = M.predict_ridge_sweep(M.fit_circuit_models(train, ALPHAS), in_range)
    return rounded(E.metrics(scored, ["alpha"]))


_ONE = """SELECT *, 1.0e0 AS x0, CAST(tire_age_laps AS DOUBLE) AS x1, tire_age_laps * z2 AS x2, z2 AS x3 FROM (
 SELECT t.*, (t.track_temp_c - s.temp_mean) / s.temp_std AS z2 FROM ctrain t CROSS JOIN cstats s)"""


def _single_sql() -> str:
    from catalog.sql import CTES, eliminate

    CTES["one_x"] = _ONE
    CTES["one_g"] = gram("one_x", 4, "tire_compound")
    eliminate("one", "one_g", 4)
    CTES["one_age"] = "SELECT tire_compound, avg(tire_age_laps) AS m, stddev_pop(tire_age_laps) AS w FROM ctrain GROUP BY 1"
    return f"""SELECT tire_compound, n_rows, {r('b0 + b1 * m', 'intercept')}, {r('b1 * w', 'age_std')}, {r('b2 * w', 'age_std_x_f')}, {r('b3 + b2 * m', 'f_std')}
FROM one JOIN one_age USING (tire_compound) WHERE n_rows >= 30 AND n_circuits >= 5"""


@query("m19_single_feature_fit", _single_sql())
def m19(spark, d):
    train, _ = condition_split(spark, d)
    fit = M.fit_single_feature(train, "track_temp_c")
    return rounded(fit.select("tire_compound", "n_rows", "intercept", "age_std", "age_std_x_f", "f_std"))


@query("m19_single_feature_metrics", f"""
SELECT {METRICS} FROM (SELECT t.*, o.b0 + o.b1 * t.tire_age_laps + o.b2 * t.tire_age_laps * (t.track_temp_c - s.temp_mean) / s.temp_std
   + o.b3 * (t.track_temp_c - s.temp_mean) / s.temp_std AS predicted
 FROM in_range t CROSS JOIN cstats s LEFT JOIN (SELECT * FROM one WHERE n_rows >= 30 AND n_circuits >= 5) o ON t.tire_compound = o.tire_compound)""")
def m19_metrics(spark, d):
    train, test = condition_split(spark, d)
    in_range = E.valid_rows(test).filter(~M.is_extrapolating(M.fit_circuit_aware(train)))
    return rounded(E.metrics(M.predict_single_feature(M.fit_single_feature(train, "track_temp_c"), "track_temp_c", in_range)))


@query("d11_metrics_by_range", f"""
SELECT is_extrapolating, {METRICS} FROM (SELECT o.*, f.is_extrapolating FROM ols_te o JOIN te_flag f USING ({KEYS})) WHERE is_valid_lap GROUP BY is_extrapolating""")
def d11(spark, d):
    train, test = condition_split(spark, d)
    model = M.fit_circuit_aware(train)
    scored = M.predict_circuit(model, E.valid_rows(test)).withColumn("is_extrapolating", M.is_extrapolating(model))
    return rounded(E.metrics(scored, ["is_extrapolating"]))


@query("f8_one_hot", f"""
SELECT {SES}, driver AS driver_code, lap_number, {', '.join(f"CASE WHEN tire_compound = '{c}' THEN 1.0e0 ELSE 0.0e0 END AS is_{c.lower()}" for c in ('HARD', 'MEDIUM', 'SOFT', 'UNKNOWN'))} FROM lte""")
def f8(spark, d):
    train, test = lap_split(spark, d)
    return Q.one_hot(train, test, "tire_compound").select(*LAP_KEYS, "is_hard", "is_medium", "is_soft", "is_unknown")


# --- forest -------------------------------------------------------------------------------

# The combinations the sweep tries.
GRID = {"trees": [200, 400], "depth": [4, 6, 8, 10, 12], "min_leaf": [5, 10, 20]}


def forest(spark, d, train: DataFrame | None = None) -> RF.ForestModel:
    """The forest of the training races, fitted once and read back from where it is stored.
    `train`: those races' rows, where the caller has them."""
    rows = lambda: condition_split(spark, d)[0] if train is None else train
    path = stored_once(spark, d, "forest", lambda: RF.fit_forest(rows()), RF.save)
    return RF.load(spark, path)


@query("m13_m14_forest_prediction")
def m13(spark, d):
    train, test = condition_split(spark, d)
    model = forest(spark, d, train)
    return rounded(RF.predict_forest(model, test).select(*LAP_KEYS, "predicted"))


@query("m14_forest_metrics")
def m14(spark, d):
    train, test = condition_split(spark, d)
    model = forest(spark, d, train)
    return rounded(E.metrics(RF.predict_forest(model, E.valid_rows(test))))


@query("m15_leaf_support")
def m15(spark, d):
    train, test = condition_split(spark, d)
    model = forest(spark, d, train)
    return rounded(RF.leaf_support(model, test, LAP_KEYS))


@query("m16_t7_forest_importances")
def m16(spark, d):
    return rounded(RF.importances(forest(spark, d)))


@query("m17_t6_forest_sweep")
def m17(spark, d):
    train, test = condition_split(spark, d)
    tune, validation = splits.split_chronological(train)
    best = RF.best(RF.tune(tune, E.valid_rows(validation), GRID))
    scored = RF.predict_forest(RF.fit_forest(train, best), E.valid_rows(test))
    chosen = {"trees": best.trees, "depth": best.depth, "min_leaf": best.min_leaf}
    return rounded(E.metrics(scored).withColumns({k: F.lit(v) for k, v in chosen.items()}))


# The inputs that describe the driver, and the depths tried with them.
DRIVER_INPUTS = ("avg_braking_decel_ms2", "peak_braking_decel_ms2", "avg_throttle_pct", "driver_consistency_std_s")
DRIVER_DEPTHS = (8, 10, 12)


def driver_trials() -> list[tuple[bool, RF.ForestSpec]]:
    base = RF.ForestSpec(trees=200)
    wide = replace(base, continuous=RF.CONTINUOUS + DRIVER_INPUTS)
    return [(False, base), *[(True, replace(wide, depth=n)) for n in DRIVER_DEPTHS]]


@query("m17_driver_features")
def m17_driver(spark, d):
    """Validation metrics without the driver's inputs, and with them at each depth; trials that
    differ by depth alone share a fit."""
    train, _ = record_split(spark, d)
    tune, validation = splits.split_chronological(train)
    shared = {}
    for wide, spec in driver_trials():
        shared.setdefault((wide, replace(spec, depth=None)), []).append(spec.depth)
    found = RF.side_by_side([lambda spec=spec, depths=depths: RF.depth_metrics(tune, E.valid_rows(validation), depths, spec) for (_, spec), depths in shared.items()])
    out = None
    for (wide, _), one in zip(shared, found):
        one = one.withColumn("driver_features", F.lit(wide))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("mae", "rmse", "r2", "n_samples", "n_dropped", "driver_features", "depth", "n_training"))


@query("m18_row_folds_against_race_folds")
def m18(spark, d):
    rows = settle(condition_rows(spark, d))
    r2 = RF.fold_r2(rows, {"race": SESSION, "lap": LAP_KEYS}, 3)
    named = F.array(*[F.struct(F.lit(k).alias("fold_by"), F.lit(float(v)).alias("r2")) for k, v in r2.items()])
    return rounded(rows.agg(F.count("*").alias("n_rows")).withColumn("f", F.explode(named)).select("n_rows", "f.*"))
