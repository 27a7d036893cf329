"""Stint-life requests, default conditions, reports, and the stored dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.models import condition_rows, forest, lap_split, record_rows
from catalog.registry import query, rounded, stored_once, tables
from catalog.sql import DEF_NUM, SES, crossing, r
from stintwise.operators import forest as RF
from stintwise.operators import life
from stintwise.operators import linear as M
from stintwise.operators import splits
from stintwise.operators.lookup import scratch_path as scratch
from stintwise.operators.lookup import settle
from stintwise.plans import lap_record as R
from stintwise.plans import report as P
from stintwise.schema import SESSION
from stintwise.sources import dataset as DS
from stintwise.sources import driver_tables as D

REQUEST = ["request_id", "tire_compound"]


def requests(spark, d) -> DataFrame:
    """One request per supplier; some ask for circuits that do not exist."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return D.table(spark, d, "supplier").select(
        key.alias("request_id"),
        F.concat(F.lit("C"), (key % 12).cast("string")).alias("circuit"),
        (F.lit(20.0) + nation * F.lit(0.8)).alias("track_temp_c"),
        (F.lit(0.25) + (key % 7) * F.lit(0.25)).alias("threshold_s"),
        (nation % 2 == 0).alias("wet"),
        F.when(key % 3 == 0, F.lit(150.0) + nation * F.lit(4.0)).alias("avg_corner_speed_kph"),
    )


def defaults(rows: DataFrame) -> DataFrame:
    return P.default_table(rows, list(DEF_NUM), ["is_raining"])


# --- requests and defaults ----------------------------------------------------------------


@query("j10_requests_by_compound_and_age", """
SELECT tire_compound, tire_age_laps, count(*) AS n_requests, round(sum(threshold_s), 6) + 0.0e0 AS sum_threshold
FROM requests CROSS JOIN compound_list CROSS JOIN (SELECT i * 1.0e0 AS tire_age_laps FROM generate_series(1, 60) g(i)) GROUP BY 1, 2""")
def j10(spark, d):
    swept = life.sweep(P.per_compound(requests(spark, d)), REQUEST, life.whole_lap_ages())
    return rounded(
        swept.groupBy("tire_compound", "tire_age_laps").agg(
            F.count("*").alias("n_requests"), F.sum("threshold_s").alias("sum_threshold")
        )
    )


# Nine digits: the mean of eight values of four digits ends in a 5 at the seventh.
@query("a26_default_covariates", f"SELECT circuit, tire_compound, level, n_rows, {', '.join(r(c, c, 9) for c in DEF_NUM)}, is_raining FROM deflt")
def a26(spark, d):
    return rounded(defaults(condition_rows(spark, d)), 9)


@query("j9_defaults_for_requests", f"SELECT request_id, tire_compound, {r('avg_corner_speed_kph')}, {r('air_temp_c')}, is_raining FROM asked")
def j9(spark, d):
    asked = P.with_defaults(
        P.per_compound(requests(spark, d)), defaults(condition_rows(spark, d)),
        ["avg_corner_speed_kph", "air_temp_c", "is_raining"],
    )
    return rounded(asked.select(*REQUEST, "avg_corner_speed_kph", "air_temp_c", "is_raining"))


@query("io9_export_lookups", f"""
SELECT d.circuit, d.tire_compound, {r('d.avg_corner_speed_kph', 'avg_corner_speed_kph')}, m.max_age_laps
FROM deflt d JOIN (SELECT circuit, max(tire_age_laps) AS max_age_laps FROM cond GROUP BY circuit) m ON d.circuit = m.circuit WHERE level = 'pair'""")
def io9(spark, d):
    rows = settle(condition_rows(spark, d))
    path = scratch(spark)
    DS.export_lookups(rows, defaults(rows), path)
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("circuits", "defaults", "max_age")}
    pairs = read["defaults"].filter(F.col("level") == "pair")
    out = pairs.join(read["circuits"], "circuit").join(read["max_age"], "circuit")
    return rounded(out.select("circuit", "tire_compound", "avg_corner_speed_kph", "max_age_laps"))


_EXPORTED = ("track_temp_c", "air_temp_c", "avg_braking_decel_ms2", "peak_braking_decel_ms2", "avg_throttle_pct")


@query("io9_export_model", f"""
SELECT c.circuit, c.tire_compound, c.n_rows, {', '.join(r(f'c.{x}', x) for x in _EXPORTED)}, c.is_raining, m.max_age_laps, 200 AS trees
FROM (SELECT circuit, tire_compound, count(*) AS n_rows, {', '.join(f'avg({x}) AS {x}' for x in _EXPORTED)},
       sum(CASE WHEN is_raining THEN 1 WHEN NOT is_raining THEN -1 END) > 0 AS is_raining FROM rec GROUP BY 1, 2) c
JOIN (SELECT circuit, max(tire_age_laps) AS max_age_laps FROM rec GROUP BY circuit) m ON c.circuit = m.circuit""")
def io9_model(spark, d):
    """What scoring jobs read back from the export: the model's size, and its lookups."""
    e = exported(spark, d)
    pairs = e.defaults.filter(F.col("level") == "pair").join(e.circuits, "circuit").join(e.max_age, "circuit")
    return rounded(pairs.select("circuit", "tire_compound", "n_rows", *_EXPORTED, "is_raining", "max_age_laps", F.lit(sum(p.trees for p in e.model.parts)).alias("trees")))


# --- life ---------------------------------------------------------------------------------

_LIN_SWEPT = """(SELECT q.*, coalesce(o.b0, g.b0) + coalesce(o.b1, g.b1) * q.tire_age_laps AS predicted
 FROM (SELECT * FROM requests CROSS JOIN compound_list CROSS JOIN {ages}) q
 LEFT JOIN (SELECT * FROM lin WHERE NOT is_pooled) o ON q.tire_compound = o.tire_compound CROSS JOIN (SELECT * FROM lin WHERE is_pooled) g)"""
_HALF = _LIN_SWEPT.format(ages="half_ages")
_WHOLE = _LIN_SWEPT.format(ages="(SELECT i * 1.0e0 AS tire_age_laps FROM generate_series(1, 60) w(i))")


@query("w12_d6_d7_threshold_crossing", f"""
SELECT request_id, tire_compound, {r('life_laps')}, starts_above FROM ({crossing(_HALF, 'request_id, tire_compound')})""")
def w12(spark, d):
    train, _ = lap_split(spark, d)
    fit = M.fit_polynomial(train)
    asked = P.per_compound(requests(spark, d))
    lives = life.estimate_life(asked, REQUEST, lambda q: M.predict_polynomial(fit, q), F.col("threshold_s"))
    return rounded(lives)


@query("w13_first_age_at_threshold", f"""
SELECT request_id, tire_compound, min(tire_age_laps) FILTER (WHERE round(predicted, 3) >= threshold_s) AS life_laps,
 min(tire_age_laps) FILTER (WHERE round(predicted, 3) >= threshold_s) IS NULL AS durable FROM {_WHOLE} GROUP BY 1, 2""")
def w13(spark, d):
    train, _ = lap_split(spark, d)
    fit = M.fit_polynomial(train)
    swept = life.sweep(P.per_compound(requests(spark, d)), REQUEST, life.whole_lap_ages())
    return life.first_age_at(M.predict_polynomial(fit, swept), REQUEST, F.col("threshold_s"))


@query("f9_rounded_delta", f"SELECT request_id, tire_compound, tire_age_laps, round(predicted, 3) + 0.0e0 AS delta_s FROM {_WHOLE}")
def f9(spark, d):
    train, _ = lap_split(spark, d)
    swept = life.sweep(P.per_compound(requests(spark, d)), REQUEST, life.whole_lap_ages())
    scored = M.predict_polynomial(M.fit_polynomial(train), swept)
    return scored.select(*REQUEST, "tire_age_laps", (F.round("predicted", 3) + 0.0).alias("delta_s"))


def _circuit_report(spark, d) -> DataFrame:
    rows = settle(condition_rows(spark, d))
    train, _ = splits.split_chronological(rows)
    return P.circuit_report(M.fit_circuit_aware(train), requests(spark, d), defaults(rows))


@query("d8_strategy_report", f"""
SELECT request_id, compound, circuit, {r('life_laps')}, {r('rate_s_per_lap')}, starts_above, used_global_fallback, is_extrapolating FROM report""")
def d8(spark, d):
    return rounded(
        _circuit_report(spark, d).select(
            "request_id", "compound", "circuit", "life_laps", "rate_s_per_lap", "starts_above",
            "used_global_fallback", "is_extrapolating",
        )
    )


@query("t4_best_compound", f"""
SELECT request_id, arg_max(compound, (life_laps, -pos)) FILTER (WHERE life_laps IS NOT NULL) AS best_compound, {r('max(life_laps)', 'best_life_laps')}
FROM report GROUP BY request_id""")
def t4(spark, d):
    return rounded(life.best_compound(_circuit_report(spark, d), ["request_id"]))


@query("t5_compound_ranking", """
SELECT request_id, compound, row_number() OVER (PARTITION BY request_id ORDER BY life_laps DESC NULLS LAST, pos) AS rank FROM report""")
def t5(spark, d):
    ranked = life.ranked(_circuit_report(spark, d), ["request_id"])
    return ranked.select("request_id", "compound", F.col("rank").cast("long").alias("rank"))


# --- forest answers -----------------------------------------------------------------------


# The exported model: no fuel load, the driver's braking and throttle, fitted on every race.
EXPORT = RF.ForestSpec(continuous=RF.EXPORT_CONTINUOUS, trees=200, depth=10)


def exported(spark, d) -> P.Exported:
    """The exported model, read back: made once, then only loaded."""

    def fit():
        rows = settle(record_rows(spark, d))
        return RF.fit_forest(rows, EXPORT), rows

    path = stored_once(spark, d, "export", fit, lambda made, path: P.export_model(*made, path))
    return P.load_export(spark, path)


@query("d9_wear_curves")
def d9(spark, d):
    e = exported(spark, d)
    curves = P.beyond_observed(P.wear_curves(e.model, requests(spark, d), e.defaults), e.max_age)
    return rounded(curves.select(*REQUEST, "tire_age_laps", "delta_s", "low_support", "beyond_observed_age"))


@query("d9_curve_summary")
def d9_summary(spark, d):
    e = exported(spark, d)
    return rounded(P.curve_summary(P.wear_curves(e.model, requests(spark, d), e.defaults)))


@query("d9_rejected_requests", "SELECT request_id, circuit FROM requests WHERE circuit NOT IN (SELECT circuit FROM slaps)")
def d9_rejected(spark, d):
    _, rejected = P.split_known(requests(spark, d), defaults(condition_rows(spark, d)))
    return rejected.select("request_id", "circuit")


@query("d8_forest_report")
def d8_forest(spark, d):
    model = forest(spark, d)
    report = P.forest_report(model, requests(spark, d), defaults(condition_rows(spark, d)))
    return rounded(report.select("request_id", "compound", "circuit", "life_laps", "starts_above", "avg_leaf_rows", "is_extrapolating"))


@query("d10_report_inputs")
def d10(spark, d):
    e = exported(spark, d)
    known, _ = P.split_known(requests(spark, d), e.defaults)
    out = P.predictions_at(e.model, known, e.defaults, [1, 5, 10, 15, 20, 30, 40, 50, 60])
    return rounded(out.select(*REQUEST, "tire_age_laps", "air_temp_c", "is_raining", "predicted"))


# --- the stored dataset -------------------------------------------------------------------

# Columns of the record that come from a lap's own telemetry.
_OWN = ("avg_speed_kph", "avg_throttle_pct", "avg_braking_decel_ms2", "apex_speed_kph")
_STORED = f"""SELECT season, round_number, session_name, count(*) AS n_rows, count(*) FILTER (WHERE is_valid_lap) AS n_valid,
 {r('sum(lap_time_s)', 'sum_lap_time_s', 4)}, {', '.join(f"count({c}) AS n_{c}, {r(f'sum({c})', f'sum_{c}', 4)}" for c in _OWN)} FROM rec GROUP BY {SES}"""


def _stored_counts(df: DataFrame) -> DataFrame:
    own = [x for c in _OWN for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"sum_{c}"))]
    return rounded(
        df.groupBy(*SESSION).agg(
            F.count("*").alias("n_rows"), F.count_if("is_valid_lap").alias("n_valid"),
            F.sum("lap_time_s").alias("sum_lap_time_s"), *own,
        ),
        4,
    )


def _stored(spark, d) -> str:
    path = scratch(spark)
    DS.write_sessions(R.lap_records(tables(spark, d)), f"{path}/laps")
    return f"{path}/laps"


@query("io2_load_dataset", _STORED)
def io2(spark, d):
    return _stored_counts(DS.load_dataset(spark, _stored(spark, d)))


@query("io1_load_session", f"SELECT * FROM ({_STORED}) WHERE season = 2023 AND round_number = 2")
def io1(spark, d):
    return _stored_counts(DS.load_session(spark, _stored(spark, d), 2023, 2, "R"))


@query("io3_rewrite_one_season", _STORED)
def io3(spark, d):
    """Writing one season again leaves the other in place and doubles nothing."""
    rows = settle(R.lap_records(tables(spark, d)))
    path = scratch(spark)
    DS.write_sessions(rows, path)
    DS.write_sessions(rows.filter(F.col("season") == 2024), path)
    return _stored_counts(DS.load_dataset(spark, path))


@query("io5_incremental_build", f"SELECT season, round_number, session_name FROM ({_STORED})")
def io5_build(spark, d):
    """Two runs: one season first, then everything pending; the manifest ends up complete."""
    t = tables(spark, d)
    path = scratch(spark)

    def build(sessions):
        return R.lap_records(R.of_sessions(t, sessions))

    everything = splits.race_keys(t.laps)
    DS.build_pending(everything.filter(F.col("season") == 2023), build, f"{path}/laps", f"{path}/manifest")
    DS.build_pending(everything, build, f"{path}/laps", f"{path}/manifest")
    return DS.load_manifest(spark, f"{path}/manifest")
