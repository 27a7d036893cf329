"""SQL side of the catalogue: the same views and steps as common table expressions."""

from __future__ import annotations

import re

SES = "season, round_number, session_name"
STINT = f"{SES}, driver, stint"
TEL = "driver, lap_number"


def _on(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id, event_type, value, epoch_us(ts) AS us, CAST(user_id % 20 AS INT) AS d,
       CAST(floor((day(ts) - 1) / 3.0e0) AS INT) AS r, ts FROM events"""

CTES["numbered"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY r, d ORDER BY us, event_id) AS INT) AS lap_number FROM ev"""

CTES["placed"] = """
SELECT *, CAST(floor((lap_number - 1) / 8.0e0) AS INT) + 1 AS stint, (lap_number - 1) % 8 + 1 AS pos FROM numbered"""

CTES["laps"] = """
SELECT CASE WHEN r >= 5 THEN 2024 ELSE 2023 END AS season, r % 5 + 1 AS round_number, 'R' AS session_name,
       concat('C', CAST(r AS VARCHAR)) AS circuit, concat('D', CAST(d AS VARCHAR)) AS driver, lap_number, stint,
       CASE WHEN d = 13 AND r = 2 AND lap_number = 2 THEN 'HARD'
            WHEN r = 9 AND d % 5 = 0 THEN 'INTERMEDIATE'
            WHEN d = 7 AND stint = 1 THEN NULL
            WHEN (d + stint + r) % 3 = 0 THEN 'SOFT' WHEN (d + stint + r) % 3 = 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound,
       pos + d % 3 AS tyre_life,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE 85.0e0 + value * 0.05e0 + pos * 0.08e0 END AS lap_time_s,
       CASE WHEN pos = 8 THEN us END AS pit_in_time,
       CASE WHEN pos = 1 AND stint > 1 THEN us END AS pit_out_time,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '14' WHEN event_type = 'signup' THEN '12' ELSE '1' END AS track_status,
       CASE WHEN event_id % 37 = 0 THEN true WHEN event_id % 53 = 0 THEN NULL ELSE false END AS deleted,
       us AS lap_end_us,
       concat('S', CAST(r + 10 * (d % 10) AS VARCHAR)) AS tel_driver, lap_number % 8 + 1 AS tel_lap
FROM placed"""

CTES["weather"] = """
SELECT CASE WHEN r >= 5 THEN 2024 ELSE 2023 END AS season, r % 5 + 1 AS round_number, 'R' AS session_name,
       us AS w_us, event_id AS w_seq, 15.0e0 + event_id % 20 AS air_temp,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE 25.0e0 + value * 0.05e0 END AS track_temp,
       event_id % 10 = 0 AS rainfall
FROM ev WHERE event_type = 'view'"""

CTES["telemetry"] = """
SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS driver, CAST(year(l_shipdate) - 1994 AS INT) AS lap_number,
       concat('C', CAST(l_suppkey % 10 AS VARCHAR)) AS circuit,
       (dayofyear(l_shipdate) - 1) * 0.25e0 AS time_s, l_orderkey * 8 + l_linenumber AS seq,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity * 8.0e0 END AS speed,
       l_discount * 1000.0e0 AS throttle, CASE WHEN l_returnflag = 'R' THEN 100.0e0 ELSE 0.0e0 END AS brake,
       CAST(l_linenumber AS DOUBLE) AS n_gear,
       (dayofyear(l_shipdate) - 1) * 15.0e0 - CASE WHEN l_partkey % 23 = 0 THEN 20.0e0 ELSE 0.0e0 END AS distance,
       CASE WHEN l_linestatus = 'O' THEN 12 ELSE 1 END AS drs FROM lineitem"""

CTES["corners"] = """
SELECT concat('C', CAST(n_nationkey AS VARCHAR)) AS circuit, CAST(g.i AS INT) AS number,
       g.i * 900.0e0 + n_nationkey * 31.0e0 AS distance FROM nation, generate_series(1, 5) AS g(i)"""

# --- laps ---------------------------------------------------------------------------------

PIT = "(pit_in_time IS NOT NULL OR pit_out_time IS NOT NULL)"
CAUTION = "coalesce(regexp_matches(track_status, '[4-7]'), false)"
DELETED = "coalesce(deleted, false)"
START = "coalesce(lap_number = 1, false)"

CTES["stint_raw"] = f"""
SELECT {STINT}, count(*) AS stint_laps, min(lap_number) AS first_lap, max(lap_number) AS last_lap,
       min(compound) AS lo, coalesce(min(compound) <> max(compound), false) AS is_mixed
FROM laps WHERE stint IS NOT NULL GROUP BY {STINT}"""

CTES["stints"] = f"""
SELECT *, stint < max(stint) OVER (PARTITION BY {SES}, driver) AS is_complete,
       bool_or(is_mixed) OVER (PARTITION BY {SES}, driver) AS driver_has_mixed,
       coalesce(lo, 'UNKNOWN') AS stint_compound FROM stint_raw"""

CTES["slaps"] = f"""
SELECT laps.*, s.stint_laps, s.is_complete, s.stint_compound
FROM laps JOIN stints s ON {_on('laps', 's', STINT)} WHERE NOT s.driver_has_mixed"""

CTES["refs"] = f"""
SELECT {STINT}, median(lap_time_s) FILTER (WHERE NOT {PIT} AND NOT {CAUTION}) AS reference_s FROM slaps GROUP BY {STINT}"""

CTES["vlaps"] = f"""
SELECT l.*, refs.reference_s,
       coalesce(NOT ({DELETED} OR {PIT} OR {CAUTION} OR {START} OR lap_time_s IS NULL
                     OR lap_time_s > refs.reference_s * 1.15e0), false) AS is_valid_lap
FROM slaps l JOIN refs ON {_on('l', 'refs', STINT)}"""

CTES["bases"] = f"""
SELECT {STINT}, arg_min(lap_time_s, lap_number) FILTER (WHERE is_valid_lap) AS baseline_s,
       stddev_samp(lap_time_s) FILTER (WHERE is_valid_lap) AS driver_consistency_std_s
FROM vlaps GROUP BY {STINT}"""

CTES["tlaps"] = f"""
SELECT v.*, b.baseline_s, b.driver_consistency_std_s, v.lap_time_s - b.baseline_s AS lap_time_delta_s,
       CASE WHEN is_complete THEN stint_laps - tyre_life END AS remaining_tire_life_laps,
       CASE WHEN is_complete THEN stint_laps END AS stint_length_laps
FROM vlaps v JOIN bases b ON {_on('v', 'b', STINT)}"""

# --- weather ------------------------------------------------------------------------------

CTES["near_pairs"] = f"""
SELECT l.season, l.round_number, l.session_name, l.driver, l.lap_number, w.w_us, w.w_seq, w.air_temp, w.track_temp, w.rainfall,
       row_number() OVER (PARTITION BY l.season, l.round_number, l.session_name, l.driver, l.lap_number
                          ORDER BY abs(w.w_us - l.lap_end_us), w.w_us, w.w_seq) AS rk
FROM laps l JOIN weather w ON {_on('l', 'w', SES)}"""

CTES["near"] = "SELECT * FROM near_pairs WHERE rk = 1"

CTES["wlaps"] = f"""
SELECT t.*, n.w_us, n.w_seq, n.air_temp AS air_temp_c, n.track_temp AS track_temp_c,
       CASE WHEN n.w_us IS NOT NULL THEN coalesce(n.rainfall, false) END AS is_raining,
       CASE WHEN n.w_us IS NULL THEN NULL WHEN n.rainfall THEN 'rain' ELSE 'dry' END AS weather
FROM tlaps t LEFT JOIN near n ON {_on('t', 'n', SES + ', driver, lap_number')}"""

# --- telemetry ----------------------------------------------------------------------------

CTES["deduped"] = f"""
SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY {TEL} ORDER BY time_s) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY {TEL}, time_s ORDER BY seq) AS k FROM telemetry) WHERE k = 1"""

_CH = ("speed", "throttle", "brake", "n_gear")
_UP = f"OVER (PARTITION BY {TEL} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DN = f"OVER (PARTITION BY {TEL} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
CTES["known"] = "SELECT *, " + ", ".join(
    f"last_value({c} IGNORE NULLS) {_UP} AS p_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {_UP} AS pr_{c}, "
    f"first_value({c} IGNORE NULLS) {_DN} AS n_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {_DN} AS nr_{c}"
    for c in _CH
) + " FROM deduped"

CTES["filled"] = f"SELECT {TEL}, circuit, time_s, seq, rn, distance, drs, " + ", ".join(
    f"coalesce({c}, CASE WHEN rn - pr_{c} <= 5 AND nr_{c} IS NOT NULL "
    f"THEN p_{c} + (n_{c} - p_{c}) * (CAST(rn - pr_{c} AS DOUBLE) / (nr_{c} - pr_{c})) END) AS {c}"
    for c in _CH
) + " FROM known"

CTES["cleaned"] = f"""
SELECT {TEL}, circuit, time_s, seq, rn, drs, throttle, brake, n_gear,
       CASE WHEN speed IS NOT NULL THEN greatest(least(speed, 380.0e0), 0.0e0) END AS speed,
       max(distance) OVER (PARTITION BY {TEL} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS distance
FROM filled"""

_LW = f"OVER (PARTITION BY {TEL} ORDER BY rn)"
CTES["pairs"] = f"""
SELECT *, coalesce(brake > 0, false) AS braking,
       CASE WHEN time_s - lag(time_s) {_LW} > 1e-6 THEN (speed / 3.6e0 - lag(speed) {_LW} / 3.6e0) / (time_s - lag(time_s) {_LW}) END AS accel,
       lead(speed) {_LW} AS to_speed, lead(distance) {_LW} AS to_distance,
       (drs IN (10, 12, 14)) AND NOT coalesce(lag(drs IN (10, 12, 14)) {_LW}, false) AS drs_opens,
       min(distance) OVER (PARTITION BY {TEL}) AS d_min, max(distance) OVER (PARTITION BY {TEL}) AS d_max
FROM cleaned"""

CTES["motion"] = f"""
SELECT {TEL}, avg(CASE WHEN braking THEN -accel END) AS avg_braking_decel_ms2, max(CASE WHEN braking THEN -accel END) AS peak_braking_decel_ms2,
       avg(throttle) AS avg_throttle_pct, max(accel) AS max_acceleration_ms2, avg(speed) AS avg_speed_kph, max(speed) AS max_speed_kph,
       CASE WHEN count(*) >= 2 THEN coalesce(sum(CASE WHEN braking AND to_speed < speed
            THEN 0.5e0 * 860.0e0 * ((speed / 3.6e0) * (speed / 3.6e0) - (to_speed / 3.6e0) * (to_speed / 3.6e0)) END), 0.0e0) / 1000.0e0 END AS brake_energy_estimate_kj,
       avg(abs(accel)) AS longitudinal_accel_ms2
FROM pairs GROUP BY {TEL}"""

# Grid points 2 m apart, only those near a corner; a point takes its value from the segment it lies in.
CTES["grid"] = f"""
SELECT p.driver, p.lap_number, c.number, c.distance AS corner, p.d_min, g.k,
       p.d_min + g.k * 2.0e0 AS x,
       CASE WHEN p.d_min + g.k * 2.0e0 = p.distance THEN p.speed
            ELSE p.speed + (p.to_speed - p.speed) * (p.d_min + g.k * 2.0e0 - p.distance) / (p.to_distance - p.distance) END AS v
FROM pairs p JOIN corners c ON p.circuit = c.circuit AND p.distance <= c.distance + 60 AND p.to_distance >= c.distance - 60
     AND p.to_distance > p.distance,
     generate_series(CAST(ceil((p.distance - p.d_min) / 2.0e0) AS BIGINT), CAST(ceil((p.to_distance - p.d_min) / 2.0e0) AS BIGINT) - 1) AS g(k)"""


def _between(offset: str) -> str:
    rel = f"((corner {offset} - d_min) / 2.0e0)"
    v0 = f"max(CASE WHEN k = floor({rel}) THEN v END)"
    v1 = f"max(CASE WHEN k = ceil({rel}) THEN v END)"
    share = f"max({rel} - floor({rel}))"
    return f"CASE WHEN {share} = 0 THEN {v0} ELSE {v0} + ({v1} - {v0}) * {share} END"


CTES["corner_windows"] = f"""
SELECT {TEL}, number, {_between('- 50.0e0')} AS entry_speed,
       min(CASE WHEN x BETWEEN corner - 15.0e0 AND corner + 15.0e0 THEN v END) AS apex_speed,
       {_between('+ 50.0e0')} AS exit_speed
FROM grid GROUP BY {TEL}, number"""

CTES["corner_means"] = f"""
SELECT {TEL}, avg(entry_speed) AS corner_entry_speed_kph, avg(apex_speed) AS apex_speed_kph, avg(exit_speed) AS corner_exit_speed_kph
FROM corner_windows GROUP BY {TEL}"""

CTES["at_corner"] = f"""
SELECT p.driver, p.lap_number, c.number,
       CASE WHEN c.distance = p.distance THEN p.speed
            ELSE p.speed + (p.to_speed - p.speed) * (c.distance - p.distance) / (p.to_distance - p.distance) END AS speed_at_corner
FROM pairs p JOIN corners c ON p.circuit = c.circuit
 AND ((p.distance <= c.distance AND c.distance < p.to_distance) OR (p.to_distance IS NULL AND c.distance = p.distance))"""

CTES["tel_track"] = f"""
SELECT z.driver AS tel_driver, z.lap_number AS tel_lap, z.num_drs_zones, a.avg_corner_speed_kph
FROM (SELECT {TEL}, CAST(count(*) FILTER (WHERE drs_opens) AS INT) AS num_drs_zones FROM pairs GROUP BY {TEL}) z
LEFT JOIN (SELECT {TEL}, avg(speed_at_corner) AS avg_corner_speed_kph FROM at_corner GROUP BY {TEL}) a
  ON z.driver = a.driver AND z.lap_number = a.lap_number"""

CTES["ref_laps"] = f"""
SELECT {SES}, circuit, driver AS ref_driver, lap_number AS ref_lap, tel_driver, tel_lap, lap_time_s AS ref_time_s FROM (
  SELECT *, row_number() OVER (PARTITION BY {SES} ORDER BY lap_time_s, driver, lap_number) AS k
  FROM laps WHERE NOT {DELETED} AND lap_time_s IS NOT NULL) WHERE k = 1"""

CTES["track"] = f"""
SELECT r.season, r.round_number, r.session_name, c.num_corners, t.avg_corner_speed_kph,
       t.avg_corner_speed_kph >= 200.0e0 AS is_high_speed_circuit, t.num_drs_zones
FROM ref_laps r LEFT JOIN tel_track t ON r.tel_driver = t.tel_driver AND r.tel_lap = t.tel_lap
LEFT JOIN (SELECT circuit, CAST(count(*) AS INT) AS num_corners FROM corners GROUP BY circuit) c ON r.circuit = c.circuit"""

# --- the record ---------------------------------------------------------------------------

CTES["cond"] = f"""
SELECT w.season, w.round_number, w.session_name, w.driver AS driver_code, w.lap_number, w.stint_compound AS tire_compound,
       w.tyre_life AS tire_age_laps, w.stint AS stint_number, CAST(w.stint_length_laps AS INT) AS stint_length_laps,
       w.driver_consistency_std_s, w.circuit, k.num_corners, k.avg_corner_speed_kph, k.is_high_speed_circuit, k.num_drs_zones,
       w.air_temp_c, w.track_temp_c, w.weather, w.is_raining, {PIT} AS is_pit_lap,
       greatest(100.0e0 - greatest(w.lap_number - 1, 0) * 1.6e0, 0.0e0) AS fuel_load_estimate_kg,
       {CAUTION} AS is_safety_car_lap, w.is_valid_lap, w.lap_time_s, w.lap_time_delta_s,
       CAST(w.remaining_tire_life_laps AS INT) AS remaining_tire_life_laps, w.tel_driver, w.tel_lap
FROM wlaps w LEFT JOIN track k ON {_on('w', 'k', SES)}"""

CTES["rec"] = """
SELECT c.* EXCLUDE (tel_driver, tel_lap), m.* EXCLUDE (driver, lap_number),
       q.corner_entry_speed_kph, q.apex_speed_kph, q.corner_exit_speed_kph
FROM cond c LEFT JOIN motion m ON c.tel_driver = m.driver AND c.tel_lap = m.lap_number
LEFT JOIN corner_means q ON c.tel_driver = q.driver AND c.tel_lap = q.lap_number"""

# --- splits -------------------------------------------------------------------------------

CTES["races"] = f"SELECT DISTINCT {SES} FROM laps"
CTES["ranked_races"] = f"SELECT {SES}, row_number() OVER (ORDER BY {SES}) AS race_rank, count(*) OVER () AS n FROM races"
# round_even is half-to-even rounding, the share is 0.2
CTES["test_races"] = f"SELECT {SES} FROM ranked_races WHERE race_rank > n - greatest(1, least(CAST(round_even(n * 0.2e0, 0) AS BIGINT), n - 1))"
CTES["tr"] = f"SELECT cond.* FROM cond ANTI JOIN test_races t ON {_on('cond', 't', SES)}"
CTES["te"] = f"SELECT cond.* FROM cond SEMI JOIN test_races t ON {_on('cond', 't', SES)}"
# Lighter twins that need no telemetry or weather.
CTES["ltr"] = f"SELECT l.*, l.stint_compound AS tire_compound, l.tyre_life AS tire_age_laps FROM tlaps l ANTI JOIN test_races t ON {_on('l', 't', SES)}"
CTES["lte"] = f"SELECT l.*, l.stint_compound AS tire_compound, l.tyre_life AS tire_age_laps FROM tlaps l SEMI JOIN test_races t ON {_on('l', 't', SES)}"

# --- models -------------------------------------------------------------------------------

_Y, _X = "lap_time_delta_s", "CAST(tire_age_laps AS DOUBLE)"
CTES["ltrain"] = f"SELECT * FROM ltr WHERE is_valid_lap AND {_Y} IS NOT NULL AND tire_age_laps IS NOT NULL AND tire_compound IS NOT NULL"
CTES["lin"] = f"""
SELECT tire_compound, grouping(tire_compound) = 1 AS is_pooled, count(*) AS n_rows,
       regr_intercept({_Y}, {_X}) AS b0, regr_slope({_Y}, {_X}) AS b1 FROM ltrain GROUP BY ROLLUP (tire_compound)
HAVING count(*) >= 2"""
CTES["quad_m"] = f"""
SELECT tire_compound, grouping(tire_compound) = 1 AS is_pooled, count(*) AS n_rows,
       avg({_X}) AS mx, avg({_X} * {_X}) AS mq, avg({_Y}) AS my, var_pop({_X}) AS sxx, var_pop({_X} * {_X}) AS sqq,
       covar_pop({_X}, {_X} * {_X}) AS sxq, covar_pop({_X}, {_Y}) AS sxy, covar_pop({_X} * {_X}, {_Y}) AS sqy
FROM ltrain GROUP BY ROLLUP (tire_compound) HAVING count(*) >= 3"""
CTES["quad_b"] = """
SELECT *, (sxy * sqq - sqy * sxq) / nullif(sxx * sqq - sxq * sxq, 0) AS b1, (sqy * sxx - sxy * sxq) / nullif(sxx * sqq - sxq * sxq, 0) AS b2 FROM quad_m"""
CTES["quad"] = "SELECT tire_compound, is_pooled, n_rows, my - b1 * mx - b2 * mq AS b0, b1, b2 FROM quad_b WHERE b1 IS NOT NULL"


def lin_scored(rows: str) -> str:
    """Rows of a CTE with the linear prediction."""
    return f"""SELECT t.*, coalesce(o.b0, g.b0) + coalesce(o.b1, g.b1) * t.tire_age_laps AS predicted, o.b0 IS NOT NULL AS has_own_fit
FROM {rows} t LEFT JOIN (SELECT * FROM lin WHERE NOT is_pooled) o ON t.tire_compound = o.tire_compound
CROSS JOIN (SELECT * FROM lin WHERE is_pooled) g"""


CTES["lin_te"] = lin_scored("lte")
CTES["quad_te"] = """
SELECT t.*, coalesce(o.b0, g.b0) + coalesce(o.b1, g.b1) * t.tire_age_laps + coalesce(o.b2, g.b2) * t.tire_age_laps * t.tire_age_laps AS predicted
FROM lte t LEFT JOIN (SELECT * FROM quad WHERE NOT is_pooled) o ON t.tire_compound = o.tire_compound
CROSS JOIN (SELECT * FROM quad WHERE is_pooled) g"""

CTES["ctrain"] = f"SELECT * FROM tr WHERE is_valid_lap AND {_Y} IS NOT NULL AND tire_age_laps IS NOT NULL AND avg_corner_speed_kph IS NOT NULL AND track_temp_c IS NOT NULL"


def _stat(c: str, a: str) -> str:
    std = f"stddev_samp({c})"
    return (
        f"avg({c}) AS {a}_mean, CASE WHEN {std} > 1e-8 THEN {std} ELSE 1.0e0 END AS {a}_std, "
        f"CAST(min({c}) AS DOUBLE) AS {a}_lo, CAST(max({c}) AS DOUBLE) AS {a}_hi"
    )


CTES["cstats"] = f"SELECT {_stat('tire_age_laps', 'age')}, {_stat('avg_corner_speed_kph', 'speed')}, {_stat('track_temp_c', 'temp')} FROM ctrain"

_Z = "(t.avg_corner_speed_kph - s.speed_mean) / s.speed_std AS z1, (t.track_temp_c - s.temp_mean) / s.temp_std AS z2"
_DESIGN = {
    "ols": "1.0e0 AS x0, CAST(t.tire_age_laps AS DOUBLE) AS x1",
    "rid": "1.0e0 AS x0, (t.tire_age_laps - s.age_mean) / s.age_std AS x1",
}


def design(name: str, rows: str) -> str:
    """Design columns x0..x5 over the rows of a CTE."""
    return f"""SELECT *, x1 * z1 AS x2, x1 * z2 AS x3, z1 AS x4, z2 AS x5 FROM (
  SELECT t.*, {_DESIGN[name]}, {_Z} FROM {rows} t CROSS JOIN cstats s)"""


def gram(rows: str, k: int, group: str = "ROLLUP (tire_compound)", y: str = _Y) -> str:
    sums = [f"sum(x{i} * x{j}) AS a_{i}_{j}" for i in range(k) for j in range(k)]
    sums += [f"sum(x{i} * {y}) AS a_{i}_{k}" for i in range(k)]
    return f"""SELECT tire_compound, grouping(tire_compound) = 1 AS is_pooled, count(*) AS n_rows,
 count(DISTINCT circuit) AS n_circuits, {', '.join(sums)} FROM {rows} GROUP BY {group}"""


def eliminate(name: str, source: str, k: int, penalty: str = "0") -> None:
    """Gauss-Jordan elimination of a k x k system as k table expressions; result b0..bk-1."""
    keep = "tire_compound, is_pooled, n_rows, n_circuits"
    extra = ", alpha" if penalty != "0" else ""
    cells = [f"a_{i}_{j}" + (f" + {penalty} AS a_{i}_{j}" if i == j and i > 0 and penalty != "0" else "")
             for i in range(k) for j in range(k + 1)]
    CTES[f"{name}_e0"] = f"SELECT {keep}{extra}, {', '.join(cells)} FROM {source}"
    for p in range(k):
        out = []
        for i in range(k):
            for j in range(k + 1):
                cell = f"a_{p}_{j} / a_{p}_{p}" if i == p else f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p}"
                out.append(f"{cell} AS a_{i}_{j}")
        CTES[f"{name}_e{p + 1}"] = f"SELECT {keep}{extra}, {', '.join(out)} FROM {name}_e{p}"
    CTES[name] = f"SELECT {keep}{extra}, " + ", ".join(f"a_{i}_{k} AS b{i}" for i in range(k)) + f" FROM {name}_e{k}"


CTES["ols_x"] = design("ols", "ctrain")
CTES["ols_g"] = gram("ols_x", 6)
eliminate("ols_all", "ols_g", 6)
CTES["ols"] = "SELECT * FROM ols_all WHERE is_pooled OR (n_rows >= 30 AND n_circuits >= 5)"

ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
CTES["alphas"] = "SELECT * FROM (VALUES " + ", ".join(f"({a}e0)" for a in ALPHAS) + ") v(alpha)"
CTES["rid_x"] = design("rid", "ctrain")
CTES["rid_g0"] = gram("rid_x", 6)
CTES["rid_g"] = "SELECT * FROM rid_g0 CROSS JOIN alphas"
eliminate("rid_all", "rid_g", 6, "alpha")
CTES["rid"] = "SELECT * FROM rid_all WHERE is_pooled OR (n_rows >= 30 AND n_circuits >= 5)"

_DOT = " + ".join(f"coalesce(o.b{i}, g.b{i}) * t.x{i}" for i in range(6))


def circuit_scored(model: str, rows: str, where: str = "true") -> str:
    return f"""SELECT t.*, {_DOT} AS predicted, o.b0 IS NOT NULL AS has_own_fit FROM ({design(model, rows)}) t
LEFT JOIN (SELECT * FROM {model} WHERE NOT is_pooled AND {where}) o ON t.tire_compound = o.tire_compound
CROSS JOIN (SELECT * FROM {model} WHERE is_pooled AND {where}) g"""


CTES["ols_te"] = circuit_scored("ols", "te")
OUTSIDE = """(coalesce(avg_corner_speed_kph < speed_lo OR avg_corner_speed_kph > speed_hi, false)
 OR coalesce(track_temp_c < temp_lo OR track_temp_c > temp_hi, false))"""
CTES["te_flag"] = f"SELECT te.*, {OUTSIDE} AS is_extrapolating FROM te CROSS JOIN cstats"
CTES["in_range"] = "SELECT * FROM te_flag WHERE is_valid_lap AND NOT is_extrapolating"
CTES["rid_in"] = f"""
SELECT t.*, o.alpha AS o_alpha, g.alpha, {_DOT} AS predicted FROM ({design('rid', 'in_range')}) t
CROSS JOIN (SELECT * FROM rid WHERE is_pooled) g
LEFT JOIN (SELECT * FROM rid WHERE NOT is_pooled) o ON t.tire_compound = o.tire_compound AND o.alpha = g.alpha"""

METRICS = f"""round(avg(abs({_Y} - predicted)), 6) + 0.0e0 AS mae, round(sqrt(avg(({_Y} - predicted) * ({_Y} - predicted))), 6) + 0.0e0 AS rmse,
 round(1.0e0 - sum(({_Y} - predicted) * ({_Y} - predicted)) FILTER (WHERE {_Y} IS NOT NULL AND predicted IS NOT NULL)
   / nullif(count(*) FILTER (WHERE {_Y} IS NOT NULL AND predicted IS NOT NULL)
            * var_pop({_Y}) FILTER (WHERE {_Y} IS NOT NULL AND predicted IS NOT NULL), 0), 6) + 0.0e0 AS r2,
 count(*) FILTER (WHERE {_Y} IS NOT NULL AND predicted IS NOT NULL) AS n_samples,
 count(*) FILTER (WHERE {_Y} IS NULL OR predicted IS NULL) AS n_dropped"""

# --- requests and defaults ----------------------------------------------------------------

CTES["requests"] = """
SELECT s_suppkey AS request_id, concat('C', CAST(s_suppkey % 12 AS VARCHAR)) AS circuit,
       20.0e0 + s_nationkey * 0.8e0 AS track_temp_c, 0.25e0 + (s_suppkey % 7) * 0.25e0 AS threshold_s,
       s_nationkey % 2 = 0 AS wet,
       CASE WHEN s_suppkey % 3 = 0 THEN 150.0e0 + s_nationkey * 4.0e0 END AS avg_corner_speed_kph
FROM supplier"""
CTES["compound_list"] = "SELECT * FROM (VALUES (0, 'SOFT'), (1, 'MEDIUM'), (2, 'HARD')) v(pos, tire_compound)"

DEF_NUM = ("avg_corner_speed_kph", "track_temp_c", "air_temp_c")
CTES["deflt"] = f"""
SELECT circuit, tire_compound, CASE grouping(circuit, tire_compound) WHEN 0 THEN 'pair' WHEN 1 THEN 'circuit' WHEN 2 THEN 'compound' ELSE 'all' END AS level,
       count(*) AS n_rows, {', '.join(f'avg({c}) AS {c}' for c in DEF_NUM)},
       sum(CASE WHEN is_raining THEN 1 WHEN NOT is_raining THEN -1 END) > 0 AS is_raining
FROM cond GROUP BY CUBE (circuit, tire_compound)"""
CTES["asked"] = """
SELECT r.request_id, r.circuit, r.track_temp_c, r.threshold_s, r.wet, c.pos, c.tire_compound,
       coalesce(r.avg_corner_speed_kph, CASE WHEN p.level IS NOT NULL THEN p.avg_corner_speed_kph WHEN k.level IS NOT NULL THEN k.avg_corner_speed_kph
            WHEN m.level IS NOT NULL THEN m.avg_corner_speed_kph ELSE a.avg_corner_speed_kph END) AS avg_corner_speed_kph,
       CASE WHEN p.level IS NOT NULL THEN p.air_temp_c WHEN k.level IS NOT NULL THEN k.air_temp_c
            WHEN m.level IS NOT NULL THEN m.air_temp_c ELSE a.air_temp_c END AS air_temp_c,
       CASE WHEN p.level IS NOT NULL THEN p.is_raining WHEN k.level IS NOT NULL THEN k.is_raining
            WHEN m.level IS NOT NULL THEN m.is_raining ELSE a.is_raining END AS is_raining
FROM requests r CROSS JOIN compound_list c
LEFT JOIN (SELECT * FROM deflt WHERE level = 'pair') p ON r.circuit = p.circuit AND c.tire_compound = p.tire_compound
LEFT JOIN (SELECT * FROM deflt WHERE level = 'circuit') k ON r.circuit = k.circuit
LEFT JOIN (SELECT * FROM deflt WHERE level = 'compound') m ON c.tire_compound = m.tire_compound
CROSS JOIN (SELECT * FROM deflt WHERE level = 'all') a"""
CTES["half_ages"] = "SELECT i / 2.0e0 AS tire_age_laps FROM generate_series(2, 120) g(i)"
CTES["asked_swept"] = "SELECT asked.*, h.tire_age_laps FROM asked CROSS JOIN half_ages h"
CTES["asked_scored"] = circuit_scored("ols", "asked_swept")


def crossing(rows: str, keys: str) -> str:
    """First upward crossing of threshold_s, and whether the sweep starts above it."""
    return f"""SELECT {keys}, arg_min(a0 + (threshold_s - d0) / (predicted - d0) * (tire_age_laps - a0), tire_age_laps)
            FILTER (WHERE d0 < threshold_s AND threshold_s <= predicted) AS life_laps,
       coalesce(arg_min(predicted, tire_age_laps) >= max(threshold_s), false) AS starts_above
FROM (SELECT *, lag(predicted) OVER w AS d0, lag(tire_age_laps) OVER w AS a0 FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY tire_age_laps))
GROUP BY {keys}"""


CTES["report"] = f"""
SELECT x.request_id, x.tire_compound AS compound, a.circuit, a.pos, a.track_temp_c, a.threshold_s, x.life_laps, x.starts_above,
       coalesce(o.b1, g.b1) + coalesce(o.b2, g.b2) * (a.avg_corner_speed_kph - s.speed_mean) / s.speed_std
         + coalesce(o.b3, g.b3) * (a.track_temp_c - s.temp_mean) / s.temp_std AS rate_s_per_lap,
       o.b0 IS NULL AS used_global_fallback,
       (coalesce(a.avg_corner_speed_kph < s.speed_lo OR a.avg_corner_speed_kph > s.speed_hi, false)
        OR coalesce(a.track_temp_c < s.temp_lo OR a.track_temp_c > s.temp_hi, false)) AS is_extrapolating
FROM ({crossing('asked_scored', 'request_id, tire_compound')}) x
JOIN asked a ON x.request_id = a.request_id AND x.tire_compound = a.tire_compound
LEFT JOIN (SELECT * FROM ols WHERE NOT is_pooled) o ON x.tire_compound = o.tire_compound
CROSS JOIN (SELECT * FROM ols WHERE is_pooled) g CROSS JOIN cstats s"""

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def sql(body: str) -> str:
    """The body with every table expression it needs, in order of definition."""
    needed: set[str] = set()

    def visit(text: str, self_name: str = "") -> None:
        for word in set(_WORD.findall(text)):
            if word in CTES and word not in needed and word != self_name:
                needed.add(word)
                visit(CTES[word], word)

    visit(body)
    parts = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in needed]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0e0 AS {alias or expr}"
