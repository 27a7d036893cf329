import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import by
from stintwise.operators import evaluate as E
from stintwise.operators import forest as RF
from stintwise.operators import life
from stintwise.operators import linear as M

FRAME = "tire_compound string, tire_age_laps int, lap_time_delta_s double, is_valid_lap boolean"


def wear(spark, rates, ages=range(1, 15), curve=0.0, noise=0.0):
    rng = np.random.default_rng(0)
    rows = [
        (c, a, float(k * a + curve * a * a + rng.normal(0, noise) if noise else k * a + curve * a * a), True)
        for c, k in rates.items()
        for a in ages
    ]
    return spark.createDataFrame(rows, FRAME)


def circuits(spark, n=400, seed=2):
    """Rows with known circuit-dependent wear; one compound seen on too few circuits."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 8))
        compound = ["SOFT", "HARD"][i % 2]
        speed, temp, age = 150.0 + 10 * k, float(20 + rng.random() * 20), int(rng.integers(1, 30))
        delta = 0.1 * age + 0.0005 * age * (speed - 180) + 0.002 * age * (temp - 30) + float(rng.normal(0, 0.05))
        rows.append((compound, f"C{k}", age, speed, temp, delta, True))
    rows += [("INTERMEDIATE", "C1", a, 160.0, 25.0, 5.0 * a, True) for a in range(1, 50)]
    return spark.createDataFrame(
        rows,
        "tire_compound string, circuit string, tire_age_laps int, avg_corner_speed_kph double, track_temp_c double, "
        "lap_time_delta_s double, is_valid_lap boolean",
    )


def test_linear_recovers_rates_and_excludes_invalid_laps(spark):
    good = wear(spark, {"SOFT": 0.15, "HARD": 0.05}, noise=0.01)
    bad = spark.createDataFrame([("SOFT", 5, 40.0, False), ("SOFT", None, 1.0, True), (None, 3, 9.0, True)], FRAME)
    fit = M.fit_polynomial(good.unionByName(bad))
    rates = by(fit.coefficients(), "tire_compound", "b1")
    assert rates["SOFT"] == pytest.approx(0.15, abs=0.01) and rates["HARD"] == pytest.approx(0.05, abs=0.01)


def test_linear_equals_polyfit_and_unknown_compounds_take_the_pooled_fit(spark):
    df = wear(spark, {"SOFT": 0.2, "HARD": 0.1}, noise=0.3)
    pdf = df.toPandas()
    fit = M.fit_polynomial(df)
    query = spark.createDataFrame([("SOFT", 7), ("NEW", 7), (None, 7), ("SOFT", None)], "tire_compound string, tire_age_laps int")
    got = {(r.tire_compound, r.tire_age_laps): (r.predicted, r.has_own_fit) for r in M.predict_polynomial(fit, query).collect()}
    soft = pdf[pdf.tire_compound == "SOFT"]
    own = np.polyval(np.polyfit(soft.tire_age_laps, soft.lap_time_delta_s, 1), 7)
    pooled = np.polyval(np.polyfit(pdf.tire_age_laps, pdf.lap_time_delta_s, 1), 7)
    assert got[("SOFT", 7)] == (pytest.approx(own), True)
    assert got[("NEW", 7)] == (pytest.approx(pooled), False) == got[(None, 7)]
    assert got[("SOFT", None)][0] is None


def test_quadratic_beats_linear_on_a_curve(spark):
    df = wear(spark, {"SOFT": 0.02}, range(1, 20), curve=0.01, noise=0.02)
    pdf = df.toPandas()
    one, two = (E.evaluate(M.predict_polynomial(M.fit_polynomial(df, n), df)) for n in (1, 2))
    assert two.rmse < one.rmse and two.r2 > one.r2
    want = np.polyfit(pdf.tire_age_laps, pdf.lap_time_delta_s, 2)
    row = M.fit_polynomial(df, 2).own.first()
    assert [row.b2, row.b1, row.b0] == pytest.approx(list(want))


def test_one_age_or_one_row_falls_back(spark):
    df = wear(spark, {"SOFT": 0.2}).unionByName(
        spark.createDataFrame([("HARD", 4, 1.0, True), ("HARD", 4, 2.0, True), ("WET", 3, 1.0, True)], FRAME)
    )
    assert set(by(M.fit_polynomial(df).own, "tire_compound", "b1")) == {"SOFT"}
    with pytest.raises(ValueError):
        M.fit_polynomial(df.filter("tire_compound = 'WET'"))


def test_fitted_curve_spans_observed_ages(spark):
    df = wear(spark, {"SOFT": 0.2}, range(3, 11))
    curve = M.fitted_curve(M.fit_polynomial(df), df).orderBy("i").collect()
    assert len(curve) == 50 and curve[0].tire_age_laps == 3 and curve[-1].tire_age_laps == 10
    assert curve[-1].predicted == pytest.approx(2.0)


def test_metrics_contract(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0), (None, 1.0), (4.0, None)], "lap_time_delta_s double, predicted double")
    row = E.evaluate(df)
    assert (row.n_samples, row.n_dropped) == (3, 2)
    assert row.mae == pytest.approx(0.5) and row.rmse == pytest.approx(np.sqrt(1.25 / 3)) and row.r2 == pytest.approx(1 - 1.25 / 2)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], df.schema)
    assert E.evaluate(flat).r2 is None
    with pytest.raises(ValueError):
        E.evaluate(df.filter("predicted IS NULL"))


def design(pdf, stats, scaled):
    z = [(pdf[c] - stats[c]["mean"]) / stats[c]["std"] for c in M.CIRCUIT_FEATURES]
    age = (pdf.tire_age_laps - stats[M.AGE]["mean"]) / stats[M.AGE]["std"] if scaled else pdf.tire_age_laps
    return np.column_stack([np.ones(len(pdf)), age, age * z[0], age * z[1], z[0], z[1]])


def test_circuit_aware_equals_lstsq(spark):
    df = circuits(spark)
    model = M.fit_circuit_aware(df)
    pdf = df.toPandas()
    own = {r.tire_compound: [r[n] for n in M.NAMES] for r in model.fit.own.collect()}
    assert set(own) == {"SOFT", "HARD"}  # the third compound was on one circuit only
    for c in own:
        g = pdf[pdf.tire_compound == c]
        want = np.linalg.lstsq(design(g, model.stats, False), g.lap_time_delta_s, rcond=None)[0]
        assert own[c] == pytest.approx(list(want), abs=1e-8)
    want = np.linalg.lstsq(design(pdf, model.stats, False), pdf.lap_time_delta_s, rcond=None)[0]
    assert [model.fit.pooled[n] for n in M.NAMES] == pytest.approx(list(want), abs=1e-8)
    scored = M.predict_circuit(model, df.unionByName(df.limit(1).withColumn("track_temp_c", F.lit(None).cast("double"))))
    assert scored.filter("predicted IS NULL").count() == 1
    assert scored.filter("tire_compound = 'INTERMEDIATE' AND has_own_fit").count() == 0


def test_ridge_equals_normal_equations(spark):
    df = circuits(spark)
    pdf = df.toPandas()
    models = M.fit_circuit_models(df, (0.0, 5.0))
    for m in models:
        g = pdf[pdf.tire_compound == "SOFT"]
        x = design(g, m.stats, True)
        penalty = np.eye(6) * m.alpha
        penalty[0, 0] = 0
        want = np.linalg.solve(x.T @ x + penalty, x.T @ g.lap_time_delta_s)
        row = m.fit.own.filter("tire_compound = 'SOFT'").first()
        assert [row[n] for n in M.NAMES] == pytest.approx(list(want), abs=1e-8)
    swept = M.predict_ridge_sweep(models, df)
    assert swept.count() == 2 * df.count()
    one = M.predict_circuit(models[1], df).agg(F.sum("predicted")).first()[0]
    assert swept.filter("alpha = 5.0").agg(F.sum("predicted")).first()[0] == pytest.approx(one)
    with pytest.raises(ValueError):
        M.fit_ridge(df, -1.0)


def test_effective_rate_is_the_slope_in_age(spark):
    df = circuits(spark)
    for model in (M.fit_circuit_aware(df), M.fit_ridge(df, 1.0)):
        at = df.filter("tire_compound = 'SOFT'").limit(1)
        a = M.predict_circuit(model, at.withColumn("tire_age_laps", F.lit(10))).first().predicted
        b = M.predict_circuit(model, at.withColumn("tire_age_laps", F.lit(11))).first().predicted
        assert M.effective_rate(model, at).first().rate_s_per_lap == pytest.approx(b - a)


def test_too_few_circuits_is_an_error_and_range_flag(spark):
    df = circuits(spark)
    with pytest.raises(ValueError, match="circuits"):
        M.fit_circuit_aware(df.filter("circuit IN ('C1', 'C2')"))
    model = M.fit_circuit_aware(df)
    q = spark.createDataFrame([(1, 180.0, 30.0), (2, 999.0, 30.0), (3, 180.0, -5.0), (4, None, 30.0)], "i int, avg_corner_speed_kph double, track_temp_c double")
    assert by(q.withColumn("x", M.is_extrapolating(model)), "i", "x") == {1: False, 2: True, 3: True, 4: False}
    summary = {r.feature: r.n_outside for r in M.extrapolation_summary(model, q).collect()}
    assert summary == {"avg_corner_speed_kph": 1, "track_temp_c": 1}


def test_single_feature_equals_lstsq(spark):
    df = circuits(spark)
    pdf = df.toPandas()
    g = pdf[pdf.tire_compound == "HARD"]
    f = (g.track_temp_c - pdf.track_temp_c.mean()) / pdf.track_temp_c.std()
    a = (g.tire_age_laps - g.tire_age_laps.mean()) / g.tire_age_laps.std(ddof=0)
    want = np.linalg.lstsq(np.column_stack([np.ones(len(g)), a, a * f, f]), g.lap_time_delta_s, rcond=None)[0]
    coefs = M.fit_single_feature(df, "track_temp_c")
    row = coefs.filter("tire_compound = 'HARD'").first()
    assert [row[n] for n in M.SINGLE] == pytest.approx(list(want), abs=1e-8)
    scored = M.predict_single_feature(coefs, "track_temp_c", df)
    assert scored.filter("tire_compound = 'INTERMEDIATE' AND predicted IS NOT NULL").count() == 0


def sweep_of(spark, values, threshold=1.0):
    rows = [(1, 1.0 + i / 2, v, threshold) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "q int, tire_age_laps double, predicted double, t double")


@pytest.mark.parametrize(
    "values,want,above",
    [
        ([0.0, 0.5, 1.5], 1.75, False),
        ([0.0, 1.0, 2.0], 1.5, False),
        ([2.0, 3.0], None, True),
        ([2.0, 0.0, 2.0], 1.75, True),
        ([0.0, None, 2.0, 0.0, 2.0], 2.75, False),
        ([0.1, 0.2], None, False),
    ],
)
def test_crossing(spark, values, want, above):
    row = life.crossing(sweep_of(spark, values), ["q"], F.col("t")).first()
    assert row.life_laps == (None if want is None else pytest.approx(want)) and row.starts_above is above


def test_first_age_counts_a_start_above_and_thin_evidence(spark):
    df = sweep_of(spark, [0.9996, 2.0]).withColumn("thin", F.col("tire_age_laps") > 1)
    row = life.first_age_at(df, ["q"], F.col("t"), "thin").first()
    assert row.life_laps == 1.0 and row.durable is False and row.sparse_data is False
    never = life.first_age_at(df.withColumn("t", F.lit(9.0)), ["q"], F.col("t"), "thin").first()
    assert never.life_laps is None and never.durable is True and never.sparse_data is True


def test_sweep_sizes_and_ranking(spark):
    q = spark.createDataFrame([(1,)], "q int")
    assert life.sweep(q, ["q"], life.half_lap_ages()).count() == 119
    assert life.sweep(q, ["q"], life.whole_lap_ages()).count() == 60
    rep = spark.createDataFrame([(1, 0, "A", 5.0), (1, 1, "B", 5.0), (1, 2, "C", None), (2, 0, "A", None)], "q int, pos int, compound string, life_laps double")
    assert by(life.best_compound(rep, ["q"]), "q", "best_compound") == {1: "A", 2: None}
    ranks = {(r.q, r.compound): r["rank"] for r in life.ranked(rep, ["q"]).collect()}
    assert ranks == {(1, "A"): 1, (1, "B"): 2, (1, "C"): 3, (2, "A"): 1}


SPEC = RF.ForestSpec(continuous=("tire_age_laps", "track_temp_c"), boolean=("is_raining",), trees=8, depth=4)


def forest_rows(spark):
    return circuits(spark).withColumn("is_raining", F.col("track_temp_c") < 22)


def test_forest_scores_masks_and_saves(spark, tmp_path):
    df = forest_rows(spark)
    model = RF.fit_forest(df, SPEC)
    assert E.evaluate(RF.predict_forest(model, df)).r2 > 0.5
    one = df.limit(1)
    odd = one.withColumn("circuit", F.lit("unseen")).unionByName(one.withColumn("is_raining", F.lit(None).cast("boolean")))
    out = {r.circuit: r.predicted for r in RF.predict_forest(model, odd).collect()}
    assert out.pop("unseen") is not None and list(out.values()) == [None]
    RF.save(model, str(tmp_path))
    again = RF.load(spark, str(tmp_path), SPEC)
    a, b = (RF.predict_forest(m, df).agg(F.sum("predicted")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)


def test_leaf_support_counts_every_training_row(spark):
    df = forest_rows(spark).withColumn("i", F.monotonically_increasing_id())
    model = RF.fit_forest(df, SPEC)
    per_tree = model.leaf_rows.groupBy("tree").agg(F.sum("leaf_rows").alias("n")).collect()
    assert {r.n for r in per_tree} == {df.count()} and len(per_tree) == 8
    support = RF.leaf_support(model, df, ["i"])
    assert support.count() == df.count() and support.filter("avg_leaf_rows < 5").count() == 0


def test_importances_sum_to_one_by_source_feature(spark):
    rows = RF.importances(RF.fit_forest(forest_rows(spark), SPEC)).collect()
    assert {r.feature for r in rows} == set(SPEC.features) and sum(r.importance for r in rows) == pytest.approx(1.0)
    assert rows[0].importance == max(r.importance for r in rows)


def test_statistics_and_designs_follow_from_plain_sums(spark):
    df = circuits(spark)
    rows = M.circuit_training(df)
    pooled = M.plain_gram(rows, M.CIRCUIT_FEATURES).filter("is_pooled").first()
    got, want = M.plain_stats(pooled, M.CIRCUIT_FEATURES), M.feature_stats(rows, (M.AGE, *M.CIRCUIT_FEATURES))
    for c in want:
        assert [got[c][k] for k in ("mean", "std", "lo", "hi")] == pytest.approx([want[c][k] for k in ("mean", "std", "lo", "hi")], rel=1e-10)
    for scaled in (False, True):
        direct = M.gram(rows, M.circuit_design(want, scaled)).filter("is_pooled").first()
        plain = np.array([[pooled[f"g_{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)])
        t = M.standardising(want, M.CIRCUIT_FEATURES, scaled)
        turned = t @ plain @ t.T
        assert turned == pytest.approx(np.array([[direct[f"g_{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)]), rel=1e-9, abs=1e-6)


def test_a_feature_that_never_varies_and_one_row(spark):
    df = circuits(spark).withColumn("track_temp_c", F.lit(31.7))
    model = M.fit_circuit_aware(df)
    assert model.stats["track_temp_c"] == {"mean": pytest.approx(31.7), "std": 1.0, "lo": 31.7, "hi": 31.7}
    pdf = df.toPandas()
    g = pdf[pdf.tire_compound == "SOFT"]
    want = design(g, model.stats, False) @ np.linalg.lstsq(design(g, model.stats, False), g.lap_time_delta_s, rcond=1e-9)[0]
    scored = M.predict_circuit(model, df.filter("tire_compound = 'SOFT'")).agg(F.sum("predicted")).first()[0]
    assert scored == pytest.approx(float(want.sum()), rel=1e-8)
    pooled = M.plain_gram(M.circuit_training(df.limit(1)), ("track_temp_c",)).filter("is_pooled").first()
    assert M.plain_stats(pooled, ("track_temp_c",))["track_temp_c"]["std"] == 1.0
    with pytest.raises(ValueError):
        M.fit_circuit_aware(df.filter("false"))


def test_a_fit_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = circuits(spark)
    n = df.count()
    M.fit_circuit_models(df.mapInPandas(watch, df.schema), (0.0, 1.0, 10.0))
    assert seen.value == n
