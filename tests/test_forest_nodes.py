"""Scores, support, shallower forests and importances from the node table, by value."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from catalog import all_queries, models
from stintwise.operators import forest as RF
from stintwise.operators import nodes as N
from stintwise.operators.evaluate import PREDICTED, evaluate
from stintwise.plans import report as P

SPEC = RF.ForestSpec(continuous=("tire_age_laps", "track_temp_c"), boolean=("is_raining",), trees=7, depth=5)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(900).select(
        i.cast("string").alias("key"),
        F.element_at(F.array(*map(F.lit, ("SOFT", "MEDIUM", "HARD"))), (i % 3 + 1).cast("int")).alias("tire_compound"),
        F.concat(F.lit("C"), (i % 5).cast("string")).alias("circuit"),
        (i % 23).cast("double").alias("tire_age_laps"),
        (F.lit(20.0) + i % 17).alias("track_temp_c"),
        (i % 4 == 0).alias("is_raining"),
        F.lit(True).alias("is_valid_lap"),
        (i % 23 * 0.1 + i % 3 * 0.4 + i % 5 * 0.9 + F.sin(i * 1.7)).alias("lap_time_delta_s"),
    )


@pytest.fixture(scope="module")
def fitted(rows):
    return RF.fit_forest(rows, SPEC)


def by_key(df, *columns):
    return {r["key"]: [r[c] for c in columns] for r in df.collect()}


def walked(spark, model, rows, tmp_path):
    """Value and support of every row by a recursive walk in SQL over the exported nodes."""
    RF.encode(model.encoder, RF._numbers(rows, model.spec), ["key"]).drop("_vector").write.parquet(f"{tmp_path}/x")
    model.nodes.write.parquet(f"{tmp_path}/nodes")
    found = duckdb.sql(f"""
WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'), x AS (SELECT key, _features AS f FROM '{tmp_path}/x/*.parquet'),
w AS (SELECT key, f, tree, node, "left", "right", feature, threshold, value, "rows" FROM x CROSS JOIN n WHERE node = 0
  UNION ALL SELECT w.key, w.f, n.tree, n.node, n."left", n."right", n.feature, n.threshold, n.value, n."rows"
  FROM w JOIN n ON n.tree = w.tree AND n.node = CASE WHEN w.f[w.feature + 1] <= w.threshold THEN w."left" ELSE w."right" END)
SELECT key, avg(value), avg("rows"), count(*) FROM w WHERE "left" IS NULL GROUP BY key""").fetchall()
    return {k: [v, n] for k, v, n, trees in found if trees == model.spec.trees}


def test_scores_and_support_equal_a_walk_in_sql(spark, fitted, rows, tmp_path):
    want = walked(spark, fitted, rows, tmp_path)
    got = by_key(RF.predict_with_support(fitted, rows), PREDICTED, "avg_leaf_rows")
    assert got.keys() == want.keys() and len(got) == 900
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_scores_equal_those_of_the_library(rows):
    frame = RF.training_frame(rows, SPEC)
    pipeline = Pipeline(stages=RF._stages(SPEC)).fit(frame)
    table = N.node_table(pipeline.stages[-1])
    ready = RF.encode(pipeline, RF._numbers(rows, SPEC), ["key", PREDICTED])
    got = by_key(N.score(ready, N.runs(table)), PREDICTED, "_value")
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in got.values()) and len(got) == 900
    want = pipeline.stages[-1].featureImportances.toArray()
    found = {r["feature"]: r["importance"] for r in N.importance_by_feature(table).collect()}
    assert [found.get(i, 0.0) for i in range(len(want))] == pytest.approx(list(want), abs=1e-9)


def test_a_larger_forest_is_walked_in_runs(fitted, rows, monkeypatch):
    want = by_key(RF.predict_with_support(fitted, rows), PREDICTED, "avg_leaf_rows")
    monkeypatch.setattr(N, "MOST_NODES", 50)
    monkeypatch.setattr(N, "CELLS", 100)
    parts = N.runs(fitted.nodes)
    assert len(parts) > 2
    again = by_key(RF.predict_with_support(replace(fitted, parts=parts), rows), PREDICTED, "avg_leaf_rows")
    assert all(again[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    shorter = N.score_shorter(RF.encode(fitted.encoder, RF._numbers(rows, SPEC), ["key"]), parts, [5], [7])
    assert all(v[0][0] == pytest.approx(want[k][0], abs=1e-9) for k, v in by_key(shorter, "_values").items())


def test_shallower_forests_need_no_fit(rows):
    """At the number of trees that was fitted, a forest ended earlier is the one fitted so."""
    train, validation = rows.filter("key % 3 <> 0"), rows.filter("key % 3 = 0")
    grid = {"trees": [6], "depth": [2, 3, 5], "min_leaf": [5, 20]}
    found = dict(RF.tune(train, validation, grid, SPEC))
    assert len(found) == 6
    frame_fit = lambda spec: RF.predict_forest(RF.fit_forest(train, spec), validation)
    for spec, r2 in found.items():
        assert r2 == pytest.approx(evaluate(frame_fit(spec)).r2, abs=1e-9)


def test_every_combination_is_scored(rows):
    found = RF.tune(rows, rows, {"trees": [2, 5], "depth": [1, 4], "min_leaf": [5]}, SPEC)
    assert [(s.trees, s.depth, s.min_leaf) for s, _ in found] == [(2, 1, 5), (2, 4, 5), (5, 1, 5), (5, 4, 5)]
    assert all(r2 is not None for _, r2 in found)


def test_support_moves_no_rows(fitted, rows):
    plan = RF.predict_with_support(fitted, rows.repartition("key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one above


def test_folds_keep_whole_groups_apart(rows):
    r2 = RF.fold_r2(rows, {"race": ["circuit"], "lap": ["key"]}, 2, replace(SPEC, trees=3))
    assert set(r2) == {"race", "lap"} and r2["lap"] > r2["race"]


def test_a_stored_model_is_the_one_that_was_fitted(spark, fitted, rows, tmp_path):
    RF.save(fitted, f"{tmp_path}/m")
    again = RF.load(spark, f"{tmp_path}/m")
    assert again.spec == SPEC
    assert by_key(RF.predict_with_support(again, rows), PREDICTED, "low_support") == by_key(RF.predict_with_support(fitted, rows), PREDICTED, "low_support")
    with pytest.raises(ValueError):
        RF.load(spark, f"{tmp_path}/m", replace(SPEC, trees=8))


def test_an_export_answers_without_the_laps(spark, fitted, rows, tmp_path):
    P.export_model(fitted, rows, f"{tmp_path}/e")
    e = P.load_export(spark, f"{tmp_path}/e")
    asked = spark.createDataFrame([(1, "C1", 25.0, 1.0, True), (2, "nowhere", 25.0, 1.0, False)], "request_id long, circuit string, track_temp_c double, threshold_s double, wet boolean")
    curves = P.beyond_observed(P.wear_curves(e.model, asked, e.defaults), e.max_age)
    assert {r["request_id"] for r in curves.collect()} == {1}
    ages = {r["tire_age_laps"]: r["beyond_observed_age"] for r in curves.collect()}
    assert ages[22.0] is False and ages[23.0] is True
    assert e.circuits.count() == 5


def test_one_fit_serves_all_queries_of_a_session(spark, monkeypatch, rows):
    fits = []

    def fit(train, spec=RF.ForestSpec()):
        fits.append(spec)
        return real(train, replace(spec, trees=3, depth=3))

    real = RF.fit_forest
    monkeypatch.setattr(RF, "fit_forest", fit)
    sf = "/root/testdata/sf0.001/."  # its own key: other tests keep theirs
    for name in ("m14_forest_metrics", "m15_leaf_support", "m16_t7_forest_importances"):
        assert all_queries()[name](spark, sf).count() > 0
    assert fits == [RF.ForestSpec()]
    assert models.GRID["trees"] == [200, 400]
