"""Sums of draws travel in small rows, and shallower forests with the driver's inputs need no fit."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog import all_queries, models
from stintwise.operators import evaluate as E
from stintwise.operators import forest as RF
from stintwise.operators import growth as G
from tests.test_growth import SPEC, rows  # noqa: F401


def test_a_row_of_sums_holds_few_cells_whatever_the_batch(rows, monkeypatch):  # noqa: F811
    whole = RF.drawn(RF.training_frame(rows, SPEC), SPEC)[2].agg(F.sum(F.length("n"))).first()[0]
    monkeypatch.setattr(G, "BLOCK", 20)
    sums = RF.drawn(RF.training_frame(rows.coalesce(1), SPEC), SPEC)[2]
    cells = sums.agg(F.max(F.length("n") / 8).alias("most"), F.sum(F.length("n")).alias("all")).first()
    assert cells["most"] <= 40 and whole <= cells["all"] <= 2 * whole


def test_depths_are_those_of_their_own_fits(rows):  # noqa: F811
    train, validation = rows.filter("tire_age_laps < 9"), rows.withColumn("track_temp_c", F.expr("nullif(track_temp_c, 21)"))
    found = {r["depth"]: r for r in RF.depth_metrics(train, validation, [2, 4], SPEC).collect()}
    for depth in (2, 4):
        model = RF.fit_forest(train, replace(SPEC, depth=depth))
        want = E.metrics(RF.predict_forest(model, validation)).first()
        assert all(found[depth][c] == pytest.approx(want[c], abs=1e-9) for c in want.asDict()) and want["n_dropped"] > 0
        assert found[depth]["n_training"] == train.count()


def test_driver_inputs_take_two_fits(spark, monkeypatch):
    fits, real = [], G.drawn_sums
    monkeypatch.setattr(G, "drawn_sums", lambda *a: fits.append(a) or real(*a))
    base = RF.ForestSpec
    monkeypatch.setattr(RF, "ForestSpec", lambda **k: base(**{**k, "trees": 3}))
    found = all_queries()["m17_driver_features"](spark, "/root/testdata/sf0.001")
    assert {(r["driver_features"], r["depth"]) for r in found.collect()} == {(False, 10), *((True, n) for n in models.DRIVER_DEPTHS)}
    assert len(fits) == 2
    assert found.columns == ["mae", "rmse", "r2", "n_samples", "n_dropped", "driver_features", "depth", "n_training"]
