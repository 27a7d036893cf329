"""Wear curves come from the exported model, and the driver's inputs are compared."""

import pytest

from catalog import all_queries, models, reports
from stintwise.operators import forest as RF


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["d9_wear_curves", "d9_curve_summary", "d10_report_inputs"])
def test_wear_curves_fit_the_exported_inputs_on_every_record(monkeypatch, name):
    def fit(train, spec=RF.ForestSpec()):
        raise Fitted(train, spec)

    monkeypatch.setattr(reports, "record_rows", lambda spark, d: "records")
    monkeypatch.setattr(reports, "settle", lambda rows: rows)
    monkeypatch.setattr(RF, "fit_forest", fit)
    with pytest.raises(Fitted) as caught:
        all_queries()[name](None, None)
    rows, spec = caught.value.args
    assert rows == "records" and (spec.trees, spec.depth) == (200, 10)
    assert "fuel_load_estimate_kg" not in spec.features
    assert {"avg_braking_decel_ms2", "peak_braking_decel_ms2", "avg_throttle_pct"} <= set(spec.features)


def test_driver_inputs_are_compared_at_three_depths():
    trials = models.driver_trials()
    assert [(wide, s.trees, s.depth) for wide, s in trials] == [(False, 200, 10), (True, 200, 8), (True, 200, 10), (True, 200, 12)]
    assert all(set(models.DRIVER_INPUTS) <= set(s.features) for wide, s in trials if wide)
