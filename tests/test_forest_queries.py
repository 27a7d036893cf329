"""The registered forest queries fit whole forests, not small ones."""

from itertools import product

import pytest

from catalog import all_queries, models
from stintwise.operators import forest as RF


class Fitted(Exception):
    pass


@pytest.mark.parametrize(
    "name", ["m13_m14_forest_prediction", "m14_forest_metrics", "m15_leaf_support", "m16_t7_forest_importances"]
)
def test_a_query_fits_the_whole_forest(monkeypatch, name):
    def fit(train, spec=RF.ForestSpec()):
        raise Fitted(spec)

    monkeypatch.setattr(models, "condition_split", lambda spark, d: (None, None))
    monkeypatch.setattr(RF, "fit_forest", fit)
    with pytest.raises(Fitted) as caught:
        all_queries()[name](None, None)
    spec = caught.value.args[0]
    assert (spec.trees, spec.depth, spec.min_leaf) == (300, 10, 5)


def test_the_sweep_tries_every_combination():
    tried = set(product(*models.GRID.values()))
    assert tried == set(product((200, 400), (4, 6, 8, 10, 12), (5, 10, 20))) and len(tried) == 30


def test_bins_reach_the_estimator(spark):
    assert RF._stages(RF.ForestSpec())[-1].getMaxBins() == 64
    assert RF._stages(RF.ForestSpec(bins=100))[-1].getMaxBins() == 100
