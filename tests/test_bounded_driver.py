"""The driver holds some trees of a forest at a time, while they grow and while they are sent."""

import pickle

from stintwise.operators import forest as RF
from stintwise.operators import growth as G
from stintwise.operators import nodes as N
from tests.test_growth import SPEC, rows  # noqa: F401


def test_a_forest_grows_and_is_sent_in_parts(spark, rows, monkeypatch):  # noqa: F811
    spec = RF.ForestSpec(**{**SPEC.__dict__, "trees": 40})
    whole = RF.fit_forest(rows, spec)
    want, scores = whole.nodes.orderBy("tree", "node").collect(), RF.predict_forest(whole, rows).orderBy(*rows.columns).collect()
    sent, wide = [], []
    real, grow = type(spark.sparkContext).broadcast, G.grow_some
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, v: sent.append(len(pickle.dumps(v))) or real(sc, v))
    monkeypatch.setattr(G, "grow_some", lambda sums, d, forest, *a: wide.append(len(forest)) or grow(sums, d, forest, *a))
    RF.fit_forest(rows, spec)
    most, sent[:] = max(sent), []
    assert wide == [40]
    monkeypatch.setattr(G, "GROWN", 8 * 2 ** (spec.depth + 1))
    monkeypatch.setattr(G, "WRITTEN", 50)
    monkeypatch.setattr(N, "SENT", 50)
    again = RF.fit_forest(rows, spec)
    assert again.nodes.orderBy("tree", "node").collect() == want
    assert wide[1:] == [8] * 5 and max(sent) < most / 2 and len(again.parts) == 1 and len(again.parts[0].sent) > 5
    for a, b in zip(RF.predict_forest(again, rows).orderBy(*rows.columns).collect(), scores):
        assert abs(a.predicted - b.predicted) < 1e-9


def test_the_driver_holds_few_trees_whatever_the_forest():
    d = G.Design(("x",), (None,), (2,), 0.0, 1.0, 10**8)
    for trees, depth, leaf in ((400, 12, 5), (4000, 12, 5), (300, 10, 5), (300, 30, 5)):
        at_once = G.grown_together(d, trees, depth, leaf)
        assert at_once == 1 or at_once * 2 ** (depth + 1) <= G.GROWN
