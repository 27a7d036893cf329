"""Sliced numbering, nearest join, quantiles: against brute force, with hot groups."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.operators.asof import nearest_join
from stintwise.operators.lookup import attach, join_pinned, pin_small
from stintwise.operators.quantiles import exact_quantiles
from stintwise.operators.slices import number_within
from stintwise.settings import DEFAULTS

SMALL = replace(DEFAULTS, slice_us=10)


def test_numbering_across_slices_and_ties(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.randrange(0, 200), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t long, tie long")
    got = {(r.g, r.t, r.tie): r.n for r in number_within(df, ["g"], "t", "tie", "n", SMALL).collect()}
    for g in {r[0] for r in rows}:
        for i, row in enumerate(sorted(r for r in rows if r[0] == g), 1):
            assert got[row] == i


@pytest.mark.parametrize("limit", [4, 25])
def test_numbering_splits_crowded_slices_and_instants(spark, limit):
    rng = random.Random(limit)
    rows = [("a", 5 if rng.random() < 0.5 else rng.randrange(0, 4000), i) for i in range(400)] + [("b", 1, 1000)]
    df = spark.createDataFrame(rows, "g string, t long, tie long")
    tight = replace(DEFAULTS, slice_us=2000, slice_rows=limit)
    got = {(r.g, r.t, r.tie): r.n for r in number_within(df, ["g"], "t", "tie", "n", tight).collect()}
    for g in "ab":
        for i, row in enumerate(sorted(r for r in rows if r[0] == g), 1):
            assert got[row] == i


def brute_nearest(rows, samples):
    out = {}
    for key, g, t in rows:
        near = [s for s in samples if s[0] == g and s[1] is not None]
        out[key] = None if t is None or not near else min(near, key=lambda s: (abs(s[1] - t), s[1], s[2]))[2]
    return out


@pytest.mark.parametrize("width,limit", [(3, 1000), (10, 4), (1000, 50), (1000, 10**6)])
def test_nearest_equals_brute_force(spark, width, limit):
    rng = random.Random(width)
    rows = [(i, rng.choice("ab"), None if i % 40 == 0 else rng.randrange(-50, 400)) for i in range(300)]
    rows += [(1000, "none", 5)]
    samples = [(rng.choice("ab"), rng.randrange(0, 350), i) for i in range(60)] + [("a", None, 99)]
    left = spark.createDataFrame(rows, "id int, g string, t long")
    right = spark.createDataFrame(samples, "g string, st long, seq long")
    s = replace(DEFAULTS, slice_us=width, slice_rows=limit)
    got = nearest_join(left, right, ["g"], "t", "st", "seq", ["seq"], s)
    assert {r.id: r.seq for r in got.collect()} == brute_nearest(rows, samples)


def test_nearest_tie_goes_to_the_earlier(spark):
    left = spark.createDataFrame([(1, "a", 10)], "id int, g string, t long")
    right = spark.createDataFrame([("a", 12, 1), ("a", 8, 2)], "g string, st long, seq long")
    assert nearest_join(left, right, ["g"], "t", "st", "seq", ["seq"], SMALL).first().seq == 2


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_equal_numpy(spark, n, monkeypatch):
    import stintwise.operators.quantiles as q

    monkeypatch.setattr(q, "FEW", 10)
    monkeypatch.setattr(q, "CELLS", 8)
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.4, 1.5, rng.normal(size=n) * 10)  # one value holds many rows
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert exact_quantiles(df, "x", probs) == pytest.approx(list(np.quantile(x, probs)))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_lookup_beyond_the_limit_is_salted_and_complete(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    tight = replace(DEFAULTS, lookup_max_rows=3)
    _, pinned = pin_small(table, tight)
    assert pinned is False
    want = sorted(tuple(r) for r in rows.join(table, "k", "left").select("k", "v", "w").collect())
    assert sorted(tuple(r) for r in attach(rows, table, ["k"], "left", tight).select("k", "v", "w").collect()) == want
    inner = join_pinned(rows, table, False, ["k"], "inner")
    assert inner.count() == rows.join(table, "k").count()
    assert attach(rows, table, ["k"]).count() == 1000
