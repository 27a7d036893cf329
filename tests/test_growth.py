"""Forests grown over sums by cell: against a plain tree, any order of rows, and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.operators import forest as RF
from stintwise.operators import growth as G
from stintwise.operators.evaluate import TARGET

SPEC = RF.ForestSpec(categorical=("tire_compound",), continuous=("tire_age_laps", "track_temp_c"), boolean=("is_raining",), trees=3, depth=3, min_leaf=4)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(1000).select(
        F.element_at(F.array(*map(F.lit, ("SOFT", "MEDIUM", "HARD"))), (i * 7 % 11 % 3 + 1).cast("int")).alias("tire_compound"),
        (i % 13).cast("double").alias("tire_age_laps"),
        (F.lit(20.0) + i * 5 % 17).alias("track_temp_c"),
        (i % 4 == 0).alias("is_raining"),
        F.lit(True).alias("is_valid_lap"),
        (i % 13 * 0.1 + i * 7 % 11 % 3 * 0.4 + F.sin(i * 1.7)).alias("lap_time_delta_s"),
    )


def plain_tree(x, y, w, depth, min_leaf):
    """(feature, threshold, value, gain, drawn) in the order in which nodes are made, by trying every value."""
    nodes, now = [None], [(0, w)]
    for level in range(depth + 1):
        following = []
        for at, v in now:
            n, mean = v.sum(), (v * y).sum() / v.sum()
            best = (0.0, None, None)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for t in (values[1:] + values[:-1]) / 2:
                    left = v * (x[:, f] <= t)
                    nl = left.sum()
                    if level == depth or nl < min_leaf or n - nl < min_leaf:
                        continue
                    a, b = (left * y).sum() / nl, ((v - left) * y).sum() / (n - nl)
                    gain = nl * (n - nl) / n**2 * (a - b) ** 2
                    if gain > best[0] + 1e-9:
                        best = (gain, f, t)
            nodes[at] = (best[1], best[2], mean, best[0], int(n))
            if best[1] is not None:
                left = x[:, best[1]] <= best[2]
                following += [(len(nodes), v * left), (len(nodes) + 1, v * ~left)]
                nodes += [None, None]
        now = following
    return nodes


def test_trees_equal_plain_ones_on_the_same_draws(rows, monkeypatch):
    drawn = {}
    real = G.drawn_sums

    def kept(indexed, design, target, trees, seed):
        drawn["rows"], drawn["design"] = indexed, design
        return real(indexed, design, target, trees, seed)

    monkeypatch.setattr(G, "drawn_sums", kept)
    model = RF.fit_forest(rows, SPEC)
    d = drawn["design"]
    pdf = drawn["rows"].select(*d.columns, TARGET).toPandas()
    codes = np.stack([pdf[c] if t is None else np.searchsorted(t, pdf[c]) for c, t in zip(d.columns, d.thresholds)], axis=1).astype(G.CODE)
    y = np.rint((pdf[TARGET].to_numpy() - d.base) / d.step).astype(np.int64)
    session = rows.sparkSession
    cells = session.createDataFrame([(i, c.tobytes(), int(v)) for i, (c, v) in enumerate(zip(codes, y))], "i int, cell binary, y long")
    each = cells.groupBy("cell", "y").agg(F.min("i").alias("i"), F.count("*").alias("n"), F.xxhash64("cell", "y").alias("key")).toPandas()
    w = G.draws(each["key"].to_numpy().view(np.uint64), each["n"].to_numpy(), SPEC.trees, SPEC.seed)
    at = each["i"].to_numpy()
    labels = d.widths[0]
    x = np.concatenate([pdf.iloc[:, :1].to_numpy() == np.arange(labels), pdf.iloc[:, 1:4].to_numpy()], axis=1).astype(float)[at]
    for tree in range(SPEC.trees):
        want = plain_tree(x, pdf[TARGET].to_numpy()[at], w[:, tree], SPEC.depth, SPEC.min_leaf)
        got = model.nodes.filter(F.col("tree") == tree).orderBy("node").collect()
        assert len(got) == len(want) > 7
        for g, (feature, cut, value, gain, n) in zip(got, want):
            assert (g.feature, g.threshold, g.drawn) == (feature, cut, n)
            assert (g.value, g.gain or 0.0) == pytest.approx((value, gain), abs=1e-9)


def test_a_fit_does_not_depend_on_the_order_of_rows(rows):
    one, other = (RF.fit_forest(r, SPEC).nodes.orderBy("tree", "node").collect() for r in (rows, rows.orderBy(F.rand(3)).repartition(5)))
    assert one == other


def test_repeated_rows_add_no_cells(rows):
    """What the levels read grows with the cells in use, not with the rows."""

    def size(df):
        sums = RF.drawn(RF.training_frame(df, SPEC), SPEC)[2]
        one = sums.filter("chunk = 0")
        return one.agg(F.sum(F.length("w"))).first()[0], sum(np.frombuffer(r.n, dtype=np.int64).sum() for r in one.collect())

    many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("_copy")
    (cells, n), (cells_many, n_many) = size(rows), size(many)
    assert n_many == 200 * n and cells_many <= 2 * cells


def test_draws_are_poisson_and_the_first_trees_are_a_smaller_forest():
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(7919)
    for copies in (1, 5, 100):
        w = G.draws(keys, np.full(len(keys), copies), 8, 42)
        assert w.mean() == pytest.approx(copies, rel=0.02) and w.var() == pytest.approx(copies, rel=0.06)
        assert abs(np.corrcoef(w.T)[0, 1:]).max() < 0.06
        few = G.draws(keys, np.full(len(keys), copies), 3, 42)
        assert copies > G.COPIES or (few == w[:, :3]).all()
