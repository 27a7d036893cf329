import math

import numpy as np
from pyspark.sql import functions as F

from stintwise.llm import exact_topk as E


def brute(vectors, k):
    ints = {i: np.array([math.floor(x * 1024) for x in v], dtype=object) for i, v in vectors}
    out = []
    for q in sorted(i for i in ints if i % 3 == 0):
        s = sorted((-int(np.dot(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


def run(spark, rows, k=4, **spec):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = E.top_k(E.integer_vectors(frame), F.col("id") % 3 == 0, k, E.IndexSpec(**spec))
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_agrees_with_all_products(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 340)]  # many equal ones
    rows = [(i, v, "x") for i, v in vectors]
    assert run(spark, rows, pivots=5, rings=4, fit_rows=100, block_rows=32) == brute(vectors, 4)


def test_large_components_stay_exact(spark):
    vectors = [(i, [1e6 + i * 0.001, -3e4 * i, 7.0]) for i in range(12)]
    assert run(spark, [(i, v, None) for i, v in vectors]) == brute(vectors, 4)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [0.5, None], "a"), (2, None, "a"), (3, [float("nan"), 1.0], "a"), (None, [1.0, 1.0], "a"), (4, [0.25, 0.5], "a"), (5, [float("inf"), 0.0], "a")]
    assert run(spark, rows) == [(0, 1, 4, 1024 * 256)]
    assert run(spark, []) == []


def test_visits_can_stop_early(spark):
    """Far groups are never visited: the bound of their rings is too low."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(50, 4)) * 0.01 + 10 * c for c in np.eye(4)])
    ints = np.floor(v * 1024).astype(np.int64)
    top = float((ints.astype(float) ** 2).sum(1).max())
    places = E.Places(ints, top, 4, E.IndexSpec(pivots=4, rings=2))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(ints)], "id long, v array<long>")
    placed = E.indexed(frame, places)
    table = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).toPandas()
    query = placed.filter("id = 0").select("id", "x", F.lit(int((ints[0] * ints[1]).sum())).alias("floor"))
    seen = E.visits(query, places, table, 3, False).unionByName(E.visits(query, places, table, 3, True))
    assert 0 < seen.select("pivot", "ring").distinct().count() <= len(table) // 2


def test_only_visited_rings_are_copied(spark):
    index = spark.createDataFrame([(i, i % 4, 0, i % 2) for i in range(40)], "id long, pivot int, ring int, part int")
    parts = spark.createDataFrame([(p, 0, 2) for p in range(4)], "pivot int, ring int, parts int")
    visit = spark.createDataFrame([(100 + i, 0, 0) for i in range(5)] + [(200, 1, 0)], "id long, pivot int, ring int")
    asked, held = E.dealt(visit, index, parts, 2)
    assert sorted((r["pivot"], r["n"]) for r in held.groupBy("pivot").agg(F.count("*").alias("n")).collect()) == [(0, 30), (1, 10)]
    assert asked.count() == 12 and {r["qpart"] for r in asked.filter("pivot = 1").collect()} == {0}
    none, left = E.dealt(visit.limit(0), index, parts, 2)
    assert none.count() == left.count() == 0
