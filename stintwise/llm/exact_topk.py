"""Exact top-k by inner product through a pivot-distance index.

Vectors are turned into integers and given one more coordinate, sqrt(M^2 - |x|^2), with M the
largest length: the largest inner product is then the smallest distance. Every vector is keyed by
its nearest pivot and by the ring (range of distances) it lies in. A query first visits the rings
around its own place until they hold enough vectors, which gives it a k-th score; the triangle
inequality then bounds the score that any other ring can hold, and only rings that may still
matter are visited. Scores are integers, so the result is exact.

Pivots and ring borders are fitted on a bounded sample (`fit_rows`); every row is indexed. The
table of rings has pivots x rings rows at most; a crowded ring is split in parts, and so is a
crowded set of queries, so no task holds more than `block_rows` of either.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; a
shorter vector counts as padded with zeros; rows without an id take no part; rows that repeat an
id and vector count once, and a row is never a candidate for its own id; an empty table gives an
empty result; other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.lookup import settle

SCALE = 1024


@dataclass(frozen=True)
class IndexSpec:
    pivots: int = 16
    rings: int = 8
    fit_rows: int = 4096
    block_rows: int = 4096


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e")).filter(F.col("id").isNotNull() & F.col("e").isNotNull())
    return usable.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))).select(
        "id", F.transform("e", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))).alias("v")
    )


def matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where these are exact, else by integers."""
    largest = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(x).max(initial=0))) * max(1, q.shape[1])
    if largest < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    most = 2**63 - 1  # a score beyond 64 bits becomes the largest or smallest there is
    return np.clip(q.astype(object) @ x.astype(object).T, -most, most).astype(np.int64)


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


class Places:
    """Pivots and ring borders, fitted on the sample; small, so tasks get a copy."""

    def __init__(self, sample: np.ndarray, top: float, dim: int, spec: IndexSpec):
        x = lifted(sample, top)
        chosen = [0]
        nearest = distances(x, x[:1])[:, 0]
        while len(chosen) < min(spec.pivots, len(x)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))  # farthest first
            nearest = np.minimum(nearest, distances(x, x[chosen[-1:]])[:, 0])
        pivots = x[chosen]
        for _ in range(5):  # a few rounds of means, so that pivots lie amid the vectors
            own = distances(x, pivots).argmin(1)
            pivots = np.stack([x[own == p].mean(0) if (own == p).any() else pivots[p] for p in range(len(pivots))])
        d = distances(x, pivots)
        own = d.argmin(1)
        steps = np.linspace(0, 1, spec.rings + 1)[1:-1]
        self.pivots, self.top, self.dim, self.rings = pivots, top, dim, spec.rings
        self.borders = np.stack([np.quantile(d[own == p, p], steps) if (own == p).any() else np.zeros(len(steps)) for p in range(len(pivots))])

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = distances(lifted(v, self.top), self.pivots)
        own = d.argmin(1)
        at = d[np.arange(len(v)), own]
        return own, (self.borders[own] <= at[:, None]).sum(1), at


def indexed(vectors: DataFrame, places: Places) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                v = matrix(pdf["v"], places.dim)
                pivot, ring, at = places.place(v)
                yield pd.DataFrame({"id": pdf["id"], "pivot": pivot.astype(np.int32), "ring": ring.astype(np.int32), "at": at, "x": [r.tobytes() for r in v]})

    return vectors.mapInPandas(run, "id long, pivot int, ring int, at double, x binary")


def visits(queries: DataFrame, places: Places, table: pd.DataFrame, k: int, later: bool) -> DataFrame:
    """(id, x, floor, pivot, ring) per ring that a query visits. First: the rings around its own
    place, nearest first, until they hold k vectors besides itself. Later: all others whose bound
    reaches the query's k-th score so far."""
    p, r, n = (table[c].to_numpy() for c in ("pivot", "ring", "n"))
    low, high = table["low"].to_numpy(), table["high"].to_numpy()

    def first_and_bound(v: np.ndarray):
        d = distances(np.column_stack([v.astype(np.float64), np.zeros(len(v))]), places.pivots)[:, p]
        gap = np.maximum(0.0, np.maximum(d - high, low - d))
        order = np.argsort(gap, axis=1, kind="stable")
        held = np.cumsum(n[order], axis=1)
        use = np.zeros_like(gap, dtype=bool)
        np.put_along_axis(use, order, (held - n[order]) < k + 1, axis=1)
        square = (v.astype(np.float64) ** 2).sum(1)
        return use, (square[:, None] + places.top - gap * gap) / 2

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack([np.frombuffer(b, dtype=np.int64) for b in pdf["x"]])
            use, bound = first_and_bound(v)
            if later:
                slack = 1e-6 * max(1.0, places.top)
                floor = pdf["floor"].to_numpy(dtype=np.float64)  # NaN: fewer than k so far
                use = ~use & ~(bound + slack < floor[:, None])
            i, j = np.nonzero(use)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "x": pdf["x"].to_numpy()[i], "floor": pdf["floor"].to_numpy()[i], "pivot": p[j].astype(np.int32), "ring": r[j].astype(np.int32)})

    return queries.mapInPandas(run, "id long, x binary, floor long, pivot int, ring int")


def dealt(visit: DataFrame, index: DataFrame, parts: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Visits and vectors by blocks. A ring's vectors are copied once for each `block_rows` of the
    queries that visit the ring; those of a ring that none visits are left out before the shuffle."""
    asking = visit.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("qparts"))
    # A row per ring at most, so it can be broadcast.
    rings = visit.sparkSession.createDataFrame(parts.join(asking, ["pivot", "ring"]).toArrow(), "pivot int, ring int, parts int, qparts int")
    asked = visit.join(F.broadcast(rings), ["pivot", "ring"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("qparts")).cast("int").alias("qpart")
    )
    visited = index.join(F.broadcast(rings.drop("parts")), ["pivot", "ring"])
    return asked, visited.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))


def scored(visit: DataFrame, index: DataFrame, parts: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score): per visited block the k best that reach the query's floor."""
    asked, held = dealt(settle(visit), index, parts, block_rows)
    key = ["pivot", "ring", "part", "qpart"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.drop_duplicates(["id", "x"]).sort_values("id", kind="stable")
            x = np.stack([np.frombuffer(b, dtype=np.int64) for b in right["x"]])
            ids = right["id"].to_numpy()
            for at in range(0, len(left), 256):
                some = left.iloc[at : at + 256]
                q = np.stack([np.frombuffer(b, dtype=np.int64) for b in some["x"]])
                s = products(q, x)
                for i, (qid, floor) in enumerate(zip(some["id"], some["floor"])):
                    ok = ids != qid
                    if not pd.isna(floor):
                        ok &= s[i] >= floor
                    cand = np.nonzero(ok)[0]
                    if len(cand) > k:  # ids ascend, so a stable sort leaves ties to the smaller id
                        cand = cand[np.argsort(-s[i][cand], kind="stable")[:k]]
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[cand], "score": s[i][cand]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    grouped = asked.select("id", "x", "floor", *key).groupBy(*key)
    return grouped.cogroup(held.select("id", "x", *key).groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked. A query has k rows per visited block at most."""
    one = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, spec: IndexSpec = IndexSpec()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (id, v) where `is_query` holds,
    against all rows."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top, dim, n_queries = vectors.agg(F.max(length), F.max(F.size("v")), F.count_if(is_query)).first()
    if not n_queries or dim is None:
        return none
    dim = max(1, dim)
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(spec.fit_rows).toPandas()
    places = Places(matrix(sample["v"], dim), float(top), dim, spec)
    placed = indexed(vectors, places)
    table = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).toPandas()
    table["parts"] = (-(-table["n"] // spec.block_rows)).astype("int32")
    parts = spark.createDataFrame(table[["pivot", "ring", "parts"]], "pivot int, ring int, parts int")
    index = placed.join(F.broadcast(parts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    queries = indexed(vectors.filter(is_query), places).select("id", "x", F.lit(None).cast("long").alias("floor")).distinct()
    near = scored(visits(queries, places, table, k, later=False), index, parts, k, spec.block_rows)
    near = settle(best(near, k).select("query_id", "vec_id", "score", "rank"))
    floors = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    again = queries.drop("floor").join(floors, "id", "left").select("id", "x", "floor")
    rest = scored(visits(again, places, table, k, later=True), index, parts, k, spec.block_rows)
    return best(near.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
