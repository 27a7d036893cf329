"""The trees of a fitted forest as rows, and scoring by them.

A fitted forest becomes one row per node: (tree, node, feature, threshold, left, right, value, gain,
rows). A row of the table says how training rows part there, and what would be predicted if the
tree ended there. So one table answers for every shallower depth and for every shorter run of trees,
and where each training row ended is a count by node. Rows are scored in one projection: the table
is small (trees x 2^(depth + 1) rows at most, whatever the data), is sent to the tasks a run of trees
at a time, so that the driver holds no more, and is walked for all trees at once. A larger forest is
walked in several passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from math import prod

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.lookup import scratch_path, settle

MOST_NODES = 4_000_000  # walked by a task in one pass; 40 bytes each
SENT = 262_144  # nodes that the driver holds at once, to send them
CELLS = 1_000_000  # rows x trees walked at a time
MOST_KNOWN = 1_000_000  # cells whose answer a task keeps, some 24 bytes each
FEATURES = "_features"


def node_table(forest) -> DataFrame:
    """The nodes of a fitted Spark forest, as it stores them, with `rows` null. Indicators part by
    a set of categories there; here by the threshold between 0 and 1, like numbers."""
    sc_path = scratch_path(forest_session(forest))
    forest.write().save(sc_path)
    stored = forest_session(forest).read.parquet(f"{sc_path}/data")
    n = F.col("nodeData")
    split = n["split"]
    is_flag = split["numCategories"] >= 0
    swap = is_flag & (F.get(split["leftCategoriesOrThreshold"], 0) == 1.0)
    inner = n["leftChild"] >= 0
    child = lambda side: F.when(inner, side).cast("int")
    return settle(
        stored.select(
            F.col("treeID").cast("int").alias("tree"),
            n["id"].cast("int").alias("node"),
            F.when(inner, split["featureIndex"]).cast("int").alias("feature"),
            F.when(inner, F.when(is_flag, F.lit(0.5)).otherwise(F.get(split["leftCategoriesOrThreshold"], 0))).alias("threshold"),
            child(F.when(swap, n["rightChild"]).otherwise(n["leftChild"])).alias("left"),
            child(F.when(swap, n["leftChild"]).otherwise(n["rightChild"])).alias("right"),
            n["prediction"].alias("value"),
            F.when(inner, n["gain"]).alias("gain"),
            n["rawCount"].cast("long").alias("drawn"),
            F.lit(None).cast("long").alias("rows"),
        )
    )


def forest_session(forest):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass(frozen=True)
class Run:
    """Some trees, one behind another: children are positions, and a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    tree: np.ndarray
    node: np.ndarray
    first: int = 0  # trees before these

    @staticmethod
    def of(table: pd.DataFrame) -> Run:
        t = table.sort_values(["tree", "node"], ignore_index=True)
        tree = t["tree"].to_numpy()
        start = np.nonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))[0]
        base = np.repeat(start, np.diff(np.concatenate([start, [len(t)]])))
        own = np.arange(len(t))
        leaf = t["left"].isna().to_numpy()
        at = lambda c: np.where(leaf, own, base + t[c].fillna(0).to_numpy(dtype=np.int64)).astype(np.int32)
        return Run(
            start.astype(np.int32),
            t["feature"].fillna(0).to_numpy(dtype=np.int32),
            t["threshold"].fillna(0.0).to_numpy(dtype=np.float64),
            at("left"),
            at("right"),
            t["value"].to_numpy(dtype=np.float64),
            t["rows"].fillna(0).to_numpy(dtype=np.int64),
            tree,
            t["node"].to_numpy(),
        )

    def step(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One level down, for each row (of `x`) and tree."""
        seen = np.take_along_axis(x, self.feature[at], axis=1)
        return np.where(seen <= self.threshold[at], self.left[at], self.right[at])

    def start(self, n: int) -> np.ndarray:
        return np.broadcast_to(self.roots, (n, len(self.roots)))

    @cached_property
    def children(self) -> np.ndarray:
        return np.stack([self.left, self.right], axis=1).ravel()

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        """The thresholds of each input, ascending, up to the last input that parts any rows."""
        inner = self.left != self.right
        return [np.unique(self.threshold[inner & (self.feature == f)]) for f in range(self.feature[inner].max(initial=-1) + 1)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row and tree. A tree at a time, so that its nodes stay in the cache."""
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        out = np.empty((len(self.roots), len(x)), dtype=np.int32)
        for i, root in enumerate(self.roots):
            below, at = np.full(len(x), root, dtype=np.int32), None
            while at is None or not np.array_equal(at, below):
                at = below
                left = flat.take(row + self.feature.take(at)) <= self.threshold.take(at)
                below = self.children.take(2 * at + ~left)
            out[i] = at
        return np.ascontiguousarray(out.T)


@dataclass(frozen=True)
class Joined:
    """Runs that a task walks together."""

    runs: list[Run]

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        each = [r.cuts for r in self.runs]
        wide = range(max(map(len, each), default=0))
        return [np.unique(np.concatenate([c[f] for c in each if f < len(c)])) for f in wide]

    def blocks(self, rows: pd.Series):
        """The inputs of some rows at a time."""
        size = max(1, CELLS // max(sum(len(r.roots) for r in self.runs), 1))
        for a in range(0, len(rows), size):
            yield np.stack(rows.iloc[a : a + size].to_list()).astype(np.float64, copy=False)


@dataclass(frozen=True)
class Pass:
    """Trees that are walked together, as they are sent: in runs of at most SENT nodes, or of one tree."""

    trees: int
    sent: tuple[Broadcast, ...]

    def read(self) -> Joined:
        """In a task."""
        return Joined([b.value for b in self.sent])

    def release(self) -> None:
        for b in self.sent:
            b.destroy()


class Answers:
    """What a run, or several, give for rows. Rows in the same cell, between the same thresholds of every input,
    end in the same leaves, so a task walks the trees once per cell, as far as it can keep the
    cells. Where cells can't be numbered by 62 bits every row is walked."""

    def __init__(self, run: Run | Joined, walk: Callable[[Run | Joined, np.ndarray], np.ndarray]):
        self.run, self.walk = run, walk
        self.numbered = prod(len(c) + 1 for c in run.cuts) <= 2**62
        self.cells, self.values = np.empty(0, dtype=np.int64), None

    def cell(self, x: np.ndarray) -> np.ndarray:
        number = np.zeros(len(x), dtype=np.int64)
        for f, cuts in enumerate(self.run.cuts):
            number = number * (len(cuts) + 1) + np.searchsorted(cuts, x[:, f])
        return number

    def of(self, x: np.ndarray) -> np.ndarray:
        if not self.numbered:
            return self.walk(self.run, x)
        asked, first, place = np.unique(self.cell(x), return_index=True, return_inverse=True)
        at = np.searchsorted(self.cells, asked)
        is_new = np.ones(len(asked), dtype=bool)
        is_new[at < len(self.cells)] = self.cells[at[at < len(self.cells)]] != asked[at < len(self.cells)]
        if not is_new.any():
            return self.values[at][place]
        walked = self.walk(self.run, x[first[is_new]])
        found = np.empty((len(asked), walked.shape[1]))
        found[is_new] = walked
        if not is_new.all():
            found[~is_new] = self.values[at[~is_new]]
        if len(self.cells) + len(walked) <= MOST_KNOWN:
            self.values = walked if self.values is None else np.insert(self.values, at[is_new], walked, axis=0)
            self.cells = np.insert(self.cells, at[is_new], asked[is_new])
        return found[place]


def runs(table: DataFrame) -> list[Pass]:
    """The table as passes over whole trees of at most MOST_NODES nodes, or over one tree."""
    sizes = [(r["tree"], r["n"]) for r in table.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()]  # a row per tree
    passes, held, last = [], 0, 0
    for tree, n in sizes:
        if not passes or held + n > MOST_NODES:
            passes.append([])
            held = last = 0
        if not passes[-1] or last + n > SENT:
            passes[-1].append([])
            last = 0
        passes[-1][-1].append(tree)
        held, last = held + n, last + n
    number = {tree: i for i, (tree, _) in enumerate(sizes)}

    def sent(trees: list[int]) -> Broadcast:
        some = table.filter(F.col("tree").between(trees[0], trees[-1]))
        run = replace(Run.of(some.toArrow().to_pandas()), first=number[trees[0]])  # SENT nodes at most, or a tree
        return table.sparkSession.sparkContext.broadcast(run)

    return [Pass(sum(map(len, p)), tuple(map(sent, p))) for p in passes]


def summed(rows: DataFrame, parts: list[Pass], walk) -> DataFrame:
    """Adds `_sums`: over all runs, the sum of `walk(run, x)`, which gives some numbers a row.
    Several passes are walked one after another, each reading what the last one wrote."""

    def column(part: Pass) -> Column:
        @F.pandas_udf("array<double>")
        def sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            joined = part.read()
            answers = Answers(joined, lambda j, x: sum(walk(run, x) for run in j.runs))
            for x in batches:
                found = [answers.of(b) for b in joined.blocks(x)]
                yield pd.Series(list(np.concatenate(found)) if found else [], dtype=object)

        return sums(F.col(FEATURES))

    out = rows.withColumn("_sums", column(parts[0]))
    for part in parts[1:]:
        out = settle(out).withColumn("_more", column(part))
        out = out.withColumn("_sums", F.zip_with("_sums", "_more", lambda a, b: a + b)).drop("_more")
    return out


def score(rows: DataFrame, parts: list[Pass]) -> DataFrame:
    """Adds `_value`, the mean of the leaves' values, and `_rows`, that of their training rows."""
    trees = float(sum(p.trees for p in parts))

    def walk(run: Run, x: np.ndarray) -> np.ndarray:
        at = run.leaves(x)
        return np.stack([run.value[at].sum(1), run.rows[at].sum(1)], axis=1)

    out = summed(rows, parts, walk)
    return out.withColumns({"_value": F.get("_sums", 0) / trees, "_rows": F.get("_sums", 1) / trees}).drop("_sums")


def score_shorter(rows: DataFrame, parts: list[Pass], depths: list[int], counts: list[int]) -> DataFrame:
    """Adds `_values`: for each of `depths` and `counts`, in that order, the prediction of the
    first so many trees, ended at that depth."""

    def walk(run: Run, x: np.ndarray) -> np.ndarray:
        at, found = run.start(len(x)), {}
        for depth in range(1, max(depths) + 1):
            at = run.step(x, at)
            if depth in depths:
                found[depth] = run.value[at]
        inside = [min(max(c - run.first, 0), len(run.roots)) for c in counts]
        return np.stack([found[d][:, :k].sum(1) / c for d in depths for k, c in zip(inside, counts)], axis=1)

    return summed(rows, parts, walk).withColumnRenamed("_sums", "_values")


def with_rows(table: DataFrame, parts: list[Pass], encoded: DataFrame) -> DataFrame:
    """The table with the number of rows of `encoded` that end at each node. A task counts its own
    rows first."""
    counted = None
    for part in parts:

        def count(batches, part=part):
            joined = part.read()
            totals = [np.zeros(len(run.node), dtype=np.int64) for run in joined.runs]
            for pdf in batches:
                for x in joined.blocks(pdf[FEATURES]):
                    for run, total in zip(joined.runs, totals):
                        total += np.bincount(run.leaves(x).ravel(), minlength=len(total))
            for run, total in zip(joined.runs, totals):
                at = np.nonzero(total)[0]
                yield pd.DataFrame({"tree": run.tree[at], "node": run.node[at], "n": total[at]})

        one = encoded.select(FEATURES).mapInPandas(count, "tree int, node int, n long")
        counted = one if counted is None else counted.unionByName(one)
    sums = counted.groupBy("tree", "node").agg(F.sum("n").alias("n"))
    joined = table.drop("rows").join(sums, ["tree", "node"], "left")
    return settle(joined.withColumn("rows", F.coalesce("n", F.lit(0))).drop("n"))


def importance_by_feature(table: DataFrame) -> DataFrame:
    """(feature, importance): each split's gain by the rows drawn there, as shares within its tree,
    averaged over the trees and made shares again."""
    gains = table.filter("left is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("drawn")).alias("g"))
    whole = gains.groupBy("tree").agg(F.sum("g").alias("whole"))
    shares = gains.join(whole, "tree").filter("whole > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("whole")).alias("s"))
    total = shares.agg(F.sum("s").alias("total"))
    sums = total.first()["total"]  # one number
    return shares.select("feature", (F.col("s") / F.lit(sums or 1.0)).alias("importance"))
