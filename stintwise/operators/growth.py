"""Growing a forest level by level over rows that are summed by cell.

A cell is what a tree can tell apart: the bins of a row's inputs. Each tree draws every training row
Poisson(1) times, from a hash of the row, so a fit depends on neither order nor partitions. The
draws are summed once per cell and tree, and the levels read those sums: they grow with the cells
in use, not with the rows. A level is one shuffle: tasks count their cells by (tree, node, input,
bin), the counts of a few nodes meet in a group, and a row per node, its best split, comes back.
Trees grow in groups whose nodes the driver can hold, whatever the size of the forest.
Targets are whole multiples of a small step, so that all sums are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, factorial, log2

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.operators.lookup import scratch_path, settle

CHUNKS = 32  # runs of trees, each a row of sums per block of cells
BLOCK = 1024  # cells: with a run's sums, a row of some 100 kB
GATHERED = 131_072  # cells that a task counts together
ROW_GROUP = 16 << 20  # bytes of sums that a task reads at once
PIECE = 64  # nodes of a tree whose counts meet in a group
AT_ONCE = 4096  # nodes of a tree counted in one pass
COPIES = 64  # equal rows drawn one by one
GROWN = 1_048_576  # nodes that the driver holds while their trees grow, some 50 bytes each
WRITTEN = 262_144  # nodes that the driver writes at once
CODE = np.dtype(">u2")
U = np.uint64
#: Draws by 16 random bits.
POISSON = np.searchsorted(np.cumsum([np.exp(-1.0) / factorial(k) for k in range(12)]), (np.arange(65536) + 0.5) / 65536).astype(np.int32)


@dataclass(frozen=True)
class Design:
    """How inputs become bins. An input has thresholds, or None and as many indicators as labels."""

    columns: tuple[str, ...]
    thresholds: tuple[np.ndarray | None, ...]
    widths: tuple[int, ...]  # bins of each input
    base: float
    step: float
    rows: int

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths)]).astype(np.int64)

    @property
    def firsts(self) -> np.ndarray:
        """Place of each input in the vector of a fit: an indicator per label, or the number."""
        return np.concatenate([[0], np.cumsum([w if t is None else 1 for t, w in zip(self.thresholds, self.widths)])]).astype(np.int64)


def thresholds(rows: DataFrame, column: str, bins: int) -> np.ndarray:
    """Between all values where there are at most `bins` of them, else at quantiles."""
    found = sorted(r[0] for r in rows.select(column).distinct().limit(bins + 1).collect())  # bins + 1 numbers
    if len(found) <= bins:
        v = np.array(found, dtype=np.float64)
        return (v[1:] + v[:-1]) / 2
    return np.unique(rows.approxQuantile(column, [i / bins for i in range(1, bins)], 0.001))


def design(rows: DataFrame, labels: dict[str, int], numbers: list[str], target: str, bins: int) -> Design:
    """`labels`: columns of label numbers, with the number of labels; `numbers`: columns of doubles."""
    a = rows.agg(F.count("*").alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if not a["n"]:
        raise ValueError("no rows to fit a forest on")
    steps = 2.0 ** (49 - ceil(log2(a["n"] + 1)))
    cuts = [thresholds(rows, c, bins) for c in numbers]
    return Design(
        (*labels, *numbers), (*[None] * len(labels), *cuts), (*labels.values(), *[len(c) + 1 for c in cuts]),
        a["lo"], ((a["hi"] - a["lo"]) or 1.0) / steps, a["n"],
    )


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def draws(keys: np.ndarray, copies: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree (columns) draws each of some rows, which stand for `copies` equal ones."""
    runs = mixed((np.arange((trees + 3) // 4, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))
    out = np.zeros((len(keys), trees), dtype=np.int32)
    few = np.nonzero(copies <= COPIES)[0]
    for j in range(int(copies[few].max(initial=0))):
        now = few[copies[few] > j]
        copy = np.full(1, j, dtype=U) * U(0xD1B54A32D192ED03)
        bits = mixed(mixed(keys[now] + copy)[:, None] ^ runs[None, :])
        out[now] += POISSON[bits.astype("<u8").view("<u2")[:, :trees]]
    for i in np.nonzero(copies > COPIES)[0]:
        out[i] = np.random.default_rng([seed, int(keys[i])]).poisson(int(copies[i]), trees)
    return out


SUMS = "chunk int, x binary, n binary, w binary, s binary"


def chunk_size(trees: int) -> int:
    return ceil(trees / CHUNKS)


def drawn_sums(rows: DataFrame, d: Design, target: str, trees: int, seed: int) -> DataFrame:
    """Per run of trees, blocks of cells: their bins, rows, and sums of draws and drawn targets."""

    @F.pandas_udf("binary")
    def cell(*columns: pd.Series) -> pd.Series:
        codes = np.empty((len(columns[0]), len(columns)), dtype=CODE)
        for i, (c, t) in enumerate(zip(columns, d.thresholds)):
            codes[:, i] = c.to_numpy() if t is None else np.searchsorted(t, c.to_numpy())
        raw, w = codes.tobytes(), codes.itemsize * codes.shape[1]
        return pd.Series([raw[a : a + w] for a in range(0, len(raw), w)])

    whole = F.round((F.col(target) - d.base) / d.step).cast("long").alias("y")
    each = rows.select(cell(*d.columns).alias("cell"), whole).groupBy("cell", "y").agg(F.count("*").alias("n"))
    near = each.withColumn("key", F.xxhash64("cell", "y")).repartitionByRange("cell", "y").sortWithinPartitions("cell", "y")
    size = chunk_size(trees)

    def run(batches):
        held, cells = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            for a in range(0, len(pdf), BLOCK):
                held.append(summed(pdf.iloc[a : a + BLOCK]))
                cells += len(held[-1][0])
                if cells >= BLOCK:
                    yield block(held)
                    held, cells = [], 0
        if held:
            yield block(held)

    def summed(pdf):
        x = np.frombuffer(b"".join(pdf["cell"]), dtype=CODE).reshape(len(pdf), -1)
        n = pdf["n"].to_numpy()
        at = np.nonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))[0]
        w = draws(pdf["key"].to_numpy().view(U), n, trees, seed)
        s = np.add.reduceat(w * pdf["y"].to_numpy(dtype=np.float64)[:, None], at, axis=0)
        return x[at].astype(np.uint16), np.add.reduceat(n, at), np.add.reduceat(w, at, axis=0, dtype=np.int32), s

    def block(held):
        x, n, w, s = (np.concatenate(part) for part in zip(*held))
        cuts = range(0, trees, size)
        flat = lambda m, a: np.ascontiguousarray(m[:, a : a + size]).tobytes()
        return pd.DataFrame({
            "chunk": range(len(cuts)), "x": x.tobytes(), "n": n.astype(np.int64).tobytes(),
            "w": [flat(w, a) for a in cuts], "s": [flat(s, a) for a in cuts],
        })

    # By the run's own number: no pass over the draws only to find ranges of it.
    return settle(near.mapInPandas(run, SUMS).repartitionById(len(range(0, trees, size)), "chunk"), **{"parquet.block.size": ROW_GROUP})


@dataclass
class Tree:
    """Nodes of a tree while it grows; a leaf is its own child, with `active` its place in the pass."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    active: np.ndarray | None = None


def places(tree: Tree, x: np.ndarray, is_label: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row of `x`, at most `depth` levels down."""
    flat, row = x.ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), dtype=np.int32)
    for _ in range(depth):
        f, b = tree.feature[at], tree.bin[at]
        v = flat[row + f]
        at = np.where(np.where(is_label[f], v == b, v > b), tree.right[at], tree.left[at])
    return at


def blocks(batches, columns: int, size: int, trees: int):
    """(first tree, x, n, w, s) of the sums, some rows of a run of trees together."""
    held, cells, chunk = [], 0, None

    def gathered():
        return chunk * size, *(np.concatenate(part) for part in zip(*held))

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if held and (r.chunk != chunk or cells >= GATHERED):
                yield gathered()
                held, cells = [], 0
            chunk = r.chunk
            k = min(size, trees - chunk * size)
            n = np.frombuffer(r.n, dtype=np.int64)
            numbers = lambda raw, t: np.frombuffer(raw, dtype=t).reshape(-1, k)
            held.append((np.frombuffer(r.x, dtype=np.uint16).reshape(-1, columns), n, numbers(r.w, np.int32), numbers(r.s, np.float64)))
            cells += len(n)
    if held:
        yield gathered()


def counted(sums: DataFrame, d: Design, sent: Broadcast, trees: int, depth: int) -> DataFrame:
    """(tree, piece, w, s): draws and drawn targets by active node, input and bin, as far as one task saw
    them, of the trees that were sent by number."""
    starts, is_label = d.starts, np.array([t is None for t in d.thresholds])
    width, size = int(starts[-1]), chunk_size(trees)

    def run(batches):
        now, held, chunk = sent.value, {}, None
        for first, x, _, w, s in blocks(batches, len(d.columns), size, trees):
            if first != chunk:
                yield from out(held)
                held, chunk = {}, first
            for i in range(w.shape[1]):
                tree = now.get(first + i)
                n_active = int(tree.active.max()) + 1 if tree else 0
                if not n_active:
                    continue
                node = tree.active[places(tree, x, is_label, depth)]
                use = np.nonzero((node >= 0) & (w[:, i] > 0))[0]
                if not len(use):
                    continue
                if first + i not in held:
                    held[first + i] = np.zeros((2, n_active, width))
                node = node[use].astype(np.int64)
                for f, (a, b) in enumerate(zip(starts, starts[1:])):  # an input at a time: its keys and counts are small
                    key = node * (b - a) + x[use, f]
                    for total, part in zip(held[first + i], (w, s)):
                        total[:, a:b] += np.bincount(key, part[use, i], n_active * (b - a)).reshape(n_active, b - a)
        yield from out(held)

    def out(held):
        for tree, total in held.items():
            cuts = range(0, total.shape[1], PIECE)
            yield pd.DataFrame({
                "tree": tree, "piece": range(len(cuts)),
                "w": [total[0, a : a + PIECE].astype(np.int64).tobytes() for a in cuts],
                "s": [total[1, a : a + PIECE].tobytes() for a in cuts],
            })

    return sums.mapInPandas(run, "tree int, piece int, w binary, s binary")


BEST = "tree int, slot int, w double, s double, feature int, bin int, gain double, left_w double, left_s double"


def best_splits(counts: DataFrame, d: Design, min_leaf: int) -> DataFrame:
    """A row per active node: its draws and sum, and the split that lowers the variance most, the
    first of equal ones; feature -1 where none leaves `min_leaf` draws on both sides."""
    starts, cuts = d.starts, d.thresholds
    width = int(starts[-1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = sum(np.frombuffer(r, dtype=np.int64) for r in pdf["w"]).reshape(-1, width).astype(np.float64)
        s = sum(np.frombuffer(r, dtype=np.float64) for r in pdf["s"]).reshape(-1, width)
        end = slice(starts[0], starts[1])
        n, total = w[:, end].sum(1), s[:, end].sum(1)
        left_w, left_s = np.zeros_like(w), np.zeros_like(s)
        for f, t in enumerate(cuts):
            here = slice(starts[f], starts[f + 1])
            if t is None:
                left_w[:, here], left_s[:, here] = n[:, None] - w[:, here], total[:, None] - s[:, here]
            else:
                left_w[:, here], left_s[:, here] = np.cumsum(w[:, here], axis=1), np.cumsum(s[:, here], axis=1)
        right_w, right_s = n[:, None] - left_w, total[:, None] - left_s
        ok = (left_w >= max(min_leaf, 1)) & (right_w >= max(min_leaf, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = left_s / left_w, right_s / right_w
            ok &= np.abs(a - b) > 1e-12 * np.maximum(np.abs(a), np.abs(b))
            gain = np.where(ok, left_w * right_w / n[:, None] ** 2 * ((a - b) * d.step) ** 2, 0.0)
        at, row = gain.argmax(1), np.arange(len(gain))
        feature = np.searchsorted(starts, at, side="right") - 1
        return pd.DataFrame({
            "tree": pdf["tree"].iloc[0], "slot": pdf["piece"].iloc[0] * PIECE + row, "w": n, "s": total,
            "feature": np.where(ok[row, at], feature, -1), "bin": at - starts[feature], "gain": gain[row, at],
            "left_w": left_w[row, at], "left_s": left_s[row, at],
        })

    return counts.groupBy("tree", "piece").applyInPandas(run, BEST)


class Growing:
    """A tree's nodes while it grows, on the driver."""

    def __init__(self):
        self.feature, self.bin = np.zeros(1, dtype=np.int16), np.zeros(1, dtype=np.uint16)
        self.left, self.right = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
        self.gain, self.w, self.s = np.zeros(1), np.full(1, np.nan), np.full(1, np.nan)
        self.open, self.rows = np.zeros(1, dtype=np.int32), None

    def split(self, nodes: np.ndarray, r: pd.DataFrame, min_leaf: int) -> np.ndarray:
        """Takes the splits found for `nodes`; returns the children that may part again."""
        self.w[nodes], self.s[nodes] = r["w"], r["s"]
        parts = r["feature"].to_numpy() >= 0
        at, r = nodes[parts], r[parts]
        made = len(self.w) + np.arange(2 * len(at), dtype=np.int32)
        self.feature[at], self.bin[at], self.gain[at] = r["feature"], r["bin"], r["gain"]
        self.left[at], self.right[at] = made[::2], made[1::2]
        pair = lambda c: np.stack([r[f"left_{c}"], r[c] - r[f"left_{c}"]], axis=1).ravel()
        w, s, none = pair("w"), pair("s"), np.zeros(len(made))
        for name, v in (("feature", none), ("bin", none), ("left", made), ("right", made), ("gain", none), ("w", w), ("s", s)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, v.astype(old.dtype)]))
        return made[w >= 2 * max(min_leaf, 1)]

    def tree(self, now: np.ndarray | None = None) -> Tree:
        if now is None:
            return Tree(self.feature, self.bin, self.left, self.right)
        active = np.full(len(self.w), -1, dtype=np.int32)
        active[now] = np.arange(len(now))
        return Tree(self.feature, self.bin, self.left, self.right, active)


def grown_together(d: Design, trees: int, depth: int, min_leaf: int) -> int:
    """Trees whose nodes the driver can hold, in whole runs of `drawn_sums` where it can hold one."""
    most = min(2 ** (depth + 1), 2 * ceil(d.rows / max(min_leaf, 1)) + 1)
    held, size = max(1, GROWN // most), chunk_size(trees)
    return held // size * size or held


def grow(sums: DataFrame, d: Design, trees: int, depth: int, min_leaf: int, support: bool = True) -> DataFrame:
    """The fitted forest as `nodes.node_table`, with the training rows that end at each leaf if
    `support` is asked for. The driver holds the nodes of some trees at a time and writes them."""
    path, size = scratch_path(sums.sparkSession), chunk_size(trees)
    step = grown_together(d, trees, depth, min_leaf)
    for a in range(0, trees, step):
        b = min(a + step, trees)
        own = sums.filter(F.col("chunk").between(a // size, (b - 1) // size))
        forest = {t: Growing() for t in range(a, b)}
        grow_some(own, d, forest, trees, depth, min_leaf)
        if support:
            count_leaf_rows(own, d, forest, trees, depth)
        write_nodes(sums.sparkSession, forest, d, path)
    return sums.sparkSession.read.schema(NODES).parquet(path)


def grow_some(sums: DataFrame, d: Design, forest: dict[int, Growing], trees: int, depth: int, min_leaf: int) -> None:
    for level in range(depth):
        following = {number: [] for number in forest}
        for a in range(0, max(len(t.open) for t in forest.values()), AT_ONCE):
            now = {number: t.open[a : a + AT_ONCE] for number, t in forest.items()}
            sent = sums.sparkSession.sparkContext.broadcast({n: forest[n].tree(nodes) for n, nodes in now.items() if len(nodes)})
            found = best_splits(counted(sums, d, sent, trees, level), d, min_leaf).toArrow().to_pandas()  # a row per node
            sent.destroy()
            for number, r in found[found["w"] > 0].sort_values(["tree", "slot"]).groupby("tree"):
                following[number].append(forest[number].split(now[number][r["slot"]], r, min_leaf))
        for number, t in forest.items():
            t.open = np.concatenate([*following[number], np.empty(0, dtype=np.int32)]).astype(np.int32)
        if not any(len(t.open) for t in forest.values()):
            break


def count_leaf_rows(sums: DataFrame, d: Design, forest: dict[int, Growing], trees: int, depth: int) -> None:
    """The number of training rows that end at each leaf."""
    sent = sums.sparkSession.sparkContext.broadcast({n: t.tree() for n, t in forest.items()})
    is_label, size = np.array([t is None for t in d.thresholds]), chunk_size(trees)

    def count(batches):
        now, total = sent.value, {}
        for first, x, n, w, _ in blocks(batches, len(d.columns), size, trees):
            for number in range(first, first + w.shape[1]):
                if tree := now.get(number):
                    one = np.bincount(places(tree, x, is_label, depth), n, len(tree.left))
                    total[number] = total.get(number, 0) + one
        for number, n in total.items():
            at = np.nonzero(n)[0]
            yield pd.DataFrame({"tree": number, "node": at, "rows": n[at].astype(np.int64)})

    found = sums.mapInPandas(count, "tree int, node int, rows long").groupBy("tree", "node").agg(F.sum("rows").alias("rows"))
    for t in forest.values():
        t.rows = np.zeros(len(t.w), dtype=np.int64)
    for number, r in found.toArrow().to_pandas().groupby("tree"):  # a row per leaf
        forest[number].rows[r["node"]] = r["rows"]
    sent.destroy()


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, drawn long, rows long"


def node_rows(number: int, t: Growing, d: Design) -> pd.DataFrame:
    inner = t.left != np.arange(len(t.left))
    f, b = t.feature.astype(np.int64), t.bin.astype(np.int64)
    is_label = np.array([c is None for c in d.thresholds])[f]
    cut = np.full(len(f), 0.5)
    for i, c in enumerate(d.thresholds):
        if c is not None:
            here = inner & (f == i)
            cut[here] = c[b[here]]
    return pd.DataFrame({
        "tree": np.int32(number), "node": np.arange(len(f), dtype=np.int32), "feature": np.where(inner, d.firsts[f] + np.where(is_label, b, 0), -1),
        "threshold": cut, "left": np.where(inner, t.left, -1), "right": np.where(inner, t.right, -1),
        "value": d.base + d.step * t.s / t.w, "gain": t.gain, "drawn": t.w.astype(np.int64), "rows": -1 if t.rows is None else t.rows,
    })


def write_nodes(spark: SparkSession, forest: dict[int, Growing], d: Design, path: str) -> None:
    """Adds trees to the stored table, at most WRITTEN nodes, or a tree, at a time."""
    inner = lambda c, t="int": F.when(F.col("left") >= 0, F.col(c)).cast(t).alias(c)
    kept = ["tree", "node", inner("feature"), inner("threshold", "double"), inner("left"), inner("right"), "value", inner("gain", "double"), "drawn",
            F.when(F.col("rows") >= 0, F.col("rows")).alias("rows")]

    def write(some: dict[int, Growing]) -> None:
        # Broadcast: as rows of the driver's they would be part of a task, copied several times in its heap.
        sent = spark.sparkContext.broadcast(some)

        def rows(_):
            for number, t in sent.value.items():
                whole = node_rows(number, t, d)
                for a in range(0, len(whole), AT_ONCE):
                    yield whole.iloc[a : a + AT_ONCE]

        spark.range(0, 1, 1, 1).mapInPandas(rows, NODES).select(*kept).write.mode("append").parquet(path)
        sent.destroy()

    held, nodes = {}, 0
    for number, t in forest.items():
        if held and nodes + len(t.w) > WRITTEN:
            write(held)
            held, nodes = {}, 0
        held[number] = t
        nodes += len(t.w)
    write(held)
