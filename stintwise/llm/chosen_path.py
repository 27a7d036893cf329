"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles; equal sets are one class from the start, standing
for all their copies. Independent trees split the classes: a node branches by minwise tokens
chosen by the node itself, so similar sets tend to go the same way, and a node that has become
small is compared exhaustively. Pairs that a sketch of 128 bits rules out by far are dropped;
the others are confirmed on the full sets. Links only have to connect, so pairs inside a component
already found need no confirming: the likeliest pair of each document goes first, then all that
are left between components.

A large node that keeps half of the rows it comes from is a group of much alike sets. Its members
are compared with the likeliest of PIVOTS of them, which links nearly all that are linked; those
left outside are compared with the whole node on their full sets, in blocks.

At similarity 0.8 a tree loses a pair with probability 0.2 a level where a node branches once;
most nodes are small after one or two levels, so TREES trees lose about 1 pair in a million. The
sketch's bound follows from the similarity asked for: it rules out a pair of just that similarity
about 10 times in 100,000, and in the last comparison of large nodes 1 time in 10 million.

Defined results: null and empty texts have an empty set and are linked with nothing; rows without
an id are linked with nothing, have no component and are kept; rows that repeat an id are one
document, which links whatever its texts are like; ties go to the smaller id; an empty table gives an empty result; other columns are
ignored or, in `one_of_each`, kept whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.components import components
from stintwise.llm.repeated_windows import BASE_1, BASE_2, U, hashed, mixed, text_key
from stintwise.operators.lookup import settle

TREES, DEEPER = 16, 32  # minwise functions that branch roots, and those for deeper nodes
FUNCTIONS = 128
SMALL, LEVELS, PIVOTS, BLOCK = 40, 4, 8, 1024
BATCH_SHINGLES = 400_000


@dataclass(frozen=True)
class SetSpec:
    words: int = 5
    percent: int = 80

    def least_bits(self, deviations: float) -> int:
        """Equal bits of 128 that a pair of just this similarity has, less so many deviations."""
        equal = (1 + self.percent / 100) / 2
        return math.floor(FUNCTIONS * equal - deviations * math.sqrt(FUNCTIONS * equal * (1 - equal)))


CANDIDATES, LAST_LOOK = 4.0, 5.5  # deviations that candidate pairs, and pairs compared at last, may be short of


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=U)
    h = hashed(words)
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, dtype=U)
    for k in range(width):
        total = total * U(BASE_1) + h[k : k + len(total)]
    return np.unique(mixed(total + U(width)))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """FUNCTIONS minwise values of each non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), FUNCTIONS), dtype=U)
    for f in range(FUNCTIONS):
        factor = U((BASE_2 * (2 * f + 3) * (f * f + 7)) % 2**64 | 1)
        out[:, f] = np.minimum.reduceat(flat * factor ^ (flat >> U(29)) * U(BASE_1 ^ (f << 32)), at)
    return mixed(out)


SETS = "doc_id long, tk long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, roots array<int>, deeper array<int>"


def sets(docs: DataFrame, spec: SetSpec) -> DataFrame:
    """Per row the size and two hashes of its set, its sketch, and its minwise tokens."""

    def run(batches):
        for pdf in batches:
            size = 0
            found = []
            for doc_id, tk, text in zip(pdf["doc_id"].tolist(), pdf["tk"].tolist(), pdf["text"]):
                s = shingles(text, spec.words)
                found.append((doc_id, tk, s))
                size += len(s)
                if size > BATCH_SHINGLES:
                    yield rows(found)
                    found, size = [], 0
            if found:
                yield rows(found)

    def rows(found):
        full = [s for *_, s in found if len(s)]
        out = {c.split()[0]: [None] * len(found) for c in SETS.split(", ")}
        out["doc_id"] = [d for d, *_ in found]
        out["tk"] = [tk for _, tk, _ in found]
        out["n_shingles"] = [len(s) for *_, s in found]
        if full:
            m = minwise(full)
            weights = U(1) << np.arange(64, dtype=U)
            bits = m & U(1)
            a, b = ((bits[:, k : k + 64] * weights).sum(1, dtype=U).view(np.int64) for k in (0, 64))
            tokens = (m >> U(32)).astype(np.uint32).view(np.int32)
            at = 0
            for i, (*_, s) in enumerate(found):
                if len(s):
                    out["set_a"][i] = int(mixed(s).sum(dtype=U).astype(np.int64))
                    out["set_b"][i] = int(mixed(s ^ U(BASE_2)).sum(dtype=U).astype(np.int64))
                    out["bits_a"][i], out["bits_b"][i] = int(a[at]), int(b[at])
                    out["roots"][i] = tokens[at, :TREES]
                    out["deeper"][i] = tokens[at, TREES : TREES + DEEPER]
                    at += 1
        return pd.DataFrame(out).astype({c: "Int64" for c in ("doc_id", "set_a", "set_b", "bits_a", "bits_b")})

    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text")
    return rows_of.mapInPandas(run, SETS)


def likeness(x: Column, y: Column) -> Column:
    """Equal bits of two sketches."""
    return F.lit(128) - F.bit_count(x["bits_a"].bitwiseXOR(y["bits_a"])) - F.bit_count(x["bits_b"].bitwiseXOR(y["bits_b"]))


def may_link(x: Column, y: Column, spec: SetSpec) -> Column:
    """Neither the sizes nor the sketches rule the pair out."""
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * spec.percent
    return sizes & (likeness(x, y) >= spec.least_bits(CANDIDATES))


PAIR = ["a", "b", "like"]


def pair_columns(x: Column, y: Column) -> list[Column]:
    return [F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b"), likeness(x, y).alias("like")]


def leaf_pairs(small: DataFrame, spec: SetSpec) -> DataFrame:
    """All pairs of small nodes that nothing rules out. A node holds SMALL rows at most."""
    nodes = small.groupBy("node").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    left = nodes.select("docs", F.posexplode("docs").alias("at", "x"))
    later = F.slice("docs", F.col("at") + 2, SMALL)
    plausible = F.filter(later, lambda y: may_link(F.col("x"), y, spec))
    return left.select("x", F.explode(plausible).alias("y")).select(*pair_columns(F.col("x"), F.col("y")))


def tree_pairs(classes: DataFrame, spec: SetSpec) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs of the trees' small nodes, and the rows of nodes that stayed large."""
    doc = F.struct("rep", "n", "bits_a", "bits_b").alias("doc")
    level = classes.select(doc, F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "doc", F.lit(None).cast("long").alias("before"))
    found, alike = [], []
    most = classes.count() * TREES
    for depth in range(LEVELS + 1):
        if depth:
            level = settle(level, most)  # branched once, for the sizes and for what is joined to them
            most = level.count()
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        level = level.join(sizes, "node")
        found.append(leaf_pairs(level.filter(F.col("size") <= SMALL), spec))
        large = settle(level.filter(F.col("size") > SMALL), most)
        most = large.count() * 2
        # A node that keeps half of the rows it comes from, or is large at the last level, holds
        # sets that are much alike: branching would only copy them.
        if depth == 0:
            keeps = F.lit(False)
        else:
            keeps = F.lit(True) if depth == LEVELS else F.col("size") * 2 >= F.col("before")
        alike.append(large.filter(keeps).select("node", "doc"))
        large = large.filter(~keeps)
        if depth == LEVELS or large.isEmpty():
            dense = settle(union(alike))
            return union(found), None if dense.isEmpty() else dense
        # One branch, or two in a quarter of the nodes: 1 / 0.8 on average.
        twice = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(4)) == 0
        which = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(DEEPER)).cast("int")
        other = F.pmod(which + 1 + F.pmod(F.xxhash64("node", F.lit(3)), F.lit(DEEPER - 1)).cast("int"), F.lit(DEEPER)).cast("int")
        chosen = F.when(twice, F.array(which, other)).otherwise(F.array(which))
        tokens = classes.select(F.col("rep").alias("_rep"), "deeper")
        spread = large.join(tokens, F.col("doc.rep") == F.col("_rep")).select("node", "doc", "size", "deeper", F.explode(chosen).alias("which"))
        level = spread.select(F.xxhash64("node", "which", F.get("deeper", F.col("which"))).alias("node"), "doc", F.col("size").alias("before"))
    raise AssertionError


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


BITS = ("bits_a", "bits_b")


def bit_sums(large: DataFrame) -> DataFrame:
    """Per node its size and how many members have each bit of the sketch set."""
    bit = lambda c, i: F.shiftrightunsigned(F.col(f"doc.{c}"), i).bitwiseAND(F.lit(1))
    return large.groupBy("node").agg(F.count("*").alias("size"), *[F.sum(bit(c, i)).alias(f"{c}{i}") for c in BITS for i in range(64)])


def pivots_of(large: DataFrame, most: int) -> DataFrame:
    """PIVOTS members of each large node: in each of as many parts of it, the member most like
    the node's average, which is linked to most others. `most` is what `large` has of rows."""
    majority = lambda c: reduce(Column.bitwiseOR, [F.when(F.col(f"{c}{i}") * 2 > F.col("size"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)])
    middle = settle(bit_sums(large).select("node", "size", F.struct(*[majority(c).alias(c) for c in BITS]).alias("middle")), most // SMALL)
    rank = F.struct(likeness(F.col("doc"), F.col("middle")), F.xxhash64("doc.rep", "node"))
    slot = F.pmod(F.xxhash64("doc.rep"), F.lit(PIVOTS))
    picks = [F.max_by("doc", F.when(slot == j, rank)).alias(f"p{j}") for j in range(PIVOTS)]
    return large.join(middle, "node").groupBy("node", "size").agg(*picks, F.max_by("doc", rank).alias("best"))


def pivot_pairs(large: DataFrame, pivots: DataFrame, spec: SetSpec) -> DataFrame:
    """Each member with the pivot of its node that it is most like. A node's pivots are one array,
    so a member stays one row however many there are."""
    every = pivots.select("node", F.array_compact(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("pivots"))
    near = F.filter("pivots", lambda p: (p["rep"] != F.col("doc.rep")) & may_link(p, F.col("doc"), spec))
    best = F.array_max(F.transform(near, lambda p: F.struct(likeness(p, F.col("doc")).alias("like"), p.alias("p"))))
    both = large.join(settle(every, pivots.count()), "node").select("doc", best["p"].alias("x")).filter("x is not null")
    return both.select(*pair_columns(F.col("x"), F.col("doc")))


def set_table(texts: DataFrame, spec: SetSpec) -> DataFrame:
    """(rep, shingles) with the hashes of the full set."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["doc_id"], "shingles": [shingles(t, spec.words).tobytes() for t in pdf["text"]]})

    return texts.mapInPandas(run, "rep long, shingles binary")


def outside_links(large: DataFrame, pivots: DataFrame, labels: DataFrame, texts: DataFrame, spec: SetSpec) -> DataFrame:
    """Links (a, b) between components (ca, cb) for the members of large nodes that are not in
    the component of the node's best pivot. Each is compared with the whole node, in blocks of
    BLOCK by BLOCK, on the full sets; a block gives one link for each component it links to."""
    named_by = lambda c: labels.select(F.col("node").alias("_n"), F.col("component").alias(c))
    rep = F.col("doc.rep")
    named = large.join(named_by("component"), rep == F.col("_n"), "left").select("node", "doc", F.coalesce("component", rep).alias("component"))
    best = F.col("best.rep")
    main = pivots.join(named_by("main"), best == F.col("_n"), "left").select("node", "size", F.coalesce("main", best).alias("main"))
    both = settle(named.join(settle(main, pivots.count()), "node"), large.count())
    out = both.filter("component <> main")
    n_out = settle(out.groupBy("node").agg(F.count("*").alias("n_out")), pivots.count())
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    out_parts = F.ceil(F.col("n_out") / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = lambda n: F.pmod(F.xxhash64(rep), n).cast("int")
    sets_of = set_table(texts, spec)
    flat = ["node", "i", "j", "component", "doc.rep", "doc.n", "doc.bits_a", "doc.bits_b"]
    whole = lambda rows: rows.join(sets_of, "rep")
    left = whole(out.join(n_out, "node").select("node", "doc", "component", one(out_parts).alias("i"), every(parts).alias("j")).select(*flat))
    right = whole(both.join(n_out, "node").select("node", "doc", "component", every(out_parts).alias("i"), one(parts).alias("j")).select(*flat))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        result = {}
        yn, ya, yb = y["n"].to_numpy(), y["bits_a"].to_numpy(), y["bits_b"].to_numpy()
        yc, yrep = y["component"].to_numpy(), y["rep"].to_numpy()
        unpacked = lambda raw: frozenset(np.frombuffer(raw, dtype=U).tolist())
        others = [unpacked(raw) for raw in y["shingles"]]
        for r in x.itertuples(index=False):
            like = 128 - np.bitwise_count(ya ^ r.bits_a).astype(int) - np.bitwise_count(yb ^ r.bits_b).astype(int)
            ok = (like >= least) & (np.minimum(yn, r.n) * 100 >= np.maximum(yn, r.n) * spec.percent) & (yc != r.component)
            own = unpacked(r.shingles)
            for at in np.nonzero(ok)[0]:
                key = (r.component, yc[at])
                if key not in result:
                    common = len(own & others[at])
                    if 100 * common >= spec.percent * (r.n + yn[at] - common):
                        result[key] = (r.rep, yrep[at], *key)
        return pd.DataFrame(list(result.values()), columns=["a", "b", "ca", "cb"]).astype("int64")

    least = spec.least_bits(LAST_LOOK)
    key = ["node", "i", "j"]
    right = right.toDF(*right.columns)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "a long, b long, ca long, cb long")


def confirmed(pairs: DataFrame, texts: DataFrame, spec: SetSpec) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for pdf in batches:
            last, held = None, None
            keep = []
            for b, x, y in zip(pdf["b"], pdf["text_a"], pdf["text_b"]):
                if last != b:
                    last, held = b, shingles(y, spec.words)
                s = shingles(x, spec.words)
                common = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(100 * common >= spec.percent * (len(s) + len(held) - common))
            yield pdf.loc[keep, ["a", "b"]]

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components (ca, cb)."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    named = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return named.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")


def merged(labels: DataFrame, pairs: DataFrame, texts: DataFrame, spec: SetSpec) -> DataFrame:
    """The labels once all of `pairs` between components are confirmed or dropped."""
    apart = settle(between(pairs, labels), pairs.count())
    if apart.isEmpty():
        return labels
    return renamed(labels, confirmed(apart.select("a", "b"), texts, spec).join(apart, ["a", "b"]))


def renamed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels once the components that `links` joins (ca, cb) are one."""
    links = links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joined = components(links)
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    fresh = joined.join(labels, "node", "left_anti").select("node", "component")
    return settle(moved.select("node", F.coalesce("now", "component").alias("component")).unionByName(fresh), labels.count() + joined.count())


def connected(pairs: DataFrame, texts: DataFrame, spec: SetSpec) -> DataFrame:
    """(node, component) by the candidate pairs: each document's likeliest pair first, which
    leaves few pairs between components to confirm."""
    likeliest = F.max_by(F.struct("a", "b"), F.struct("like", F.xxhash64("a", "b"))).alias("p")
    best = [pairs.groupBy(c).agg(likeliest).select("p.a", "p.b") for c in ("a", "b")]
    labels = components(confirmed(best[0].unionByName(best[1]).distinct(), texts, spec))
    return merged(labels, pairs, texts, spec)


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text): a text of each wanted class, under the class's number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("tk"), "text")
    named = classes.join(wanted, "rep", "left_semi").select(F.col("rep").alias("doc_id"), F.col("first").alias("id"), "tk")
    return rows.join(named.hint("merge"), ["id", "tk"]).select("doc_id", "text")


def similar_classes(docs: DataFrame, spec: SetSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): (doc_id, n_shingles, rep, first) of all rows, (rep, first) of the
    classes of equal sets, and (node, component) of the linked ones. `rep` numbers the classes,
    `first` is the smallest id of one; both are null for empty sets and rows without an id."""
    every = settle(sets(docs, spec))
    key = ["set_a", "set_b"]
    usable = every.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    least = usable.groupBy(*key).agg(F.min(F.struct("doc_id", "tk")).alias("least"))
    mine = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("tk") == F.col("least.tk"))
    one = usable.join(least, [*key]).filter(mine).dropDuplicates(key)
    classes = settle(
        one.select(F.monotonically_increasing_id().alias("rep"), F.col("doc_id").alias("first"), "tk", *key, F.col("n_shingles").alias("n"), "bits_a", "bits_b", "roots", "deeper")
    )
    found, large = tree_pairs(classes, spec)
    pairs = [found]
    if large is not None:
        n_large = large.count()
        pivots = settle(pivots_of(large, n_large), n_large // SMALL)
        pairs.append(pivot_pairs(large, pivots, spec))
    candidates = settle(union(pairs).distinct())
    numbers = classes.select(*key, "rep", "first")
    with_id = every.join(numbers, key, "left").select("doc_id", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("rep", "first")])
    ends = candidates.select(F.col("a").alias("rep")).unionByName(candidates.select(F.col("b").alias("rep")))
    if large is not None:
        ends = ends.unionByName(large.select(F.col("doc.rep").alias("rep")))
    texts = settle(texts_of(docs, classes, ends.distinct()).dropDuplicates(["doc_id"]))
    labels = connected(candidates, texts, spec)
    if large is not None:
        labels = renamed(labels, outside_links(large, pivots, labels, texts, spec))
    return with_id, classes.select("rep", "first"), joined_by_id(with_id, labels)


def joined_by_id(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels once the classes of rows that repeat an id, which are one document, are one."""
    spread = rows.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").drop("z")
    spread = settle(spread)
    if spread.isEmpty():
        return labels
    links = rows.join(spread, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
    return renamed(labels, between(links, labels))


def group_documents(docs: DataFrame, spec: SetSpec = SetSpec()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows, classes, labels = similar_classes(docs, spec)
    named = labels.join(classes, labels["node"] == classes["rep"]).select("rep", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    joined = rows.join(named.join(least, "component").select("rep", "least"), "rep", "left")
    component = F.coalesce("least", "first", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, spec: SetSpec = SetSpec()) -> DataFrame:
    """The rows of `docs` that stand for their group, with all their columns."""
    gone = group_documents(docs, spec).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
