"""A Merkle manifest of a table, built and proven by time-forward processing.

A document is a leaf; leaves ascend by id within their language, neighbours are hashed in pairs
until one node is left, and the languages' nodes are paired likewise up to the root.

Time-forward processing evaluates a graph in the order of its nodes' labels: a node sends its value
to later nodes through a priority queue, and takes what was sent to it from the queue's head. Here
the queue is external in two parts. Between tasks it is Spark's sorted shuffle: nodes and messages
are dealt by (tree, block), where a block is 2^HEIGHT neighbouring leaves, and arrive sorted by label.
Within a block it is a heap of at most as many messages. A first sweep delivers child digests to
parents and leaves one node of each block, which are the leaves of the next round; trees of n leaves
take log(n) / HEIGHT rounds. The reversed sweep starts at the root and delivers to every node the
part of the proof that is common to all below it: sides and siblings from there to the root.

A tree is never gathered: a task holds one block. Leaves are numbered by ranges, so a language may
hold any share of the rows.

Defined results: each null is written as `-` in its leaf; a null language is a tree of its own, the
first; rows without an id come first in their tree and are never tampered with; rows that repeat
an id are leaves of their own, ordered by their digest; a lone leaf is its tree's node, unhashed; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.ordered import placed, salt
from stintwise.operators.lookup import attach, settle

HEIGHT = 8  # levels of a tree that one block spans
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT, ALONE = "L", "R", "A"  # a node's side: where its sibling is missing it is hashed alone


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    """A row's digest, with `n_chars` in the place of its own."""
    return F.sha2(F.concat(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)


def tree_of(lang: Column) -> Column:
    """Never null, ordered by the bytes of the language with null first."""
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, index, digest, doc_id, changed, n): a row per document, and in `changed` its digest
    with one more in n_chars, where `tampered` holds."""
    changed = F.when(tampered & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_of(F.col("lang")).alias("tree"), leaf(F.col("n_chars")).alias("digest"), changed.alias("changed"), salt().alias("salt"))
    return counted(placed(settle(rows), ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("salt")], "index").drop("salt"))


def counted(nodes: DataFrame) -> DataFrame:
    """With `n`, the number of nodes of the tree."""
    written = settle(nodes)
    return attach(written, written.groupBy("tree").agg(F.count("*").alias("n")), ["tree"])


def levels(n_tree: int, n_block: int) -> int:
    """How far a block is lifted: as high as blocks are, or to the only node of a small tree."""
    return HEIGHT if n_tree > 1 << HEIGHT else (n_block - 1).bit_length()


def upward(digests: list[str], top: int) -> dict[tuple[int, int], str]:
    """The digests of all nodes (level, index) of a block, in the order of their labels: the head
    of the queue holds what was sent to the next node."""
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]
    known: dict[tuple[int, int], str] = {}
    while queue:
        level, index, _, value = heapq.heappop(queue)
        sent = [value]
        while queue and queue[0][:2] == (level, index):
            sent.append(heapq.heappop(queue)[3])
        known[level, index] = digest(*sent) if level else value
        if level < top:
            heapq.heappush(queue, (level + 1, index >> 1, index & 1, known[level, index]))
    return known


def downward(known: dict[tuple[int, int], str], top: int, sides: str, siblings: str) -> dict[int, tuple[str, str]]:
    """(sides, siblings) of each leaf of a block, lowest level first, from those of its node: the
    same queue with the labels reversed."""
    queue = [(-top, 0, sides, siblings)]
    out = {}
    while queue:
        level, index, sides, siblings = heapq.heappop(queue)
        if level == 0:
            out[index] = sides, siblings
            continue
        below = -level - 1
        for child in (2 * index, 2 * index + 1):
            if (below, child) in known:
                other = known.get((below, child ^ 1), "")
                side = ALONE if not other else LEFT if child < child ^ 1 else RIGHT
                heapq.heappush(queue, (-below, child, side + sides, other + siblings))
    return out


ROW = ["tree", "block", "index", "digest", "n"]


def by_label(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


def block_of(index: str) -> Column:
    return F.shiftright(F.col(index), HEIGHT).alias("block")


def sorted_blocks(batches, columns: list[str]):
    """The rows of each (tree, block) of a task's sorted rows, one block at a time."""
    rows = (r for pdf in batches for r in zip(*[pdf[c].tolist() for c in columns]))
    return groupby(rows, key=lambda r: r[:2])


def lifted(nodes: DataFrame) -> DataFrame:
    """(tree, index, digest): the node of each block."""

    def run(batches):
        out = []
        for (tree, block), rows in sorted_blocks(batches, ROW):
            rows = list(rows)
            top = levels(rows[0][4], len(rows))
            out.append((tree, block, upward([r[3] for r in rows], top)[top, 0]))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["tree", "index", "digest"])
                out = []
        yield pd.DataFrame(out, columns=["tree", "index", "digest"])

    return by_label(nodes.select("tree", block_of("index"), "index", "digest", "n")).mapInPandas(run, "tree string, index long, digest string")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of a forest: its leaves, their blocks' nodes, and so on to one node a tree.
    `nodes` (tree, index, digest, n) are written."""
    rounds = [nodes]
    while True:
        rounds.append(counted(lifted(rounds[-1])))
        if rounds[-1].filter("n > 1").isEmpty():
            return rounds


PATHS = "tree string, index long, digest string, sides string, siblings string"


def delivered(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """PATHS of the nodes of a round, from the messages (tree, index, sides, siblings) to their
    blocks. A message is labelled before its block's first node."""
    columns = [*ROW, "sides", "siblings"]
    own = nodes.select("tree", block_of("index"), "index", "digest", "n", F.lit(None).cast("string").alias("sides"), F.lit(None).cast("string").alias("siblings"))
    sent = messages.select("tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("n"), "sides", "siblings")

    def run(batches):
        out, size = [], 0
        for (tree, _), rows in sorted_blocks(batches, columns):
            message, *rows = rows
            top = levels(rows[0][4], len(rows))
            known = upward([r[3] for r in rows], top)
            found = downward(known, top, message[5], message[6])
            out += [(tree, r[2], r[3], *found[i]) for i, r in enumerate(rows)]
            size += len(rows) * len(message[6])
            if len(out) >= 10_000 or size > 20_000_000:
                yield pd.DataFrame(out, columns=["tree", "index", "digest", "sides", "siblings"])
                out, size = [], 0
        yield pd.DataFrame(out, columns=["tree", "index", "digest", "sides", "siblings"])

    return by_label(own.unionByName(sent)).mapInPandas(run, PATHS)


def paths(rounds: list[DataFrame], messages: DataFrame) -> DataFrame:
    """PATHS of the leaves, from the messages to the trees' last nodes."""
    for nodes in reversed(rounds[1:-1]):
        messages = settle(delivered(nodes, messages).select("tree", "index", "sides", "siblings"))
    return delivered(rounds[0], messages)


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The manifest: (doc_id, leaf, subroot, root, sides, siblings, changed) of every row. `siblings`
    are digests of 64 signs each, from the leaf to the root, one for each side that isn't ALONE."""
    base = leaves(docs, F.lit(False) if tampered is None else tampered)
    forest = grown(base)
    trees = forest[-1].select("digest", "tree")
    joint = counted(placed(trees.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["tree"], [F.col("of")], "index"))
    top = grown(joint.select("tree", "index", "digest", "n"))
    root = top[-1].select("digest").head(1)
    start = top[-1].select("tree", "index", F.lit("").alias("sides"), F.lit("").alias("siblings"))
    above = paths(top, start).join(joint.select("index", "of"), "index")
    messages = settle(above.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), "digest", "sides", "siblings"))
    ways = paths(forest, messages.select("tree", "index", "sides", "siblings"))
    # A tree's index is unique, so each way meets one leaf.
    rows = ways.join(base.select("tree", "index", "doc_id", "changed"), ["tree", "index"])
    named = attach(rows, messages.select("tree", F.col("digest").alias("subroot")), ["tree"])
    return named.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root[0]["digest"] if root else None).cast("string").alias("root"), "sides", "siblings", "changed")


def folded(start: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    @F.pandas_udf("string")
    def fold(leaf: pd.Series, sides: pd.Series, siblings: pd.Series) -> pd.Series:
        out = []
        for value, way, rest in zip(leaf, sides, siblings):
            at = 0
            for side in way:
                if side == ALONE:
                    value = digest(value)
                    continue
                other = rest[at : at + 64]
                at += 64
                value = digest(value, other) if side == LEFT else digest(other, value)
            out.append(value)
        return pd.Series(out, dtype=object)

    return fold(start, sides, siblings)


def audit(docs: DataFrame) -> DataFrame:
    """Every row's proof put to the test, with n_chars raised by one where 7 divides the id's CRC-32:
    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    proven = proofs(docs, tampered)
    out = proven.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("sides"), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
