"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put in a random order and cut into blocks of about `block_words` words.
A source is read in passes: as many whole ones as its target holds, and one that takes blocks in
random order until the target is reached, the last block in part. So the number of blocks that each
source owes the mix is exact before any shard is filled.

The shards' shares are drawn by a tree over the shards: a node's blocks, counted by source, are
parted between its two halves as if drawn blindly from one urn (hypergeometric, source after
source), down to single shards. Every shard gets as many blocks as any other, to one, and the
sources' counts add up exactly. The drawn blocks of a source, numbered in random order, are dealt to
the shards by those counts, and each shard orders its own rows by a hash.

Only DataFrame functions are used. Texts are read once for their sizes. Prefix sums over a source
go by ranges, so a source may hold any share of the rows; a block holds `block_words` words, and
documents without words, which never enter a mix, are set aside first.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of
its own, the last; rows without an id are placed by an empty id; rows that repeat an id are documents
of their own; equal rows may stand for each other; an empty table, or one without words, gives an
empty mix; other columns are ignored or, in `mix`, kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.ordered import in_order, placed, running, salt
from stintwise.llm.text import SPACE, words
from stintwise.operators.lookup import attach, settle


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources by name, repeating
    percent: int = 150  # size of the mix against all sizes
    ceiling: int = 2  # a source gives its own size at most so often
    block_words: int = 16_384
    shard_words: int = 4_194_304
    seed: int = 2024


def source_key(source: Column) -> Column:
    """Never null, ordered by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def uniform(*parts: Column) -> Column:
    """60 bits by a digest that other engines have too."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, spec: MixSpec, keep: list[Column]) -> DataFrame:
    """`keep` with the source key, the size in words, and what places a row in its source."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        *keep,
        source_key(F.col("source")).alias("src"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{SPACE.replace('[', '[^')}+")).cast("long").alias("size"),
        uniform(F.lit(str(spec.seed)), doc_id).alias("key"),
        salt().alias("salt"),
    )
    return settle(rows)


def targets(rows: DataFrame, spec: MixSpec) -> DataFrame:
    """(src, source_size, target, total) of every source. Shares by weight stop at the ceiling, and
    the excess goes to the others by weight, which raises one common level: the highest that is
    reached when sources are filled in the order in which they come to their ceilings."""
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(spec.weights))) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, spec.weights)), turn).cast("double"))
    cap = F.col("source_size") * F.lit(float(spec.ceiling))
    filled = Window.orderBy(cap / F.col("weight"), "src")
    full = F.coalesce(F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    all_sources = Window.partitionBy()
    total = F.sum("source_size").over(all_sources) * F.lit(spec.percent) / F.lit(100.0)
    steps = weighted.withColumn("total", total).withColumn("level", (F.col("total") - full) / left)
    level = F.max("level").over(all_sources)
    return steps.select("src", "source_size", F.least(cap, level * F.col("weight")).alias("target"))


def clamp(value: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, most))


def blocked(rows: DataFrame, spec: MixSpec) -> DataFrame:
    """Rows with words, with their source's words `before` them and their `block`."""
    order = [F.col("key"), F.col("size"), F.col("salt")]
    some = in_order(rows.filter("size > 0"), [F.col("src"), *order])
    placed_ = running(some, ["src"], order, {"before": F.col("size")})
    return settle(placed_.withColumn("block", F.floor(F.col("before") / spec.block_words)))


def drawn_blocks(placed_rows: DataFrame, aims: DataFrame, spec: MixSpec) -> DataFrame:
    """(src, block, begin, pass, room, rank): the blocks that the mix takes, `room` words of each,
    numbered in random order within the source."""
    blocks = placed_rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.min("before").alias("begin"))
    whole = F.floor(F.col("target") / F.col("source_size"))
    owed = aims.filter("source_size > 0").select("src", whole.alias("whole"), (F.round("target").cast("long") - whole * F.col("source_size")).alias("rest"))
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("pass")
    seed = F.lit(str(spec.seed))
    own = [F.col(c).cast("string") for c in ("src", "pass", "block")]
    each = attach(blocks, owed, ["src"]).select("src", "block", "words", "begin", "whole", "rest", passes)
    each = settle(each.filter("pass < whole or rest > 0").withColumn("turn", uniform(seed, *own)))
    turn = [F.col("turn"), F.col("block")]
    last = running(in_order(each.filter("pass = whole"), [F.col("src"), *turn]), ["src"], turn, {"_taken": F.col("words")})
    last = last.filter("_taken < rest").withColumn("room", F.least(F.col("words"), F.col("rest") - F.col("_taken")))
    full = each.filter("pass < whole").withColumn("room", F.col("words"))
    columns = ["src", "block", "begin", "pass", "room"]
    both = full.select(*columns).unionByName(last.select(*columns)).withColumn("_deal", F.xxhash64(seed, *own))
    deal = [F.col("_deal"), F.col("block"), F.col("pass")]
    return settle(placed(both, ["src"], deal, "rank").drop("_deal"))


# --- the splitting tree -------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def number(x) -> Column:
    return x.cast("double")


def hypergeometric(pop: Column, good: Column, need: Column, u: Column) -> Column:
    """How many of `need` draws without replacement from `pop` fall on the `good`, by inversion at
    `u`. The probabilities are taken relative to the first by their recurrence, from 12 deviations
    below the mean to 12 above, or to the ends."""

    def within(mean: Column) -> Column:
        spread = F.sqrt(mean * (F.lit(1.0) - good / pop) * number(pop - need) / F.greatest(number(pop) - 1, F.lit(1.0)))
        reach = F.ceil(F.lit(12.0) * spread) + 6
        low = F.greatest(F.lit(0), need + good - pop, F.floor(mean) - reach).cast("long")
        high = F.least(good, need, F.floor(mean) + reach).cast("long")
        return let(F.struct(low.alias("low"), F.greatest(low, high).alias("high")), pick)

    def pick(ends: Column) -> Column:
        ks = F.sequence(ends["low"], ends["high"])
        ratio = lambda k: number(good - k) * number(need - k) / (number(k + 1) * number(pop - good - need + k + 1))
        step = lambda acc, k: F.struct((acc["p"] * ratio(k)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        total = F.aggregate(ks, start, step, lambda acc: acc["sum"])

        def walk(aim: Column) -> Column:
            first = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("passed"))
            further = lambda acc, k: F.struct(
                (acc["p"] * ratio(k)).alias("p"),
                (acc["sum"] + acc["p"]).alias("sum"),
                (acc["passed"] + (acc["sum"] + acc["p"] < aim).cast("long")).alias("passed"),
            )
            return F.aggregate(ks, first, further, lambda acc: F.least(ends["low"] + acc["passed"], ends["high"]))

        return let(total * u, walk)

    return F.when((pop <= 0) | (need <= 0) | (good <= 0), F.lit(0).cast("long")).otherwise(let(number(need) * number(good) / number(F.greatest(pop, F.lit(1))), within))


def left_counts(counts: Column, need: Column, seed: int) -> Column:
    """The counts by source that go to a node's left half, which takes `need` blocks."""
    start = F.struct(F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c).alias("pop"), need.cast("long").alias("need"), F.array().cast("array<long>").alias("out"))

    def draw(acc: Column, good: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["out"])), 11).cast("double") + 0.5) / F.lit(2.0**53)
        return let(
            hypergeometric(acc["pop"], good, acc["need"], u),
            lambda n: F.struct((acc["pop"] - good).alias("pop"), (acc["need"] - n).alias("need"), F.array_append(acc["out"], n).alias("out")),
        )

    return F.aggregate(counts, start, draw, lambda acc: acc["out"])


def shard_counts(quotas: DataFrame, blocks: int, shards: int, spec: MixSpec) -> DataFrame:
    """(src, shard, n): how many of each source's blocks a shard gets. `quotas`: (src, n), adding
    up to `blocks`. A node is one row with its counts in an array, one entry a source."""
    listed = F.sort_array(F.collect_list(F.struct("src", "n")))
    level = quotas.agg(listed.alias("q")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.transform("q", lambda x: x["src"]).alias("srcs"), F.transform("q", lambda x: x["n"]).alias("counts"))
    upto = lambda shard: F.floor(shard.cast("decimal(20,0)") * F.lit(blocks).cast("decimal(18,0)") / F.lit(shards)).cast("long")
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    for depth in range((shards - 1).bit_length()):
        parts = F.col("hi") - F.col("lo") > 1
        left = F.when(parts, left_counts(F.col("counts"), upto(mid) - upto(F.col("lo")), spec.seed))
        split = level.withColumn("left", left)
        node = lambda lo, hi, counts: F.struct(lo.alias("lo"), hi.alias("hi"), counts.alias("counts"))
        halves = F.array(
            node(F.col("lo"), mid, F.col("left")),
            node(mid, F.col("hi"), F.zip_with("counts", "left", lambda a, b: a - b)),
        )
        same = F.array(node(F.col("lo"), F.col("hi"), F.col("counts")))
        level = split.select("srcs", F.explode(F.when(F.col("left").isNotNull(), halves).otherwise(same)).alias("x")).select("srcs", "x.*")
        if depth % 8 == 7:  # the later levels' rows on many tasks
            level = settle(level.repartition("lo"))
    return level.select(F.explode(F.arrays_zip("srcs", "counts")).alias("c"), F.col("lo").alias("shard")).select(F.col("c.srcs").alias("src"), "shard", F.col("c.counts").alias("n"))


def dealt(draws: DataFrame, spec: MixSpec) -> DataFrame:
    """The drawn blocks with their shard."""
    sums = draws.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("room"), F.lit(0)).alias("words")).first()
    shards = max(1, min(sums["blocks"], -(-sums["words"] // spec.shard_words)))
    quotas = draws.groupBy("src").agg(F.count("*").alias("n"))
    cells = shard_counts(quotas, sums["blocks"], shards, spec).filter("n > 0")
    earlier = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranks = first.select("src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    return draws.join(ranks, ["src", "rank"])


def plan(rows: DataFrame, spec: MixSpec) -> tuple[DataFrame, DataFrame]:
    """(rows, aims): the rows of `sized` with `source_size`, `target` and `draws` (pass, shard,
    words), one for each time that the mix takes words of them."""
    aims = settle(targets(rows, spec))
    inside = blocked(rows, spec)
    draws = dealt(drawn_blocks(inside, aims, spec), spec)
    per_block = draws.groupBy("src", "block").agg(F.min("begin").alias("begin"), F.collect_list(F.struct("pass", "shard", "room")).alias("all"))
    taken = lambda d: clamp(d["room"] - (F.col("before") - F.col("begin")), F.col("size"))
    each = F.transform("all", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), taken(d).alias("words")))
    hit = F.filter(each, lambda d: d["words"] > 0)
    none = F.array().cast("array<struct<pass:bigint,shard:bigint,words:bigint>>")
    mixed = inside.join(per_block, ["src", "block"], "left").withColumn("draws", F.coalesce(hit, none)).select(*rows.columns, "draws")
    empty = rows.filter("size = 0").withColumn("draws", none)
    return attach(mixed.unionByName(empty), aims, ["src"]), aims


def amounts(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows, _ = plan(sized(docs, spec, [F.col("doc_id").cast("long").alias("doc_id")]), spec)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with `drawn` (shard, place
    in the shard, pass, words). A text that is taken in part is its first words, one space between."""
    rows, _ = plan(sized(docs, spec, [F.struct("*").alias("_row")]), spec)
    each = rows.select("_row", "key", "size", F.explode("draws").alias("_d"))
    shuffled = Window.partitionBy("_d.shard").orderBy(F.xxhash64(F.lit(spec.seed), "key", "_d.pass"), "key", "size")
    text = F.when(F.col("_d.words") < F.col("size"), F.array_join(F.slice(words(F.col("_row.text")), F.lit(1), F.col("_d.words").cast("int")), " ")).otherwise(F.col("_row.text"))
    drawn = F.struct(F.col("_d.shard").alias("shard"), F.row_number().over(shuffled).alias("place"), F.col("_d.pass").alias("pass"), F.col("_d.words").alias("words"))
    return each.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns], drawn.alias("drawn"))
