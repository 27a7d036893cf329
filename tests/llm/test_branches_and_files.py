"""Groups of near copies are not branched at their roots, and small settled tables are few files."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from stintwise.llm import chosen_path, repeated_windows
from stintwise.llm.components import components
from stintwise.operators import lookup


def files_of(df):
    return len({r[0] for r in df.select(F.input_file_name()).distinct().collect()})


def test_a_small_settled_table_is_one_file(spark):
    df = spark.range(1000).repartition(16)
    assert files_of(lookup.settle(df)) == 16 and files_of(lookup.settle(df, 1000)) == 1
    assert lookup.settle(df, 1000).count() == 1000 and lookup.settle(df.limit(0), 0).count() == 0
    assert lookup.settle(spark.range(100_000).repartition(16), 100_000).agg(F.sum("id")).first()[0] == 99_999 * 50_000


def test_labels_of_few_links_are_few_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        labels = components(spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")))
        assert files_of(labels) == 1 and {r.component for r in labels.collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_a_passage_is_one_run_whatever_stands_around_it(spark, docs_of):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = some(400)
    docs = docs_of([(i, " ".join(some(60 + i) + passage + some(70))) for i in range(30)])
    found = repeated_windows.pieces(docs)
    common = found.groupBy("minimiser").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("minimiser")
    shared = found.join(common, "minimiser", "left_semi")
    placed = repeated_windows.runs(shared)
    rows, kinds = placed.agg(F.sum(F.size("content"))).first()[0], placed.dropDuplicates(["run"]).agg(F.sum(F.size("content"))).first()[0]
    assert rows == shared.count() and kinds < rows / 3
    assert [r.n_removed for r in repeated_windows.digests(docs).orderBy("doc_id").collect()] == [0] + [400] * 29
