"""The fixed split of labelled documents, and bounded samples of the part to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for evaluation: crc32 of the id as text, modulo 5, is 0. A row
    without an id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample_per_class(labelled: DataFrame, label: str, per_class: int, classes: list) -> DataFrame:
    """Up to `per_class` rows (doc_id, label) of each class, by a hash of the id."""
    learn = labelled.filter(~held_out(F.col("doc_id")))
    parts = [learn.filter(F.col(label) == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_of_each(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """As `sample_per_class` for all classes there are, in one pass: Spark keeps the first
    `per_class` rows of a class in each partition before they are shuffled."""
    learn = labelled.filter(~held_out(F.col("doc_id")))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return learn.withColumn("_nr", F.row_number().over(order)).filter(F.col("_nr") <= per_class).drop("_nr")
