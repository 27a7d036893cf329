"""What the text operators share: the word rule, and reading `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"  # between words; everything else is part of one


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for an empty one."""
    return F.array_remove(F.split(text, SPACE), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words, in Python: `bytes.split` parts at the same six bytes."""
    return (text or "").encode("utf-8", "replace").split()
