"""Resampling of documents by how much their n-grams are like a target's.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. Everything
between words is collapsed to a single space, and `regex.finditer(overlapped=True)` with lookarounds
for the spaces gives every n-gram as one match of the text, from which its CRC-32 is counted: no
list of words is joined again. Bucketed counts of the documents and of the target give each bucket
a gain, the mean gain of its features weighs a document, and Gumbel noise drawn from the id turns
the weights into a sample without replacement.

1. Texts are read once; of each only its bucket numbers go on, two bytes a feature.
2. Counts are added up per task, then per bucket; the table of gains has `buckets` rows.
3. Scores are whole numbers in a range that doesn't grow with the table, so counts per score tell
   which score the draw ends at; only rows from there on are put in order.

Defined results: null and empty texts have no features and weight 0; rows without an id draw their
noise from an empty id and come last among equal scores; rows that repeat an id are documents of
their own; equal rows share their ranks between them in any order; an empty table gives an empty
result, and an empty target counts as one without features; other columns are ignored or, in
`resample`, kept whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.ordered import placed, salt
from stintwise.operators.lookup import settle

# One byte to one byte: A-Z lower-cased, all other ASCII but letters and digits to a space.
SIGNS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class ImportanceSpec:
    shortest: int = 1
    longest: int = 2  # n-grams of `shortest` to `longest` words
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10  # of the documents with so many words, this many are drawn
    seed: int = 2024

    @property
    def width(self) -> str:
        return "<u2" if self.buckets <= 65_536 else "<u4"


@lru_cache(maxsize=16)
def gram_pattern(n: int) -> regex.Pattern:
    """n words between single spaces, not parted within a word."""
    return regex.compile(rb"(?<= )" + rb"(?:[^ ]++ )" * (n - 1) + rb"[^ ]++(?= )")


def collapsed(text: str | None) -> bytes:
    """The words with one space before and behind each."""
    words = (text or "").encode("utf-8", "replace").translate(SIGNS).split()
    return b" " + b" ".join(words) + b" "


def grams(text: str | None, spec: ImportanceSpec) -> list[bytes]:
    """All n-grams of a text, repeats included: what the buckets are counted from."""
    line = collapsed(text)
    return [m[0] for n in range(spec.shortest, spec.longest + 1) for m in gram_pattern(n).finditer(line, overlapped=True)]


def features(text: Column, spec: ImportanceSpec) -> Column:
    """n_words, n_features and the features' buckets as packed numbers."""

    @F.pandas_udf("n_words long, n_features long, buckets binary")
    def found(texts: pd.Series) -> pd.DataFrame:
        crc, out = zlib.crc32, []
        patterns = [gram_pattern(n) for n in range(spec.shortest, spec.longest + 1)]
        for t in texts:
            line = collapsed(t)
            sums = [crc(m[0]) for p in patterns for m in p.finditer(line, overlapped=True)]
            ids = np.array(sums, dtype=np.uint32) % np.uint32(spec.buckets)
            out.append((line.count(b" ") - 1 if len(line) > 2 else 0, len(sums), ids.astype(spec.width).tobytes()))
        return pd.DataFrame(out, columns=["n_words", "n_features", "buckets"])

    return found(text)


def bucket_counts(featured: DataFrame, spec: ImportanceSpec, name: str) -> DataFrame:
    """(bucket, `name`): how often each bucket occurs. A task adds up its own rows first."""

    def run(batches):
        total = np.zeros(spec.buckets, dtype=np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["buckets"]), dtype=spec.width), minlength=spec.buckets)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": at, name: total[at]})

    parts = featured.select("buckets").mapInPandas(run, f"bucket long, {name} long")
    return parts.groupBy("bucket").agg(F.sum(name).alias(name))


def gains(raw: DataFrame, target: DataFrame, spec: ImportanceSpec) -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the log ratio of its smoothed shares, floored."""
    spark = raw.sparkSession
    both = (
        spark.range(spec.buckets)
        .withColumnRenamed("id", "bucket")
        .join(bucket_counts(raw, spec, "s"), "bucket", "left")
        .join(bucket_counts(target, spec, "t"), "bucket", "left")
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    )
    every = Window.partitionBy()  # `buckets` rows
    all_s, all_t = F.sum("s").over(every), F.sum("t").over(every)
    ratio = (F.col("t") + 1) * (all_s + spec.buckets) / ((F.col("s") + 1) * (all_t + spec.buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def mean_gain(buckets: Column, table: np.ndarray, spec: ImportanceSpec) -> Column:
    @F.pandas_udf("long")
    def mean(packed: pd.Series) -> pd.Series:
        sizes = packed.map(len).to_numpy() // np.dtype(spec.width).itemsize
        flat = table[np.frombuffer(b"".join(packed), dtype=spec.width)]
        total = np.concatenate([[0], np.cumsum(flat)])
        ends = np.cumsum(sizes)
        return pd.Series((total[ends] - total[ends - sizes]) // np.maximum(sizes, 1))

    return mean(buckets)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel number drawn from the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, target: DataFrame, spec: ImportanceSpec, keep: list[Column]) -> DataFrame:
    """`keep` with n_words, n_features, weight and score of every row, written."""
    picked = docs.select(*keep, F.col("doc_id").cast("long").alias("_id"), features(F.col("text"), spec).alias("_f"))
    raw = settle(picked.select(*[c for c in picked.columns if c != "_f"], "_f.*"))
    aim = target.select(features(F.col("text"), spec).alias("_f")).select("_f.*")
    table = np.zeros(spec.buckets, dtype=np.int64)
    found = gains(raw, aim, spec).toPandas()  # `buckets` rows
    table[found["bucket"]] = found["gain"]
    scored = raw.withColumn("weight", mean_gain(F.col("buckets"), table, spec)).drop("buckets")
    return settle(scored.withColumns({"score": F.col("weight") + noise(F.col("_id"), spec.seed), "_salt": salt()}))


def ranked(scored: DataFrame, spec: ImportanceSpec) -> DataFrame:
    """Adds `rank`: 1 for the highest score; null for rows that are not drawn."""
    able = F.col("n_words") >= spec.least_words
    per_score = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    higher = F.sum("n").over(Window.orderBy(F.col("score").desc())) - F.col("n")
    # A row per score that occurs: some ten thousand, whatever the number of documents.
    ends = per_score.select("score", higher.alias("higher"), F.sum("n").over(Window.partitionBy()).alias("able"))
    wanted = F.floor(F.col("able") * spec.percent / 100)
    last = ends.filter(F.col("higher") < wanted).agg(F.min("score").alias("score"), F.first(wanted).alias("n")).first()
    if last["n"] is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("_id", "_salt")
    near = able & (F.col("score") >= last["score"])
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("n_features"), F.col("_salt")]
    first = placed(scored.filter(near).withColumn("_all", F.lit(0)), ["_all"], order, "_at").drop("_all")
    drawn = first.withColumn("rank", F.when(F.col("_at") < last["n"], F.col("_at") + 1)).drop("_at")
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_id", "_salt")


def ranks(docs: DataFrame, target: DataFrame, spec: ImportanceSpec = ImportanceSpec()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row."""
    return ranked(weighed(docs, target, spec, [F.col("doc_id").cast("long").alias("doc_id")]), spec)


def resample(docs: DataFrame, target: DataFrame, spec: ImportanceSpec = ImportanceSpec()) -> DataFrame:
    """The drawn rows of `docs` with all their columns, and `drawn` (weight, score, rank)."""
    rows = ranked(weighed(docs, target, spec, [F.struct("*").alias("_row")]), spec).filter(F.col("rank").isNotNull())
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns, F.struct("weight", "score", "rank").alias("drawn"))
