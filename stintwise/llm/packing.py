"""Best-two-fit packing of token pieces into sequences.

A sequence is filled greedily with the longest pieces that fit; then its smallest piece is
replaced by two unpacked ones that fit the gap so widened more tightly. Only lengths matter, so
the plan is made from the counts per length (as many entries as a sequence has tokens, whatever
the corpus): a pattern of lengths is found once and used as often as the counts allow. Each use
ends a length, so patterns are as few as lengths. Pieces then find their places by their number
within their length, counted in slots, so that a length that most pieces have is spread out.

Defined results: a null text counts as empty and gives the end id alone; rows without an id, and
rows that repeat an id, are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm import tokens
from stintwise.operators.lookup import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, space_joins: bool = False) -> DataFrame:
    """One row per piece: only documents beyond `capacity` are cut."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = tokens.encoder(tokenizer, "<u4", space_joins)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            doc_ids, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"]]
            for part in tokens.in_batches(texts):
                rows = []
                for doc_id, body in zip(doc_ids[part], encode.ids(texts[part])):
                    body += end
                    for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                        some = body[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(some) // 4, zlib.crc32(some)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def longest_fit(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each gap the longest length at hand that fits it, 0 if none does."""
    return np.maximum.accumulate(np.where(counts > 0, lengths, 0))


def tighter_pair(counts: np.ndarray, fits: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked pieces that fill `gap` best, if they fill more than `more_than` of it."""
    first = np.nonzero(counts[: gap + 1])[0]
    second = fits[gap - first]
    same = (second == first) & (counts[first] < 2)
    if same.any():  # one piece can't be taken twice
        second[same] = [next((b for b in range(a - 1, 0, -1) if counts[b]), 0) for a in first[same]]
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= more_than:
        return None
    i = int(total.argmax())
    return int(first[i]), int(second[i])


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences). counts[n]: pieces of length n.

    Two for one fills a sequence better but spends short pieces that could fill later gaps, so it
    is kept only where the whole plan needs no more sequences by it."""
    exchanged = filled(counts, capacity, exchange=True)
    size = lambda bins: sum(times for _, times in bins)
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    if size(exchanged) <= least:
        return exchanged
    return min(exchanged, filled(counts, capacity, exchange=False), key=size)


def filled(counts: np.ndarray, capacity: int, exchange: bool) -> list[tuple[list[int], int]]:
    counts = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    out = []
    fits = longest_fit(lengths, counts)
    while (longest := int(fits[capacity])) > 0:
        bin_, gap = [], capacity
        left = counts
        while gap and (n := int(fits[gap])):
            take = min(gap // n, int(left[n]))
            bin_ += [n] * take
            gap -= n * take
            left = left.copy() if left is counts else left
            left[n] -= take
            fits = longest_fit(lengths, left) if left[n] == 0 else fits
        if exchange and gap and len(bin_) > 1:
            smallest = bin_[-1]
            pair = tighter_pair(left, longest_fit(lengths, left), gap + smallest, smallest)
            if pair:
                bin_ = [*bin_[:-1], *pair]
        used = np.bincount(bin_, minlength=capacity + 1)
        at = np.nonzero(used)[0]
        times = int((counts[at] // used[at]).min())
        counts[at] -= used[at] * times
        out.append((sorted(bin_, reverse=True), times))
        fits = longest_fit(lengths, counts)
    return out


def places(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """The plan by length: pieces numbered first_rank to last_rank of a length fill `offsets` of
    the sequences from first_bin on."""
    rows, used, first_bin = [], {}, 0
    for lengths, times in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, here in offsets.items():
            rank = used.get(n, 0)
            used[n] = rank + len(here) * times
            rows.append((n, rank, used[n] - 1, first_bin, here))
        first_bin += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "last_rank", "first_bin", "offsets"])


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """`rank` from 0 within each length, in slots of a length."""
    slots = max(16, total // 250_000)
    spread = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)).cast("int"))
    sizes = spread.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece")) - 1
    return spread.withColumn("inside", inside).join(starts, ["length", "slot"]).withColumn("rank", F.col("base") + F.col("inside")).drop("base", "inside", "slot")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """PIECES with `sequence_id` and the `offset` of the piece in its sequence."""
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer, end_id, capacity))
    histogram = cut.groupBy("length").count().toPandas()  # `capacity` rows at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[histogram["length"].to_numpy(dtype=np.int64)] = histogram["count"].to_numpy(dtype=np.int64)
    table = places(plan(counts, capacity))
    schema = "length long, first_rank long, last_rank long, first_bin long, offsets array<long>"
    where = spark.createDataFrame([tuple(r) for r in table.itertuples(index=False)], schema) if len(table) else spark.createDataFrame([], schema)
    # A row per length of each pattern, of which there are no more than lengths: it can be broadcast.
    number = F.col("rank") - F.col("first_rank")
    return (
        numbered(cut, int(counts.sum()))
        .join(F.broadcast(where.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_bin") + F.floor(number / F.size("offsets"))).alias("sequence_id"),
            F.get("offsets", F.pmod(number, F.size("offsets")).cast("int")).alias("offset"),
        )
    )
