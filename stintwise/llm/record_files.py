"""Token ids in length-delimited binary records.

A shard file is a row of records:

    length of the payload   8 bytes, little-endian
    masked CRC-32 of those  4 bytes
    payload                 flags (1 byte: 1 = the document has no id), id (8 bytes), token ids
    masked CRC-32 of it     4 bytes

Token ids take 2 bytes where the vocabulary allows it, else 4; `width` in the shard list says
which. Beside each shard lies its offset index (8 bytes a record), so a reader can fetch records
in any order. Shards follow each other in ascending order of the id; the shard list gives each
one's place among all token ids. A task names its files anew on each attempt and the list holds
those of the attempt that counted, so files of lost tasks are never read.

Defined results: a null text counts as empty and gives the end id alone; documents without an id
come first; rows that repeat an id are records of their own, in order of their text; an empty
table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.llm import tokens
from stintwise.llm.files import open_new, open_old
from stintwise.operators.lookup import scratch_path, settle

HEAD, ID = struct.Struct("<QI"), struct.Struct("<Bq")
SHARDS = "shard int, path string, index_path string, width string, records long, ids long"


def masked(data: bytes) -> int:
    """A checksum that differs from the plain one, so that checksums may be stored in data."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def payload_of(doc_id, body: bytes) -> bytes:
    none = doc_id is None or doc_id is pd.NA or doc_id != doc_id
    return ID.pack(int(none), 0 if none else int(doc_id)) + body


def read_frame(f) -> bytes | None:
    """The next payload, checked; None at the end."""
    head = f.read(HEAD.size)
    if not head:
        return None
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("length of a record is damaged")
    body = f.read(size + 4)
    if len(body) != size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("record is damaged")
    return body[:size]


def parse(payload: bytes, width: str) -> tuple[int | None, np.ndarray]:
    flags, doc_id = ID.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, dtype=width, offset=ID.size)


def records(path: str, width: str) -> Iterator[tuple[int | None, np.ndarray]]:
    with open_old(path) as f:
        while (payload := read_frame(f)) is not None:
            yield parse(payload, width)


def record_at(path: str, index_path: str, width: str, n: int) -> tuple[int | None, np.ndarray]:
    """Record n of a shard, by the offset index."""
    with open_old(index_path) as f:
        f.seek(8 * n)
        (offset,) = struct.unpack("<Q", f.read(8))
    with open_old(path) as f:
        f.seek(offset)
        return parse(read_frame(f), width)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, space_joins: bool = True, width: str = "<u2") -> DataFrame:
    """Writes all documents under `folder`; returns the shard list, one row per shard."""

    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard = TaskContext.get().partitionId()
        stem = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        encode = tokens.encoder(tokenizer, width, space_joins)
        end = np.array([end_id], dtype=width).tobytes()
        n = total = at = 0
        data = index = None
        try:
            for pdf in batches:
                if data is None and len(pdf):
                    data, index = open_new(f"{stem}.rec"), open_new(f"{stem}.idx")
                ids, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"]]
                for part in tokens.in_batches(texts):
                    for doc_id, body in zip(ids[part], encode.ids(texts[part])):
                        framed = frame(payload_of(doc_id, body + end))
                        data.write(framed)
                        index.write(struct.pack("<Q", at))
                        at += len(framed)
                        n += 1
                        total += len(body) // len(end) + 1
        finally:
            for f in (data, index):
                if f is not None:
                    f.close()
        if n:
            yield pd.DataFrame({"shard": [shard], "path": [f"{stem}.rec"], "index_path": [f"{stem}.idx"], "width": [width], "records": [n], "ids": [total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInPandas(run, SHARDS))


def read_digests(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a shard list."""
    listed = shards.orderBy("shard").toPandas()  # one row per shard
    listed["start"] = listed["ids"].cumsum() - listed["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if listed.empty:
        return spark.createDataFrame([], schema)

    def run(batches):
        for pdf in batches:
            for path, width, start in zip(pdf["path"], pdf["width"], pdf["start"]):
                rows = []
                for doc_id, ids in records(path, width):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield frame_of(rows)
                        rows = []
                if rows:
                    yield frame_of(rows)

    def frame_of(rows):
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        return out.astype({"doc_id": "Int64"})

    plan = spark.createDataFrame(listed[["path", "width", "start"]])
    return plan.repartition(len(listed), "path").mapInPandas(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes to a new folder under the shared one and reads the digests back."""
    spark = docs.sparkSession
    return read_digests(spark, write(docs, scratch_path(spark), tokenizer, end_id))
