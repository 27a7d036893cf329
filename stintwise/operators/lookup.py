"""Joins against lookup tables whose size is checked, and settling of a plan on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.settings import DEFAULTS, Settings

SALTS = 32
ROWS_EACH = 262_144  # rows that a task sorts; about 300 MB of telemetry or laps
ROWS_A_FILE = 65_536  # short rows that a task of a settled table writes, where their number is known


def pin_small(df: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, bool]:
    """Compute a table that is expected to be small, once.

    Up to `lookup_max_rows` rows become a local relation and the flag says so; a larger
    table comes back as the plan it was.
    """
    head = df.limit(s.lookup_max_rows + 1).toArrow()
    if head.num_rows > s.lookup_max_rows:
        return df, False
    return df.sparkSession.createDataFrame(head, df.schema), True


def attach(
    rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", s: Settings = DEFAULTS
) -> DataFrame:
    """Equi-join many rows with a lookup table.

    A pinned lookup is broadcast, so the rows do not move. A larger one is joined with the
    key salted: a key that holds a third of the rows is spread over SALTS tasks, and the
    lookup rows are repeated once per salt.
    """
    small, pinned = pin_small(lookup, s)
    return join_pinned(rows, small, pinned, on, how)


def join_pinned(rows: DataFrame, lookup: DataFrame, pinned: bool, on: list[str], how: str = "left") -> DataFrame:
    if pinned:
        return rows.join(F.broadcast(lookup), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows by `keys` over as many tasks as `rows` of them need, where that is more than the
    session's number of shuffle partitions; else as they were, to be dealt by who needs it."""
    parts = -(-rows // ROWS_EACH)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in `spark.checkpoint.dir`. Where none is set, a local
    session, as in tests, gets a temporary one; a cluster must name its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame, rows: int | None = None, **options) -> DataFrame:
    """Write the rows once to the shared folder, for plans that read them again. Columns a
    reader does not use are not read back. Where it is known that at most `rows` short rows come,
    no more tasks write them than they need: a small table is not a file per shuffle partition.
    `options` are the writer's."""
    path = scratch_path(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
