"""The stored lap feature table and the record of what it holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.functions.laps import session_key
from stintwise.operators.lookup import join_pinned, pin_small, settle
from stintwise.schema import LAP_FEATURES, SESSION, to_schema
from stintwise.settings import DEFAULTS, Settings

MANIFEST = T.StructType([f for f in LAP_FEATURES.fields if f.name in SESSION])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows where nothing was ever written."""
    try:
        return to_schema(spark.read.schema(schema).parquet(path), schema)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, LAP_FEATURES)


def load_built(spark: SparkSession, path: str, manifest_path: str, s: Settings = DEFAULTS) -> DataFrame:
    """The rows of sessions that the manifest names. Marking a session is what commits it: rows
    that a build wrote before it was stopped are in neither, and the next build replaces them."""
    keys, pinned = pin_small(load_manifest(spark, manifest_path), s)
    return join_pinned(load_dataset(spark, path), keys, pinned, SESSION, "left_semi")


def load_session(spark: SparkSession, path: str, season: int, round_number: int, session_name: str) -> DataFrame:
    """Rows of one session; the key prunes partitions."""
    key = {"season": season, "round_number": round_number, "session_name": session_name}
    df = load_dataset(spark, path)
    for c, v in key.items():
        df = df.filter(F.col(c) == v)
    return df


def write_sessions(records: DataFrame, path: str) -> None:
    """Replace the sessions present in `records`, and only those.

    Rows are gathered by session into files of about the advisory partition size: a small session
    is one file, a large one is cut into several by as many tasks.
    """
    (
        to_schema(records)
        .hint("rebalance", *[F.col(c) for c in SESSION])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SESSION)
        .parquet(path)
    )


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, MANIFEST).distinct()


def mark_built(sessions: DataFrame, path: str) -> None:
    """Add session keys; adding one again changes nothing that is read back."""
    known = load_manifest(sessions.sparkSession, path)
    new = sessions.select(*SESSION).distinct().join(known, SESSION, "left_anti")
    to_schema(new, MANIFEST).write.mode("append").parquet(path)


def pending_sessions(sessions: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    keys = sessions.select(*SESSION).distinct()
    return keys if force else keys.join(manifest, SESSION, "left_anti")


def select_sessions(
    schedule: DataFrame, seasons: list[int], rounds: list[int] | None = None
) -> DataFrame:
    """Sessions of the seasons, without round 0; explicit rounds replace the schedule's."""
    picked = schedule.filter(F.col("season").isin(seasons) & (F.col("round_number") > 0))
    return picked.filter(F.col("round_number").isin(rounds)) if rounds else picked


def with_session_key(df: DataFrame) -> DataFrame:
    return df.withColumn("session_key", session_key())


def build_pending(
    sessions: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    dataset_path: str,
    manifest_path: str,
    force: bool = False,
) -> DataFrame:
    """Build all sessions not yet in the manifest in one job, store their rows, and only
    then mark those that yielded any. `build` maps session keys to lap records."""
    spark = sessions.sparkSession
    pending = pending_sessions(sessions, load_manifest(spark, manifest_path), force)
    if pending.isEmpty():
        return pending
    built = settle(build(pending))
    write_sessions(built, dataset_path)
    mark_built(built.select(*SESSION).distinct().join(pending, SESSION, "left_semi"), manifest_path)
    return pending


def export_lookups(records: DataFrame, defaults: DataFrame, path: str) -> None:
    """Tables a scoring job reads instead of the laps: circuits, defaults, oldest age."""
    known = records.filter(F.col("circuit").isNotNull())
    known.select("circuit").distinct().write.mode("overwrite").parquet(f"{path}/circuits")
    defaults.write.mode("overwrite").parquet(f"{path}/defaults")
    known.groupBy("circuit").agg(F.max("tire_age_laps").alias("max_age_laps")).write.mode("overwrite").parquet(
        f"{path}/max_age"
    )
