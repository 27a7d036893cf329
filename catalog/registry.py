"""Registration of queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.sql import sql as with_tables
from stintwise.operators.lookup import scratch_path
from stintwise.plans.lap_record import SessionTables
from stintwise.sources import driver_tables as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_tables(sql)
        return fn

    return register


def tables(spark: SparkSession, sf_dir: str) -> SessionTables:
    return SessionTables.of(
        D.laps(spark, sf_dir), D.weather(spark, sf_dir), D.telemetry(spark, sf_dir), D.corners(spark, sf_dir)
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines, without negative zero."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


_STORED: dict[tuple, str] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, fit: Callable, write: Callable) -> str:
    """Where `write(fit(), path)` put its result: once a session for the tables of a folder, so that
    queries which score with the same model do not fit it again."""
    key = (spark, sf_dir, name)
    if key not in _STORED:
        made = fit()
        path = scratch_path(spark)
        write(made, path)
        _STORED[key] = path
    return _STORED[key]
