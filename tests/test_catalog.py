"""Registered queries beside their SQL on the smallest tables; the full run is check.py."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import as_objects, difference

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "p6_valid_lap", "p8_training_rows", "a1_stint_table", "a7_reference_lap", "j2_nearest_weather", "w2_gap_fill",
    "w7_resample_by_distance", "j6_corner_windows", "a12_corner_summary", "a13_track_summary", "d1_split_chronological",
    "m1_linear_fit", "m3_quadratic_prediction", "a26_default_covariates", "w12_d6_d7_threshold_crossing", "a23_describe",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = as_objects(cur.fetchall(), [c[0] for c in cur.description])
    assert difference(as_objects(df.collect(), df.columns), want) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
