"""The stored dataset holds the whole record, telemetry columns included."""

import pytest
from pyspark.sql import functions as F

from catalog import all_queries
from stintwise.sources import dataset

SF = "/root/testdata/sf0.001"
TELEMETRY = ["avg_speed_kph", "avg_throttle_pct", "avg_braking_decel_ms2", "apex_speed_kph"]


@pytest.mark.parametrize("name", ["io2_load_dataset", "io3_rewrite_one_season", "io5_incremental_build"])
def test_stored_rows_have_telemetry(spark, monkeypatch, name):
    written, put = [], dataset.write_sessions

    def seen(records, path):
        written.append(path)
        put(records, path)

    monkeypatch.setattr(dataset, "write_sessions", seen)
    all_queries()[name](spark, SF)
    stored = dataset.load_dataset(spark, written[-1])
    known = all_queries()["d5_lap_record"](spark, SF)
    sums = [F.count("*"), *[F.count(c) for c in TELEMETRY], *[F.round(F.sum(c), 3) for c in TELEMETRY]]
    got, want = stored.agg(*sums).first(), known.agg(*sums).first()
    assert got[1] > 0 and tuple(got) == pytest.approx(tuple(want), abs=0.01)
