"""Requests are spread by their number before they grow."""

from pyspark.sql import functions as F

from stintwise.operators import life


def test_a_task_gets_a_bounded_number_of_requests(spark, monkeypatch):
    monkeypatch.setattr(life, "REQUESTS", 10)
    swept = life.sweep(spark.range(400).withColumnRenamed("id", "q"), ["q"], life.half_lap_ages())
    held = swept.groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("q").alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in held) == 400 * 119 and sum(r["n"] for r in held) == 400
    assert len(held) > 30 and max(r["n"] for r in held) < 30
