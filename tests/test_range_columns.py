"""The feature ranges write only what they read."""

from catalog import all_queries, models
from stintwise.schema import SESSION


def test_ranges_settle_their_columns_only(spark, monkeypatch):
    seen = []
    settle = models.settle
    monkeypatch.setattr(models, "settle", lambda df, *a: seen.append(df.columns) or settle(df, *a))
    got = all_queries()["a24_feature_ranges"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [[*SESSION, "avg_corner_speed_kph", "track_temp_c"]]
    assert sorted(r.side for r in got) == ["test", "train"]
