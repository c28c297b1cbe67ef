"""Streams that come in several batches: late rows, state across batches, repeats."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import events as S

DAY = dt.datetime(2024, 1, 10)


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files, a batch each: the third has two rows behind the watermark that the first one set, and one within it."""
    batches = [
        [(1, DAY.replace(hour=12), 7, "a", 1.0), (2, DAY.replace(hour=13), 7, "a", 2.0)],
        [(4, DAY.replace(hour=14), 8, "a", 8.0), (1, DAY.replace(hour=12), 7, "a", 1.0)],
        [(3, DAY - dt.timedelta(days=8), 7, "a", 4.0), (5, DAY - dt.timedelta(hours=2), 8, "a", 16.0), (6, DAY - dt.timedelta(days=3), 8, "b", 32.0)],
    ]
    os.makedirs(tmp_path / "events")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        part = next((tmp_path / f"part{k}").glob("*.parquet"))
        os.rename(part, tmp_path / "events" / f"{k}.parquet")
        os.utime(tmp_path / "events" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return f"{tmp_path}/events"


def test_late_rows_are_left_out_of_windows(spark, folder):
    kept = S.run(S.windows(S.stream(spark, folder, 1), "6 hours"), "update", lambda r: r.groupBy("start", "event_type").agg(F.max("n").alias("n"), F.max("total").alias("total")))
    got = {(dt.datetime.fromtimestamp(r.start, dt.UTC).replace(tzinfo=None), r.event_type): (r.n, r.total) for r in kept.collect()}
    assert got == {(DAY.replace(hour=12), "a"): (4, 12.0), (DAY - dt.timedelta(hours=6), "a"): (1, 16.0)}
    whole = S.windows(spark.read.parquet(folder), "6 hours").count()  # a table has no watermark: nothing is late
    assert whole == 4


def test_state_and_repeats_across_batches(spark, folder):
    totals = S.run(S.running_totals(S.stream(spark, folder, 1), late="30 days"), "update", lambda r: r.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")))
    assert {r.user_id: (r.n, r.total) for r in totals.collect()} == {7: (4, 8.0), 8: (3, 56.0)}
    once = S.run(S.distinct_events(S.stream(spark, folder, 1), ("event_id",), late="30 days").select("event_id"), "append")
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("name", ["stream_window", "stream_sliding", "approximate_users"])
def test_windows_take_times_in_whole_seconds(spark, tmp_path, name):
    """As the SQL has it: the last half second of a window counts in the next, a half goes to the even second."""
    from lodestone import parity
    from lodestone.plans.registry import ORACLES, QUERIES

    edge = DAY.replace(hour=6)
    near = [edge - dt.timedelta(microseconds=us) for us in (1, 499_999, 500_000, 500_001, 1_500_000)] + [edge, edge + dt.timedelta(microseconds=500_000), DAY.replace(hour=8, minute=59, second=59, microsecond=700_000)]
    rows = [(k, at, k % 3, "a", 1.0) for k, at in enumerate(near)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    same, what = parity.compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))
    assert same, what
