"""Event streams: windows with watermarks, sessions, deduplication, and an as-of state per user.

The batch functions take any DataFrame with an event time, streaming or not; run() drives a streaming one over
what is there now and leaves the result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.scratch import shared_dir


def stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream; its time column ts as a timestamp. Files come by their age, all at once or so many a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}").withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, width: str = "6 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, users, total) of tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w, "event_type")
    return g.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total")).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "users", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between any two."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: tuple[str, ...], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else marked.dropDuplicates(list(key))


def running_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, n, total): a state for each user, updated as events come; of a stream only."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def run(result: DataFrame, mode: str = "complete", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a streaming result over everything that is there, and read what it wrote.

    complete: each batch replaces the table. append and update: each batch adds rows, and merge, if there is one,
    makes the table of them. Progress and files lie in the shared folder, so a restarted driver goes on.
    """
    spark = result.sparkSession
    at = f"{shared_dir(spark)}/lodestone/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(result.schema).parquet(f"{at}/out").select(*result.columns)
    return merge(out) if merge else out
