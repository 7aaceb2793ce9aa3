"""Structured Streaming over event files: micro-batches, windows with a watermark, keys kept once, held alerts.

Event-time windows and watermarks are additions; the batch forms of the alerts are in the registry.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Event files as a stream; a micro-batch takes at most so many files. path: a file or a folder of files."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a lone file may be a source too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def sliding_errors(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Share of errors over trailing windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error")).select(F.unix_timestamp("w.end").alias("instant"), "n", "n_error")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("stop"), "n")


def once_by_key(events: DataFrame, keys=("user_id", "props"), late: str = "1 day") -> DataFrame:
    """The first event of a key; a key is forgotten after the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def held(ticks: DataFrame, hold: int = 3, late: str = "1 hour") -> DataFrame:
    """ticks(name, ts, ok): a row each time a condition has been true for `hold` ticks in a row; a false tick starts anew.

    Ticks of a name are taken in order of time within a micro-batch, so micro-batches must come in order.
    """

    def step(key, frames, state: GroupState):
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows.ts, rows.ok):
            streak = streak + 1 if ok else 0
            if streak >= hold:
                out.append((key[0], ts, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["name", "ts", "streak"])

    return ticks.withWatermark("ts", late).groupBy("name").applyInPandasWithState(step, "name string, ts timestamp, streak long", "streak long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> tuple[DataFrame, list]:
    """Runs a stream over all that is there now into Parquet files; returns (their table, progress of each micro-batch).

    complete: the table is what the last micro-batch wrote; append: what all wrote. A repeated micro-batch overwrites its own folder.
    """
    base = f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch, k):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{base}/out").drop("batch"), q.recentProgress


def batch_statistics(progress: list) -> dict:
    """Micro-batches, rows, and the largest micro-batch."""
    sizes = [p["numInputRows"] for p in progress if p["numInputRows"]]
    return {"batches": len(sizes), "items": sum(sizes), "max_seen": max(sizes, default=0)}
