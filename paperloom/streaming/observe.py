"""What stages of a job and micro-batches of a stream did, measured while they run: no further job counts anything."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STAGE = "stage string, place int, seconds double, metrics map<string, long>"


class Stages:
    """Runs stages one after another, each written to a table that the next one reads, and keeps their times and observed counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.rows = spark, folder.rstrip("/"), []

    def run(self, name: str, build: Callable[[], DataFrame], **counts: Column) -> DataFrame:
        """The stage's table. Always counts its rows, as `rows`; counts: further aggregates, whole numbers."""
        seen = Observation(name)
        began = time.monotonic()
        build().observe(seen, F.count("*").alias("rows"), *[c.cast("long").alias(k) for k, c in counts.items()]).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.rows.append((name, len(self.rows), time.monotonic() - began, {k: int(v or 0) for k, v in seen.get.items()}))
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def table(self) -> DataFrame:
        """A row for each stage: stage, place, seconds, metrics."""
        return self.spark.createDataFrame(self.rows, STAGE)


class Progress(StreamingQueryListener):
    """Rows, milliseconds and observed metrics of each micro-batch that held rows, by query. Attach it with spark.streams.addListener.

    A query's batches are told by its run; they can be read once the query has ended.
    """

    def __init__(self):
        self.batches: dict[str, list[dict]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _done(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._done(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            seen: Mapping = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
            self.batches.setdefault(str(p.runId), []).append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "observed": seen})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._done(str(event.runId)).set()

    def of(self, query, seconds: float = 60) -> list[dict]:
        """The micro-batches of a query that has ended; waits for the listener to hear of it."""
        if not self._done(str(query.runId)).wait(seconds):
            raise TimeoutError(f"nothing heard of the end of {query.runId}")
        return self.batches.get(str(query.runId), [])
