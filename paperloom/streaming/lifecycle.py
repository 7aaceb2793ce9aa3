"""Life of a document as a keyed state machine over an event log: uploaded, processing, completed, needs_review or failed.

log(doc_id, seq, ts, op), op one of upload, start, done, review, error. Moves that are legal:

    upload  none -> uploaded              done    processing -> completed
    start   uploaded -> processing        review  processing -> needs_review
    error   processing -> processing (a retry), or failed once RETRIES retries are used up: a dead letter

A document that has been processing for longer than `ttl` seconds has failed that attempt as by an error (op `expired`). Every other event is
rejected and changes nothing. Events count in the order of (ts, seq), however they arrive: each waits in its document's state
until the watermark has passed it. A repeated seq counts once; rows later than the allowed lateness are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .alerts import ROCKS

RETRIES = 2
#: Legal moves by (state, op).
MOVES = {("none", "upload"): "uploaded", ("uploaded", "start"): "processing", ("processing", "done"): "completed", ("processing", "review"): "needs_review"}
ENDED = ("completed", "needs_review", "failed")
OUTPUT = "doc_id string, seq long, at long, op string, state string, failures int, outcome string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class Lifecycle(StatefulProcessor):
    """State of a document: where it stands, its failures, its deadline in milliseconds, and the events that wait for the watermark."""

    def __init__(self, ttl: int, retries: int, keep: int | None):
        self.ttl, self.retries, self.keep = ttl * 1000, retries, None if keep is None else keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, failures int, deadline long")
        self.waiting = handle.getValueState("waiting", "at array<long>, seq array<long>, op array<string>")

    def events(self) -> list[tuple[int, int, str]]:
        return sorted((int(a), int(s), o) for a, s, o in zip(*self.waiting.get())) if self.waiting.exists() else []

    def put(self, events) -> None:
        if events:
            self.waiting.update(([e[0] for e in events], [e[1] for e in events], [e[2] for e in events]))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = {e[:2]: e for e in self.events()}
        for frame in rows:
            for at, seq, op in zip(frame["at"], frame["seq"], frame["op"]):
                events.setdefault((int(at), int(seq)), (int(at), int(seq), op))
        if events:
            self.handle.registerTimer(min(events)[0])  # the first that waits; what is left then sets the next
        self.put(sorted(events.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes all that is due up to the watermark, in order: events, and deadlines that pass between them. One timer a document waits for its first event, not one for each."""
        until = timerValues.getCurrentWatermarkInMs()
        state, failures, deadline = self.now.get() if self.now.exists() else ("none", 0, None)
        events, out = self.events(), []

        def fail(at: int, seq, op: str) -> None:
            nonlocal state, failures, deadline
            failures += 1
            state, deadline = ("failed", None) if failures > self.retries else ("processing", at + self.ttl)
            out.append((key[0], seq, at, op, state, failures, "dead_letter" if state == "failed" else "moved"))

        while True:
            due = events[0] if events and events[0][0] <= until else None
            if state == "processing" and deadline < (due[0] if due else until):
                fail(deadline, None, "expired")
                continue
            if state in ENDED and self.keep is not None and deadline is not None and deadline <= (due[0] if due else until):
                state, failures, deadline = "none", 0, None  # forgotten
                continue
            if not due:
                break
            at, seq, op = events.pop(0)
            if state == "processing" and op == "error":
                fail(at, seq, op)
            elif (to := MOVES.get((state, op))) is not None:
                state, deadline = to, at + self.ttl if to == "processing" else None
                out.append((key[0], seq, at, op, state, failures, "moved"))
            else:
                out.append((key[0], seq, at, op, state, failures, "rejected"))
            if state in ENDED and self.keep is not None and deadline is None:
                deadline = at + self.keep
        self.put(events)
        if events:
            self.handle.registerTimer(events[0][0])
        if state == "none":
            self.now.clear()
        else:
            self.now.update((state, failures, deadline))
        if deadline is not None:
            self.handle.registerTimer(deadline + 1)
        if out:
            frame = pd.DataFrame(out, columns=COLUMNS)
            frame["seq"] = frame["seq"].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def lifecycle(log: DataFrame, ttl: int = 600, late: str = "10 minutes", retries: int = RETRIES, keep: int | None = None) -> DataFrame:
    """A row for each event and each expired attempt: doc_id, seq (null where expired), at (ms), op, the state and failures after it, and the outcome: moved, rejected or dead_letter.

    keep: seconds after which the state of an ended document is forgotten; null keeps it, so that later events are still rejected.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = log.withWatermark("ts", late).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("at"), "op")
    return rows.groupBy("doc_id").transformWithStateInPandas(Lifecycle(ttl, retries, keep), OUTPUT, "Append", "EventTime")


def dead_letters(moves: DataFrame) -> DataFrame:
    return moves.filter("outcome = 'dead_letter'").select("doc_id", "seq", "at", "op", "failures")


def states(moves: DataFrame) -> DataFrame:
    """What became of each document: the state after its last move, its failures, and how many events were rejected."""
    order = F.struct("at", F.coalesce("seq", F.lit(-1)))
    moved = F.col("outcome") != "rejected"
    last = lambda c: F.max_by(F.when(moved, F.col(c)), F.when(moved, order))
    return moves.groupBy("doc_id").agg(F.coalesce(last("state"), F.lit("none")).alias("state"), F.coalesce(last("failures"), F.lit(0)).alias("failures"), F.count_if(~moved).alias("n_rejected"))
