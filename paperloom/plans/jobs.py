"""Jobs as lists of declared steps. What a step gave is noted in a folder that Spark reads and writes; a later run of the job takes up there."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from enum import StrEnum

from pyspark.sql import SparkSession


class State(StrEnum):
    DONE = "done"
    REUSED = "reused"
    FAILED = "failed"
    REFUSED = "refused"  # done, but its result bars the rest of the job
    WAITING = "waiting"


@dataclass(frozen=True)
class Step:
    """work gets the values of the steps before it, by name, and returns a JSON value. The job goes on if `accept` holds for that."""

    name: str
    work: Callable[[dict], object]
    tries: int = 2
    accept: Callable[[object], bool] = lambda value: True


@dataclass
class Record:
    state: State = State.WAITING
    value: object = None
    seconds: float = 0.0
    faults: list[str] = field(default_factory=list)  # of the tries that failed


class Notes:
    """JSON texts by name, each in a folder of its own under `root`; any store that Spark writes will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, name: str, value) -> None:
        self.spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}")

    def get(self, name: str):
        """None if nothing was put whole; Spark marks a finished write."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        if mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
            return json.loads(self.spark.read.text(f"{self.root}/{name}").first().value)
        return None


def attempt(work: Callable[[], object], tries: int) -> tuple[bool, object, list[str]]:
    """Whether some try succeeded, what it gave, and the faults of the others."""
    faults: list[str] = []
    while len(faults) < tries:
        try:
            return True, work(), faults
        except Exception as fault:  # noqa: BLE001 - whatever a step raises uses up a try
            faults.append(f"{type(fault).__name__}: {fault}")
    return False, None, faults


def run_job(steps: Iterable[Step], notes: Notes, fresh: bool = False) -> dict[str, Record]:
    """Records by step. The first step that fails or is refused leaves those after it waiting. fresh: nothing noted is taken over."""
    steps = list(steps)
    records = {s.name: Record() for s in steps}
    values: dict[str, object] = {}
    for s in steps:
        r, noted = records[s.name], None if fresh else notes.get(s.name)
        if noted is not None:
            r.state, r.value = State.REUSED, noted["value"]
        else:
            began = time.monotonic()
            good, r.value, r.faults = attempt(lambda s=s: s.work(dict(values)), s.tries)
            r.state, r.seconds = State.DONE if good else State.FAILED, round(time.monotonic() - began, 2)
            if good:
                notes.put(s.name, {"value": r.value})
        values[s.name] = r.value
        if r.state != State.FAILED and not s.accept(r.value):
            r.state = State.REFUSED
        if r.state in (State.FAILED, State.REFUSED):
            break
    notes.put("manifest", {name: asdict(r) for name, r in records.items()})
    return records


def training_steps(ingest, validate, train, evaluate, promote, least: float = 0.6) -> list[Step]:
    """A model is promoted if its data are valid and its score reaches the gate."""
    return [Step("ingest", ingest), Step("validate", validate, accept=bool), Step("train", train), Step("evaluate", evaluate, accept=lambda score: score >= least), Step("promote", promote)]


@dataclass
class Budget:
    """Limits of a long loop: `spent` says which one is reached, or gives an empty text. gauge: what is used of a resource just now."""

    seconds: float
    most: float = float("inf")
    gauge: Callable[[], float] = lambda: 0.0
    began: float = field(default_factory=time.monotonic)

    def spent(self) -> str:
        used = self.gauge()
        if used > self.most:
            return f"resource:{used:g}"
        return "time" if time.monotonic() - self.began > self.seconds else ""


def load_round(work: Callable[[int], object], n: int, workers: int = 8) -> dict:
    """Send n requests from a few threads: how many completed, how many raised, and the median and 95th percentile of their milliseconds."""
    from concurrent.futures import ThreadPoolExecutor

    def one(k: int) -> tuple[bool, float]:
        start = time.monotonic()
        good, _, _ = attempt(lambda: work(k), 1)
        return good, (time.monotonic() - start) * 1000

    with ThreadPoolExecutor(workers) as pool:
        done = list(pool.map(one, range(n)))
    took = sorted(ms for good, ms in done if good)
    at = lambda share: round(took[min(len(took) - 1, int(share * len(took)))], 1) if took else None
    return {"n": n, "completed": len(took), "errors": n - len(took), "p50": at(0.5), "p95": at(0.95)}
