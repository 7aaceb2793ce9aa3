"""Alerts over metric streams: quantiles, ratios and rates of trailing windows, held for a time before they fire.

Two stateful steps. Event-time windows of one step count each metric (and the bucket of each observation), partly in the map tasks, so a
metric that most events belong to is no hot key; a window is passed on once the watermark has closed it. Then each rule, as a key, keeps
the closed steps of its longest span and evaluates every instant by an event-time timer, in order of time. So the result doesn't
depend on the order of rows or of files, as long as no row is later than the allowed lateness; rows that are later are dropped.

metrics(ts, metric, value): a row for each increment of a counter or each observation of a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rule:
    """When a value of the trailing `span` seconds stays beyond the threshold for `hold` seconds.

    kind: quantile (q of the observations of `metric`, by their buckets), ratio (of the sum of `metric` to those of `of`), rate (of `metric`, a
    second) or spike (the ratio against that of `base` seconds).
    """

    name: str
    kind: str
    metric: str
    span: int
    threshold: float
    hold: int
    of: tuple[str, ...] = ()
    q: float = 0.0
    buckets: tuple[float, ...] = ()
    base: int = 0
    above: bool = True

    @property
    def longest(self) -> int:
        return max(self.span, self.base)


_STAGE = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0, 2.0, 5.0, 10.0)
#: The alerting rules, with the buckets of their histograms.
RULES = (
    Rule("HighLatencyP95", "quantile", "stage_latency_total", 300, 3, 300, q=0.95, buckets=_STAGE),
    Rule("OCRStageLatencyP95", "quantile", "stage_latency_ocr", 300, 2, 300, q=0.95, buckets=_STAGE),
    Rule("HighDecodeErrorRate", "ratio", "decode_error", 600, 0.05, 300, of=("documents_processed", "decode_error")),
    Rule("CriticalHumanReviewRate", "ratio", "human_review", 600, 0.90, 600, of=("documents_processed",)),
    Rule("NeedsReviewSpike", "spike", "human_review", 300, 1.4, 300, of=("documents_processed",), base=3600),
    Rule("HighRiskAutoAcceptSpike", "rate", "high_risk_auto_accept", 600, 0.05, 600),
    Rule("VLMFallbackSpike", "rate", "vlm_fallback", 600, 0.3, 600),
    Rule("InputBlurDrift", "quantile", "input_blur_score", 3600, 50, 1800, q=0.5, buckets=(20, 50, 100, 200, 400, 800), above=False),
    Rule("ConfidenceDrop", "quantile", "field_confidence", 3600, 0.6, 1800, q=0.5, buckets=(0.3, 0.5, 0.6, 0.7, 0.75, 0.85, 0.95, 1.0), above=False),
)


def scaled(rules: tuple[Rule, ...], factor: int, **thresholds: float) -> tuple[Rule, ...]:
    """The rules with all times longer by a factor, and other thresholds by name."""
    return tuple(replace(r, span=r.span * factor, hold=r.hold * factor, base=r.base * factor, threshold=thresholds.get(r.name, r.threshold)) for r in rules)


def value_of(rule: Rule, sums, instant: int) -> float | None:
    """The rule's value at an instant. sums(since, slot): the sum of a slot over the steps from `since` to the instant; null if there is nothing to tell."""
    if rule.kind == "quantile":
        return quantile(rule.q, rule.buckets, [sums(instant - rule.span, k) for k in range(len(rule.buckets) + 1)])
    own = sums(instant - rule.span, _OWN)
    if rule.kind == "rate":
        return own / rule.span if own else None
    ratio = lambda since: sums(since, _OWN) / n if (n := sums(since, _OF)) else None
    now = ratio(instant - rule.span)
    if rule.kind == "ratio" or now is None:
        return now
    base = ratio(instant - rule.base)
    return now / base if base else None


def quantile(q: float, bounds: tuple[float, ...], counts: list[float]) -> float | None:
    """By buckets: linear within one; the open one gives its lower bound."""
    total, below = sum(counts), 0.0
    if not total:
        return None
    for k, (le, n) in enumerate(zip(bounds, counts)):
        if below + n >= q * total and n:
            low = bounds[k - 1] if k else 0.0
            return low + (le - low) * (q * total - below) / n
        below += n
    return bounds[-1]


#: Slots of a rule's sums besides its buckets: its metric and what that is held against.
_OWN, _OF = -1, -2

STEPS = "rule string, at timestamp, slot int, n double"


def steps(metrics: DataFrame, rules: tuple[Rule, ...], step: int, late: str) -> DataFrame:
    """Sums of each rule's slots by step: rule, at (the step's end), slot, n."""
    slots = []
    for r in rules:
        if r.kind == "quantile":
            bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in r.buckets]), lambda b: F.col("value") > b))
            slots.append(F.when(F.col("metric") == r.metric, F.struct(F.lit(r.name).alias("rule"), bucket.alias("slot"), F.lit(1.0).alias("n"))))
        else:
            slots.append(F.when(F.col("metric") == r.metric, F.struct(F.lit(r.name).alias("rule"), F.lit(_OWN).alias("slot"), F.col("value").alias("n"))))
            slots.append(F.when(F.col("metric").isin(*r.of), F.struct(F.lit(r.name).alias("rule"), F.lit(_OF).alias("slot"), F.col("value").alias("n"))) if r.of else F.lit(None))
    rows = metrics.withWatermark("ts", late).select("ts", F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("s"))
    w = rows.groupBy(F.window("ts", f"{step} seconds").alias("w"), "s.rule", "s.slot").agg(F.sum("s.n").alias("n"))
    return w.select("rule", "w", F.col("w.end").alias("at"), "slot", "n")


class Evaluator(StatefulProcessor):
    """State of a rule: the sums of its last steps by slot (a rule's longest span of them), and since when its condition has been true."""

    def __init__(self, rules: dict[str, Rule], step: int):
        self.rules, self.step = rules, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "at array<long>, slot array<int>, n array<double>")
        self.since = handle.getValueState("since", "since long, last long")

    def held(self) -> dict[tuple[int, int], float]:
        return {(int(at), int(slot)): float(n) for at, slot, n in zip(*self.sums.get())} if self.sums.exists() else {}

    def keep(self, held: dict[tuple[int, int], float]) -> None:
        self.sums.update(([at for at, _ in held], [slot for _, slot in held], list(held.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule, held, ends = self.rules[key[0]], self.held(), set()
        for frame in rows:
            for at, slot, n in zip(frame["at"], frame["slot"], frame["n"]):
                place = int(at.timestamp()), int(slot)
                held[place] = held.get(place, 0.0) + float(n)
                ends.add(place[0])
        self.keep(held)
        for instant in {end + k for end in ends for k in range(0, rule.longest, self.step)}:
            self.handle.registerTimer(instant * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rule, instant = self.rules[key[0]], expiredTimerInfo.getExpiryTimeInMs() // 1000
        held = self.held()
        value = value_of(rule, lambda since, slot: sum(n for (end, s), n in held.items() if s == slot and since < end <= instant), instant)
        if any(end <= instant + self.step - rule.longest for end, _ in held):  # no later instant will need these
            self.keep({place: n for place, n in held.items() if place[0] > instant + self.step - rule.longest})
        if value is None or not (value > rule.threshold if rule.above else value < rule.threshold):
            self.since.clear()
            return
        since, last = self.since.get() if self.since.exists() else (instant, instant)
        if instant - last > self.step:  # nothing was there in between
            since = instant
        self.since.update((since, instant))
        yield pd.DataFrame({"rule": [key[0]], "instant": [instant], "value": [round(value, 9)], "since": [since], "state": ["firing" if instant - since >= rule.hold else "pending"]})

    def close(self) -> None:
        pass


def alerts(metrics: DataFrame, rules: tuple[Rule, ...] = RULES, step: int = 60, late: str = "2 minutes") -> DataFrame:
    """rule, instant, value, since, state (pending or firing): a row for every instant, a step apart, at which a rule's condition is true.

    An instant is evaluated once the watermark has passed it and only if the rule's longest span holds a row. Instants of no value break a hold.
    """
    if any(t % step for r in rules for t in (r.span, r.hold, r.base)):
        raise ValueError("spans and holds must be multiples of the step")
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    by = {r.name: r for r in rules}
    return steps(metrics, rules, step, late).groupBy("rule").transformWithStateInPandas(Evaluator(by, step), "rule string, instant long, value double, since long, state string", "Append", "EventTime")


def batch(d, rules: tuple[Rule, ...], metrics: str, step: int, late: int) -> str:
    """The same as SQL over a table of metrics(t, metric, value), t in seconds: instants up to `late` seconds before the last row. d: the dialect."""
    parts = []
    for r in rules:
        spans = {"own": r.span, **({"base": r.base} if r.kind == "spike" else {})}
        wide = []
        cols = {f"b{k}": f"CASE WHEN metric = '{r.metric}' AND value <= {float(b)!r} THEN 1 ELSE 0 END" for k, b in enumerate(r.buckets)} if r.kind == "quantile" else {}
        cols |= {"m": f"CASE WHEN metric = '{r.metric}' THEN {'1' if r.kind == 'quantile' else 'value'} ELSE 0 END", "o": "CASE WHEN metric IN (" + ", ".join(f"'{x}'" for x in r.of or ("",)) + ") THEN value ELSE 0 END"}
        tick = f"SELECT CAST(floor(t / {step}) * {step} + {step} AS BIGINT) AS stop, " + ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {c}" for c, x in cols.items()) + f" FROM ({metrics}) m WHERE metric IN (" + ", ".join(f"'{x}'" for x in {r.metric, *r.of}) + ") GROUP BY 1"
        for k in range(0, r.longest, step):
            wide.append(f"({k})")
        sums = ", ".join(f"sum(CASE WHEN k < {span} THEN {c} ELSE 0 END) AS {c}_{name}" for name, span in spans.items() for c in cols)
        trail = f"SELECT stop + k AS instant, {sums} FROM ({tick}) s CROSS JOIN (VALUES {', '.join(wide)}) AS o(k) GROUP BY stop + k"
        ratio = lambda n: f"(m_{n} / nullif(o_{n}, 0))"
        if r.kind == "quantile":
            cum = lambda k: f"b{k}_own" if k >= 0 else "0"
            value = "CASE WHEN m_own = 0 THEN NULL " + " ".join(f"WHEN b{k}_own >= {r.q} * m_own THEN {float(r.buckets[k - 1]) if k else 0.0} + {float(b) - (float(r.buckets[k - 1]) if k else 0.0)} * ({r.q} * m_own - {cum(k - 1)}) / (b{k}_own - {cum(k - 1)})" for k, b in enumerate(r.buckets)) + f" ELSE {float(r.buckets[-1])} END"
        else:
            value = {"ratio": ratio("own"), "rate": f"(nullif(m_own, 0) / {r.span})", "spike": f"({ratio('own')} / nullif({ratio('base')}, 0))" if r.base else ""}[r.kind]
        ok = f"SELECT instant, CAST({value} AS DOUBLE) AS value FROM ({trail}) t WHERE instant <= (SELECT max(t) - {late} FROM ({metrics}) e)"
        true = f"SELECT instant, value, instant - {step} * row_number() OVER (ORDER BY instant) AS island FROM ({ok}) v WHERE value {'>' if r.above else '<'} {r.threshold}"
        parts.append(f"SELECT '{r.name}' AS rule, instant, round(value, 9) AS value, min(instant) OVER (PARTITION BY island) AS since, CASE WHEN instant - min(instant) OVER (PARTITION BY island) >= {r.hold} THEN 'firing' ELSE 'pending' END AS state FROM ({true}) i")
    return " UNION ALL ".join(parts)
