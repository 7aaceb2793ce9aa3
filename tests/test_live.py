"""Alerts and document states on streams that arrive shuffled, late and repeated, against plain Python over the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import alerts as A
from paperloom.streaming import events as S
from paperloom.streaming import lifecycle as L

START = 1_700_000_000 // 3600 * 3600


def arrive(spark, rows, schema, folder, files, delay, seed):
    """Rows as files, each row delayed by up to `delay` seconds, so that files overlap in time; in reach of the watermark."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[0] + rng.random() * delay)
    size = -(-len(order) // files)
    for k in range(files):
        part = order[k * size : (k + 1) * size]
        rng.shuffle(part)
        if part:
            spark.createDataFrame([tuple(r) for r in part], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{folder}/f{k:03d}")
    one = spark.read.parquet(f"{folder}/f000").schema
    return spark.readStream.schema(one).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/f*")


RULES = (
    A.Rule("p95", "quantile", "latency", 300, 3.0, 120, q=0.95, buckets=(1.0, 2.0, 4.0, 8.0)),
    A.Rule("low", "quantile", "score", 600, 0.6, 180, q=0.5, buckets=(0.3, 0.6, 0.9), above=False),
    A.Rule("errors", "ratio", "error", 300, 0.3, 120, of=("done", "error")),
    A.Rule("spike", "spike", "review", 120, 1.4, 60, of=("done",), base=900),
    A.Rule("rate", "rate", "fallback", 120, 0.02, 60),
)


def expected_alerts(rows, rules, step, until):
    """Each instant from all rows at once."""
    out = []
    for r in rules:
        own = [x for x in rows if x[1] == r.metric or x[1] in r.of]
        since = last = None
        for instant in range(START - 3600, until + 1, step):
            inside = lambda m, span: [v for t, k, v in own if k in m and instant - span <= t < instant]
            value = None
            if r.kind == "quantile":
                seen = inside((r.metric,), r.span)
                if seen:
                    cum, value = 0, r.buckets[-1]
                    for k, le in enumerate(r.buckets):
                        n = sum(v <= le for v in seen)
                        if n >= r.q * len(seen):
                            low = r.buckets[k - 1] if k else 0.0
                            value = low + (le - low) * (r.q * len(seen) - cum) / (n - cum)
                            break
                        cum = n
            elif r.kind == "rate":
                value = sum(inside((r.metric,), r.span)) / r.span or None
            else:
                share = lambda span: sum(inside((r.metric,), span)) / sum(inside(r.of, span)) if sum(inside(r.of, span)) else None
                value = share(r.span)
                if r.kind == "spike" and value is not None:
                    value = value / share(r.base) if share(r.base) else None
            if value is None or not (value > r.threshold if r.above else value < r.threshold):
                since = None
                continue
            since = instant if since is None or last != instant - step else since
            last = instant
            out.append((r.name, instant, round(value, 6), since, "firing" if instant - since >= r.hold else "pending"))
    return sorted(out)


def metric_rows(seed, n=900, span=5400):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        t = START + rng.random() * span
        bad = (t - START) % 1800 > 1100  # a bad third of every half hour
        if 2600 < t - START < 3300:  # nothing is reported
            continue
        rows += [(t, "latency", rng.expovariate(0.35 if bad else 1.5)), (t, "score", rng.random() * (0.8 if bad else 1.0)), (t, "done", 1.0)]
        rows += [(t, m, 1.0) for m, p in (("error", 0.6), ("review", 0.7), ("fallback", 0.4)) if rng.random() < (p if bad else p / 4)]
    return rows


def test_alerts_equal_plain_python_however_rows_arrive(spark, tmp_path):
    rows = metric_rows(1)
    results = []
    for k, (files, delay) in enumerate(((1, 0), (5, 110))):
        stream = arrive(spark, rows, "t double, metric string, value double", str(tmp_path / f"in{k}"), files, delay, k)
        out, _ = S.drain(A.alerts(stream, RULES, 60, "2 minutes"), str(tmp_path / f"out{k}"), "append")
        results.append(sorted((r.rule, r.instant, round(r.value, 6), r.since, r.state) for r in out.collect()))
    until = int(max(t for t, _, _ in rows)) - 120
    assert results[0] == expected_alerts(rows, RULES, 60, until) and {r[4] for r in results[0]} == {"pending", "firing"} and {r[0] for r in results[0]} == {r.name for r in RULES}
    assert results[1] == results[0]


def test_rows_beyond_the_lateness_are_dropped(spark, tmp_path):
    rows = [(START + 60.0 * k, "fallback", 9.0) for k in range(30)]
    late = [(START + 5.0, "fallback", 500.0)]  # comes when the watermark is half an hour ahead
    folder = str(tmp_path / "in")
    for k, part in enumerate((rows[:28], rows[28:], late)):  # what is late counts by the watermark of the micro-batch before
        spark.createDataFrame(part, "t double, metric string, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{folder}/f{k}")
    stream = spark.readStream.schema("metric string, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/f*")
    rules = (A.Rule("rate", "rate", "fallback", 120, 0.02, 60),)
    out, _ = S.drain(A.alerts(stream, rules, 60, "2 minutes"), str(tmp_path / "out"), "append")
    assert sorted((r.rule, r.instant, round(r.value, 6), r.since, r.state) for r in out.collect()) == expected_alerts(rows, rules, 60, START + 29 * 60 - 120)


def test_rules(spark):
    assert all(r.hold and r.span for r in A.RULES) and A.scaled(A.RULES, 12, VLMFallbackSpike=9)[6].threshold == 9 and A.scaled(A.RULES, 12)[4].base == 43200
    with pytest.raises(ValueError, match="multiples"):
        A.alerts(spark.createDataFrame([], "ts timestamp, metric string, value double"), RULES, 70)
    assert A.quantile(0.5, (1.0, 2.0), [0, 0, 0]) is None and A.quantile(0.5, (1.0, 2.0), [0, 0, 4]) == 2.0 and A.quantile(0.5, (1.0, 2.0), [2, 2, 0]) == 1.0


def expected_moves(log, ttl, retries, until):
    """One document after another, one event after another; times in ms."""
    out = []
    for doc in {r[1] for r in log}:
        state, failures, deadline = "none", 0, None
        events = sorted({(t, seq, op) for t, d, seq, op in log if d == doc and t <= until})
        for t, seq, op in [*events, (until, None, None)]:
            while state == "processing" and deadline < t:
                failures += 1
                state = "failed" if failures > retries else state
                out.append((doc, None, deadline, "expired", state, failures, "dead_letter" if state == "failed" else "moved"))
                deadline += ttl
            if op is None:
                continue
            before = state
            if (state, op) == ("none", "upload"):
                state = "uploaded"
            elif (state, op) == ("uploaded", "start"):
                state, deadline = "processing", t + ttl
            elif state == "processing" and op in ("done", "review"):
                state = {"done": "completed", "review": "needs_review"}[op]
            elif state == "processing" and op == "error":
                failures, deadline = failures + 1, t + ttl
                state = "failed" if failures > retries else "processing"
            moved = state != before or (before, op) == ("processing", "error")
            out.append((doc, seq, t, op, state, failures, "dead_letter" if state == "failed" and moved else "moved" if moved else "rejected"))
    return sorted(out, key=repr)


def test_lifecycle_equals_plain_python(spark, tmp_path):
    rng, log = random.Random(4), []
    for k in range(60):
        t = START + rng.random() * 2000
        for seq, op in enumerate(["upload", "start", *rng.choices(["start", "done", "review", "error", "upload"], [1, 2, 2, 6, 1], k=rng.randint(0, 7))]):
            log.append((t, f"d{k}", seq, op if rng.random() > 0.05 else "done"))
            t += rng.choice([0.0, 5.25, 40.0, 110.0, 250.0, 900.0])
    repeated = [*log, *rng.sample(log, 60)]
    until = int((max(r[0] for r in log) - 300) * 1000)
    want = expected_moves([(int(t * 1000), d, s, o) for t, d, s, o in log], 200_000, 2, until)
    for k, (files, delay) in enumerate(((1, 0), (4, 280))):
        stream = arrive(spark, repeated, "t double, doc_id string, seq long, op string", str(tmp_path / f"in{k}"), files, delay, k)
        moves, _ = S.drain(L.lifecycle(stream, ttl=200, late="5 minutes"), str(tmp_path / f"out{k}"), "append")
        assert sorted((tuple(r) for r in moves.select(*L.COLUMNS).collect()), key=repr) == want
    assert {w[6] for w in want} == {"moved", "rejected", "dead_letter"} and any(w[3] == "expired" for w in want)
    dead = {w[0] for w in want if w[6] == "dead_letter"}
    assert {r.doc_id for r in L.dead_letters(moves).collect()} == dead
    final = {r.doc_id: (r.state, r.failures) for r in L.states(moves).collect()}
    assert all(final[d] == ("failed", 3) for d in dead) and set(final) == {w[0] for w in want}


def test_ended_documents_are_forgotten(spark, tmp_path):
    log = [(START + t, d, s, op) for t, d, s, op in [(0, "a", 0, "upload"), (1, "a", 1, "start"), (2, "a", 2, "done"), (30, "a", 3, "upload"), (200, "a", 4, "upload"), (900, "z", 0, "upload")]]
    stream = arrive(spark, [(float(t), *r) for t, *r in log], "t double, doc_id string, seq long, op string", str(tmp_path / "in"), 1, 0, 0)
    moves, _ = S.drain(L.lifecycle(stream, ttl=200, late="5 minutes", keep=100), str(tmp_path / "out"), "append")
    assert [(r.op, r.outcome, r.state) for r in moves.filter("doc_id = 'a'").orderBy("at").collect()] == [("upload", "moved", "uploaded"), ("start", "moved", "processing"), ("done", "moved", "completed"), ("upload", "rejected", "completed"), ("upload", "moved", "uploaded")]
