"""Queries of the stateful streams: the events table as a metric stream and as a document log, drained, against SQL over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import layout as R
from ..sources import render
from ..streaming import alerts as A
from ..streaming import events as S
from ..streaming import lifecycle as L
from ..streaming.observe import Progress, Stages
from .dialect import Duck, Spark, run, shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}

#: Events come by the hour, so all times are twelve times as long; thresholds fit what the table holds.
STEP, LATE = 3600, 3600
RULES = A.scaled(A.RULES, 12, HighLatencyP95=1.6, OCRStageLatencyP95=0.8, HighDecodeErrorRate=0.2, CriticalHumanReviewRate=0.3, HighRiskAutoAcceptSpike=0.0008, VLMFallbackSpike=0.0009, InputBlurDrift=45, ConfidenceDrop=0.92)
#: What an event reports: (metric, value, when).
REPORTS = (
    ("documents_processed", "CAST(1 AS DOUBLE)", "TRUE"), ("decode_error", "CAST(1 AS DOUBLE)", "event_type = 'error'"), ("human_review", "CAST(1 AS DOUBLE)", "event_type = 'view'"),
    ("high_risk_auto_accept", "CAST(1 AS DOUBLE)", "event_type = 'signup'"), ("vlm_fallback", "CAST(1 AS DOUBLE)", "event_type = 'purchase'"), ("stage_latency_total", "abs(value) / 100", "TRUE"),
    ("stage_latency_ocr", "abs(value) / 200", "event_type = 'click'"), ("input_blur_score", "abs(value)", "TRUE"), ("field_confidence", "1 - abs(value) / 600", "TRUE"),
)


def metrics(d) -> str:
    return " UNION ALL ".join(f"SELECT {d.epoch('ts')} AS t, '{m}' AS metric, {value} AS value FROM events WHERE {when}" for m, value, when in REPORTS)


QUERIES["alert_rules"] = lambda spark, sf_dir: run(spark, sf_dir, A.batch(Spark(), RULES, metrics(Spark()), STEP, LATE))
ORACLE["alert_rules"] = A.batch(Duck(), RULES, metrics(Duck()), STEP, LATE)
COVERS["alert_rules"] = "M3 M4 M5 M6 M7 M8 M9 M10"


def alerts_live(spark, sf_dir):
    events = S.read_events(spark, f"{sf_dir}/events.parquet")
    reports = F.array(*[F.when(F.expr(when), F.struct(F.lit(m).alias("metric"), F.expr(value).alias("value"))) for m, value, when in REPORTS])
    rows = events.select("ts", F.explode(F.filter(reports, lambda r: r.isNotNull())).alias("r")).select("ts", "r.metric", "r.value")
    return S.drain(A.alerts(rows, RULES, STEP, f"{LATE} seconds"), shared_folder(spark), "append")[0]


QUERIES["alerts_live"], ORACLE["alerts_live"], COVERS["alerts_live"] = alerts_live, ORACLE["alert_rules"], "M3 M4 M5 M6 M7 M8 M9 M10"

#: A user's events of five days are the log of a document; an attempt may take a day.
SPAN, TTL = 432_000, 86_400
OPS = {"signup": "upload", "view": "start", "purchase": "done", "click": "review", "error": "error"}


def document_states(spark, sf_dir):
    events = S.read_events(spark, f"{sf_dir}/events.parquet")
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("event_type")]
    log = events.select(F.concat_ws(".", "user_id", F.floor(F.unix_timestamp("ts") / SPAN).cast("long")).alias("doc_id"), F.col("event_id").alias("seq"), "ts", op.alias("op"))
    return L.states(S.drain(L.lifecycle(log, TTL, f"{LATE} seconds"), shared_folder(spark), "append")[0])


QUERIES["document_states"], COVERS["document_states"] = document_states, "M15 S18"
_OP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPS.items()) + " END"
ORACLE["document_states"] = f"""
WITH RECURSIVE log AS (SELECT CAST(user_id AS VARCHAR) || '.' || CAST(CAST(floor(epoch(ts) / {SPAN}) AS BIGINT) AS VARCHAR) AS doc_id, event_id AS seq, epoch_ms(ts) AS t, {_OP} AS op FROM events),
u AS (SELECT max(t) - {LATE * 1000} AS until FROM log),
e AS (SELECT doc_id, t, op, row_number() OVER (PARTITION BY doc_id ORDER BY t, seq) AS rn FROM log, u WHERE t <= until),
z AS (SELECT * FROM e UNION ALL SELECT doc_id, (SELECT until FROM u), 'end', max(rn) + 1 FROM e GROUP BY doc_id),
s AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS rn, 'none' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS deadline, CAST(0 AS BIGINT) AS n_rejected FROM z
  UNION ALL
  SELECT doc_id, rn,
    CASE WHEN op = 'upload' AND state = 'none' THEN 'uploaded' WHEN op = 'start' AND state = 'uploaded' THEN 'processing' WHEN op = 'done' AND state = 'processing' THEN 'completed' WHEN op = 'review' AND state = 'processing' THEN 'needs_review'
      WHEN op = 'error' AND state = 'processing' AND failures = {L.RETRIES} THEN 'failed' ELSE state END,
    failures + CASE WHEN op = 'error' AND state = 'processing' THEN 1 ELSE 0 END,
    CASE WHEN op = 'start' AND state = 'uploaded' OR op = 'error' AND state = 'processing' THEN t + {TTL * 1000} ELSE deadline END,
    n_rejected + CASE WHEN op = 'end' OR op = 'upload' AND state = 'none' OR op = 'start' AND state = 'uploaded' OR op IN ('done', 'review', 'error') AND state = 'processing' THEN 0 ELSE 1 END
  FROM (
    SELECT doc_id, next AS rn, op, t, n_rejected, failures + x AS failures, CASE WHEN failures + x > {L.RETRIES} THEN 'failed' ELSE state END AS state, deadline + x * {TTL * 1000} AS deadline FROM (
      SELECT s.*, z.op, z.t, z.rn AS next, CASE WHEN s.state = 'processing' AND z.t > s.deadline THEN least({L.RETRIES + 1} - s.failures, (z.t - s.deadline - 1) // {TTL * 1000} + 1) ELSE 0 END AS x FROM s JOIN z ON z.doc_id = s.doc_id AND z.rn = s.rn + 1
    ) a
  ) b
)
SELECT doc_id, state, CAST(failures AS INTEGER) AS failures, n_rejected FROM s WHERE rn = (SELECT max(rn) FROM z WHERE z.doc_id = s.doc_id)"""


def measured_stages(spark, sf_dir):
    """Receipts through lines, fields and routing, each stage a table, with what was observed while it ran."""
    stages = Stages(spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}")
    view = lambda df, name: df.createOrReplaceTempView(name) or f"SELECT * FROM {name}"
    tokens = stages.run("tokens", lambda: run(spark, sf_dir, render.receipts(Spark())), unsure=F.count_if(F.col("conf") < 0.75))
    text = view(tokens, "measured_tokens")
    stages.run("lines", lambda: spark.sql(R.lines(Spark(), text)), longest=F.max("n_tokens"))
    fields = stages.run("fields", lambda: spark.sql(R.fields(Spark(), text)), empty=F.count_if(F.col("value").isNull()))
    stages.run("routing", lambda: spark.sql(R.routing(Spark(), view(fields, "measured_fields"))), review=F.count_if(F.col("needs_review") == 1))
    return stages.table().select("stage", "place", F.col("metrics")["rows"].alias("n"), F.aggregate(F.map_values(F.map_filter("metrics", lambda k, v: k != "rows")), F.lit(0).cast("long"), lambda a, v: a + v).alias("seen"))


QUERIES["measured_stages"], COVERS["measured_stages"] = measured_stages, "R8"
ORACLE["measured_stages"] = " UNION ALL ".join(
    f"SELECT '{name}' AS stage, {k} AS place, count(*) AS n, CAST({seen} AS BIGINT) AS seen FROM ({sql}) t"
    for k, (name, seen, sql) in enumerate([("tokens", "sum(CASE WHEN conf < 0.75 THEN 1 ELSE 0 END)", render.receipts(Duck())), ("lines", "max(n_tokens)", R.lines(Duck(), render.receipts(Duck()))), ("fields", "sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)", R.fields(Duck())), ("routing", "sum(needs_review)", R.routing(Duck()))])
)


def stream_batches(spark, sf_dir):
    """What a listener heard of a stream over files: rows of all micro-batches and the largest, against the rows that the sink holds."""
    at = f"{shared_folder(spark)}/heard-{uuid.uuid4().hex}"
    run(spark, sf_dir, "SELECT event_id, event_type, ts, event_id % 4 AS part FROM events").write.partitionBy("part").parquet(f"{at}/in")
    heard = Progress()
    spark.streams.addListener(heard)
    try:
        stream = spark.readStream.schema("event_id long, event_type string, ts timestamp_ntz, part int").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        q = stream.observe("kinds", F.count_if(F.col("event_type") == "error").alias("errors")).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
        batches = heard.of(q)
    finally:
        spark.streams.removeListener(heard)
    row = (sum(b["rows"] for b in batches), sum(b["observed"]["kinds"]["errors"] for b in batches), len(batches) >= 1)
    kept = spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n_kept"))
    return kept.select(F.lit(row[0]).cast("long").alias("n_heard"), F.lit(row[1]).cast("long").alias("n_errors"), F.lit(row[2]).alias("in_batches"), "n_kept")


QUERIES["stream_batches"], COVERS["stream_batches"] = stream_batches, "M1 M2"
ORACLE["stream_batches"] = "SELECT count(*) AS n_heard, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, true AS in_batches, count(*) AS n_kept FROM events"
