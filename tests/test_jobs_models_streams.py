import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom.operators import models
from paperloom.plans.jobs import Notes, State, Step, run_job, training_steps
from paperloom.plans.registry import ORACLE, QUERIES
from paperloom.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_steps_resume_and_retry(spark, tmp_path):
    calls = []

    def flaky(before):
        calls.append(1)
        if len(calls) < 2:
            raise ValueError("once")
        return 7

    notes = Notes(spark, str(tmp_path))
    got = run_job([Step("a", flaky), Step("b", lambda before: before["a"] + 1)], notes)
    assert (got["a"].state, got["a"].value, got["a"].faults, got["b"].value) == (State.DONE, 7, ["ValueError: once"], 8)
    got = run_job([Step("a", flaky), Step("c", lambda before: 1 / 0), Step("d", lambda before: 1)], notes)
    assert (got["a"].state, got["a"].value, len(calls)) == (State.REUSED, 7, 2)
    assert got["c"].state == State.FAILED and len(got["c"].faults) == 2 and got["d"].state == State.WAITING
    assert notes.get("manifest")["c"]["state"] == "failed" and notes.get("c") is None
    assert run_job([Step("a", flaky)], notes, fresh=True)["a"].state == State.DONE and len(calls) == 3


def test_promotion_gate(spark, tmp_path):
    done = []

    def run(name, score, valid=True):
        steps = training_steps(lambda b: 1, lambda b: valid, lambda b: 1, lambda b: score, lambda b: done.append(name))
        return [r.state.value for r in run_job(steps, Notes(spark, str(tmp_path / name))).values()]

    assert run("good", 0.7) == ["done"] * 5
    assert run("bad", 0.5) == ["done", "done", "done", "refused", "waiting"]
    assert run("void", 0.9, False) == ["done", "refused", "waiting", "waiting", "waiting"]
    assert done == ["good"]


def test_models(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("double").alias("label")).withColumn("f", F.col("label") * 2 + F.sin(F.col("id").cast("double"))).withColumn("g", F.cos(F.col("id").cast("double")))
    train, test = models.split(df, "id")
    assert train.count() + test.count() == 600 and 60 < test.count() < 180
    got = models.probabilities(models.fit(train, ["f", "g"]), test)
    assert got.filter((F.get("p", 1) >= 0.5) == (F.col("label") == 1)).count() > 0.85 * test.count()
    cal = models.score_calibrated(models.fit_calibrated(train, ["f", "g"], "id"), test)
    assert cal.filter((F.col("p") >= 0.5) == (F.col("label") == 1)).count() > 0.85 * test.count() and cal.filter("p < 0 or p > 1").count() == 0


def test_learned_fields_and_types(spark, monkeypatch):
    """Right on documents that the fit hasn't seen; every document and field has a row."""
    from paperloom.operators import evaluation, learned
    from paperloom.plans.dialect import Spark, run

    monkeypatch.setattr(learned, "SAMPLE", 300)

    gold = run(spark, SF, f"SELECT doc_id, field, gold FROM ({evaluation.gold_fields(Spark())}) g")
    got = learned.field_scores(spark, SF).join(gold, ["doc_id", "field"]).cache()
    _, test = models.split(got, "doc_id")
    assert got.count() == gold.count() and test.filter("value <=> gold").count() > 0.9 * test.count() and got.filter("confidence < 0 or confidence > 1").count() == 0
    types = learned.document_types(spark, SF)
    right = types.filter("doc_type = CASE substr(doc_id, 1, 1) WHEN 'r' THEN 'receipt' WHEN 's' THEN 'bank_statement' ELSE 'payment_order' END")
    assert right.count() > 0.95 * types.count()


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sliding", "stream_sessions"])
def test_streams_equal_batch(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert [tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows] == sorted(want.fetchall())


def test_once_and_progress(spark, tmp_path):
    out, progress = S.drain(S.once_by_key(S.read_events(spark, f"{SF}/events.parquet")), str(tmp_path), "append")
    assert out.count() == out.select("user_id", "props").distinct().count()
    assert S.batch_statistics(progress)["items"] == 1000


def test_held(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2026, 1, 1)
    ok = [1, 1, 1, 1, 0, 1, 1, 1]
    spark.createDataFrame([Row(name="a", ts=t0 + datetime.timedelta(minutes=k), ok=bool(v)) for k, v in enumerate(ok)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("name string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    out, _ = S.drain(S.held(ticks), str(tmp_path), "append")
    assert sorted(r.streak for r in out.collect()) == [3, 3, 4]
