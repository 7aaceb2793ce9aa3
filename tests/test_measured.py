"""Calibrated estimator, observed stages and micro-batches, word distance without a vocabulary limit, inversions without pairs."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from paperloom.functions import recognition as C
from paperloom.operators import models
from paperloom.operators.calibrated import CalibratedClassifier, CalibratedModel
from paperloom.operators.scan import inversions
from paperloom.streaming.observe import Progress, Stages


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.range(900).select("id", (F.col("id") % 3 == 0).cast("double").alias("label"))
    return df.withColumn("f", F.col("label") * 2 + F.pmod(F.xxhash64("id"), F.lit(400)) / 100 - 2).withColumn("g", F.cos(F.col("id").cast("double"))).cache()


def test_estimator_in_a_pipeline_saved_and_loaded(labelled, tmp_path):
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["f", "g"], outputCol="v"), CalibratedClassifier(keyCol="id", featuresCol="v", probabilityCol="p", predictionCol="guess", threshold=0.4)])
    pipeline.write().overwrite().save(str(tmp_path / "estimator"))
    model = Pipeline.load(str(tmp_path / "estimator")).fit(labelled)
    got = model.transform(labelled)
    assert got.columns == ["id", "label", "f", "g", "v", "p", "guess"]
    rows = {r.id: r for r in got.collect()}
    assert all(0 < r.p < 1 and r.guess == float(r.p >= 0.4) for r in rows.values())
    assert sum(r.guess == r.label for r in rows.values()) > 0.7 * len(rows)
    model.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(back.stages[-1], CalibratedModel) and back.stages[-1].uid == model.stages[-1].uid and back.stages[-1].getOrDefault("threshold") == 0.4
    assert all(r.p == rows[r.id].p and r.guess == rows[r.id].guess for r in back.transform(labelled).collect())


def test_estimator_agrees_with_the_functions(labelled):
    by_functions = models.score_calibrated(models.fit_calibrated(labelled, ["f", "g"], "id"), labelled)
    stage = CalibratedClassifier(keyCol="id", featuresCol="v")
    v = VectorAssembler(inputCols=["f", "g"], outputCol="v").transform(labelled)
    both = stage.fit(v).transform(v).join(by_functions.select("id", F.col("p").alias("q")), "id")
    assert both.filter(F.abs(F.col("probability") - F.col("q")) > 1e-6).count() == 0 and both.count() == 900
    clash = v.withColumn("features", F.lit("x")).withColumn("raw", F.lit("y"))
    assert stage.fit(clash).transform(clash).select("features", "raw").first() == ("x", "y")


def test_calibrated_probabilities_match_shares(labelled):
    v = VectorAssembler(inputCols=["f", "g"], outputCol="v").transform(labelled)
    got = CalibratedClassifier(keyCol="id", featuresCol="v").fit(v).transform(v)
    low, high = got.filter("probability < 0.3"), got.filter("probability > 0.7")
    assert low.agg(F.avg("label")).first()[0] < 0.35 and high.agg(F.avg("label")).first()[0] > 0.6


def test_stages_measure_what_their_tables_hold(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    a = stages.run("numbers", lambda: spark.range(1000), odd=F.count_if(F.col("id") % 2 == 1))
    b = stages.run("kept", lambda: a.filter("id % 10 = 0"), largest=F.max("id"))
    c = stages.run("none", lambda: b.filter("id < 0"), largest=F.max("id"))
    got = {r.stage: r for r in stages.table().collect()}
    assert (got["numbers"].metrics, got["kept"].metrics, got["none"].metrics) == ({"rows": 1000, "odd": 500}, {"rows": 100, "largest": 990}, {"rows": 0, "largest": 0})
    assert [got[s].place for s in ("numbers", "kept", "none")] == [0, 1, 2] and all(r.seconds > 0 for r in got.values())
    assert (a.count(), b.count(), c.count()) == (1000, 100, 0)


def test_progress_of_micro_batches(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10 + k).coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    heard = Progress()
    spark.streams.addListener(heard)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/f*")).observe("seen", F.count("*").alias("n"), F.max("id").alias("top"))
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        batches = heard.of(q)
    finally:
        spark.streams.removeListener(heard)
    assert sorted(b["rows"] for b in batches) == [10, 11, 12] and [b["batch"] for b in batches] == [0, 1, 2]
    assert {b["observed"]["seen"]["n"]: b["observed"]["seen"]["top"] for b in batches} == {10: 9, 11: 20, 12: 31}
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(b["rows"] for b in batches)


def slow_distance(p, g):
    row = list(range(len(g) + 1))
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(g, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance():
    rng = random.Random(3)
    for n in range(300):
        p, g = (rng.choices("abcd", k=rng.randrange(20)) for _ in range(2))
        assert C.word_distance(p, g) == slow_distance(p, g)
    many = [f"w{k}" for k in range(1500)]
    other = many[3:700] + ["x", "y"] + many[650:1400:2] + many[:50]
    assert C.word_distance(other, many) == slow_distance(other, many)


def test_fifty_thousand_distinct_words(spark):
    """The edits are known: every hundredth word replaced, every thousandth dropped, one put in front."""
    gold = [f"w{k}" for k in range(50_000)]
    pred = ["first"] + [f"x{k}" if k % 100 == 7 else w for k, w in enumerate(gold) if k % 1000 != 13]
    rows = spark.createDataFrame([(" ".join(pred), " ".join(gold)), (None, "a b"), ("a", None), (None, None)], "p string, g string")
    assert [r.v for r in rows.select(C.wer("p", "g").alias("v")).collect()] == [pytest.approx((500 + 50 + 1) / 50_000), 1.0, 1.0, 0.0]


def test_inversions_equal_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), k, rng.choice([None, *range(0, 40)])) for k in range(500)] + [(9, 1, 5), (10, 1, 1), (10, 2, 1), (11, 1, 2), (11, 2, 1)]
    got = {r.img: (r.n, r.inverted, r.inversions) for r in inversions(spark.createDataFrame(rows, "img int, box int, y int"), "img", ["box"], "y", parts=6).collect()}
    want = {}
    for img in (1, 2, 3, 9, 10, 11):
        ys = [y for i, _, y in sorted((r for r in rows if r[0] == img), key=lambda r: r[1]) if y is not None]
        n = sum(a > b for k, a in enumerate(ys) for b in ys[k + 1 :])
        want[img] = (len(ys), int(n > 0), n)
    got.pop(None, None)
    assert got == want


def test_inversions_of_a_large_page(spark):
    """A page of 20,000 boxes in falling order, which has as many inversions as pairs."""
    df = spark.range(20_000).select(F.lit(1).alias("img"), F.col("id").alias("box"), (20_000 - F.col("id")).alias("y"))
    assert inversions(df, "img", ["box"], "y").first().inversions == 20_000 * 19_999 // 2


def test_models_work_after_something_was_observed(spark, labelled, tmp_path):
    """A fitted model's summary would hold the session, which isn't serialisable any more then."""
    Stages(spark, str(tmp_path)).run("one", lambda: spark.range(3))
    model = models.fit(labelled, ["f", "g"])
    assert models.probabilities(model, labelled).filter("p[1] > 1").count() == 0
