import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluation as E
from paperloom.operators import images as I
from paperloom.operators import models
from paperloom.plans.dialect import Spark
from paperloom.plans.jobs import Budget, load_round
from paperloom.sources import files, reports


def test_report(spark, tmp_path):
    table = spark.createDataFrame([("total", 0.5, None), ("date", 1.0, 3)], "field string, f1 double, n int")
    reports.write_report("Run", {"n": 2, "gate": "PASS"}, table, table, str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r/report"), wholetext=True).collect()]
    assert text == ["# Run\n\n- n=2\n- gate=PASS\n\n| field | f1 | n |\n|---|---|---|\n| date | 1.0 | 3 |\n| total | 0.5 | - |\n"]
    assert spark.read.json(str(tmp_path / "r/raw")).count() == 2


def test_a_large_table_is_no_report(spark, monkeypatch):
    monkeypatch.setattr(reports, "MOST_ROWS", 3)
    assert reports.markdown_lines(spark.range(3)).count() == 5
    with pytest.raises(ValueError, match="3 rows at most"):
        reports.markdown_lines(spark.range(4))


def test_summary(spark):
    fields = spark.createDataFrame([("a", "total", "5", 0.9), ("a", "date", None, 0.0)], "doc_id string, field string, value string, confidence double")
    results = spark.createDataFrame([("a", "receipt", 1), ("b", "payment_order", 0)], "doc_id string, doc_type string, needs_review int")
    got = {r.doc_id: r.summary for r in reports.summary_lines(fields, results).collect()}
    assert got == {"a": "document type: receipt, needs review: yes\n| date | - | 0.00 |\n| total | 5 | 0.90 |", "b": "document type: payment_order, needs review: no"}


def test_registry_log(spark, tmp_path):
    at = str(tmp_path / "log")
    log = [("m", "v1", "register"), ("m", "v1", "production"), ("m", "v2", "register"), ("m", "v2", "production"), ("m", "v3", "register"), ("m", "v9", "production"), ("n", "v1", "register"), ("n", "v2", "register"), ("n", "v1", "staging")]
    for k, (model, version, op) in enumerate(log):
        reports.log_registry(spark, at, k, model, version, op, metrics={"f1": np.float32(0.5), "when": object})
    rows = reports.read_registry(spark, at)
    assert json.loads(rows.first().metrics)["f1"] == 0.5
    rows.createOrReplaceTempView("registry_log")
    state = {(r.model, r.version): r.stage for r in spark.sql(E.registry_state(Spark(), "SELECT * FROM registry_log")).collect()}
    assert state == {("m", "v1"): "archived", ("m", "v2"): "production", ("m", "v3"): "staging", ("n", "v1"): "staging", ("n", "v2"): "staging"}  # v9 was never registered
    assert {r.model: r.active for r in spark.sql(E.registry_active(Spark(), "SELECT * FROM registry_log")).collect()} == {"m": "v2", "n": "v2"}


def test_registry_equals_brute_force(spark):
    import random

    r = random.Random(3)
    log = [(k, f"m{r.randrange(3)}", f"v{r.randrange(4)}", r.choice(["register", "staging", "production", "archived"])) for k in range(200)]
    stages, active, production = {}, {}, {}
    for _, m, v, op in log:
        if op == "register":
            stages[m, v], active[m] = "staging", v
        elif (m, v) in stages:
            stages[m, v] = op
            if op == "production":
                for other in [x for x in stages if x[0] == m and x[1] != v and stages[x] == "production"]:
                    stages[other] = "archived"
                production[m] = v
    spark.createDataFrame(log, "seq long, model string, version string, op string").createOrReplaceTempView("random_log")
    assert {(x.model, x.version): x.stage for x in spark.sql(E.registry_state(Spark(), "SELECT * FROM random_log")).collect()} == stages
    assert {x.model: x.active for x in spark.sql(E.registry_active(Spark(), "SELECT * FROM random_log")).collect()} == {m: production.get(m, v) for m, v in active.items()}


def test_models_persist(spark, tmp_path):
    df = spark.range(200).select(F.sin(F.col("id").cast("double")).alias("f"), (F.sin(F.col("id").cast("double")) > 0).cast("double").alias("label"))
    model = models.fit(df, ["f"])
    reports.save_model(model, str(tmp_path), "kie", "v1")
    p = lambda m: [r.p[1] for r in models.probabilities(m, df).collect()]
    assert p(reports.load_model(str(tmp_path), "kie", "v1")) == p(model)


def rows_of(spark, sql):
    return [tuple(r) for r in spark.sql(sql).collect()]


def test_tagging_scores(spark):
    t = "SELECT * FROM VALUES ('a', 0, 'X', 'X', 0), ('a', 1, 'X', 'Y', 0), ('a', 2, 'O', 'Y', 0), ('a', 3, 'Y', 'O', 0), ('a', 4, 'Y', 'Y', 1), ('b', 0, 'O', 'O', 0), ('b', 1, 'Z', 'Z', 0), ('b', 2, 'Z', 'Z', 0) AS t(doc_id, tok_idx, gold, pred, masked)"
    assert rows_of(spark, E.token_f1(Spark(), t)) == [(3, 2, 2, 0.6)]
    # spans: gold X 0-1, Y 3-4, Z 1-2; predicted X 0-0, Y 1-2, Y 4-4, Z 1-2
    got = {r[0]: r[1:] for r in rows_of(spark, E.entity_f1(Spark(), t))}
    assert got == {"X": (0, 1, 1, 0.0), "Y": (0, 2, 1, 0.0), "Z": (1, 0, 0, 1.0), "all": (1, 3, 2, 0.2857)}


def test_batches(spark):
    rows = "SELECT * FROM VALUES ('a', 'error'), ('a', 'error'), ('b', 'error'), ('b', 'view'), ('c', 'purchase'), ('c', 'view'), ('c', 'signup') AS e(job, outcome)"
    got = {r[0]: r[1:] for r in rows_of(spark, E.batches(Spark(), rows))}
    assert got == {"a": (2, 0, 0, 2, 0, "failed"), "b": (2, 1, 1, 1, 0, "partial_completed"), "c": (3, 3, 1, 0, 1, "completed")}


def test_budget_and_load():
    assert Budget(60).spent() == "" and Budget(-1).spent() == "time" and Budget(60, 5, lambda: 7.5).spent() == "resource:7.5"
    got = load_round(lambda k: 1 / (k % 3), 9)
    assert (got["completed"], got["errors"]) == (6, 3) and got["p50"] <= got["p95"]


def test_levelling():
    y, x = np.mgrid[:600, :700]
    t = np.radians(10)
    u, v = (x - 350) * np.cos(t) + (y - 300) * np.sin(t), -(x - 350) * np.sin(t) + (y - 300) * np.cos(t)
    img = np.where((abs(u) < 200) & (abs(v) < 100), 0, 255).astype(np.uint8)
    report = I.quality(img)
    assert abs(I.quality(I.turn_back(img, report))["skew"]) < 1
    assert I.turn_back(img, {"skew": 0.2, "rotated": True}) is img and I.turn_back(img, {"skew": 50.0, "rotated": True}) is img and I.turn_back(img, {"skew": 9.0, "rotated": False}) is img


def test_recogniser_input():
    got = I.recogniser_input(np.full((16, 40), 255, np.uint8))
    assert got.shape == (1, 32, 256) and got[0, :, :80].min() == 1 and got[0, :, 80:].max() == -1 and got.dtype == np.float32
    assert I.recogniser_input(np.full((4, 4000, 3), 10, np.uint8))[0, :, -1].max() > -1


def test_jitter():
    g = np.random.default_rng(0).integers(0, 256, (40, 120)).astype(np.uint8)
    shapes = {I.jitter(g, np.random.default_rng(k)).shape for k in range(40)}
    assert len(shapes) > 20 and all(30 <= h <= 50 and 95 <= w <= 150 for h, w in shapes)


def chaos(spark, folder):
    import struct
    import zlib

    def png(img):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        h, w = img.shape
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in img))) + chunk(b"IEND", b"")

    rng = np.random.default_rng(0)
    made = {"noise": png(rng.integers(0, 256, (600, 600)).astype(np.uint8)), "blank": png(np.full((600, 600), 255, np.uint8)), "tiny": png(rng.integers(0, 256, (12, 12)).astype(np.uint8)), "corrupt": b"\0\1not-an-image"}
    for name, data in made.items():
        (folder / f"{name}.png").write_bytes(data)
    return files.images(spark, str(folder))


def test_chaos_degrades_gracefully(spark, tmp_path):
    """Noise, a blank page, a tiny image and bytes that are none: a quality row or an error row each, never a crash."""
    images = chaos(spark, tmp_path)
    name = lambda r: r.origin.rsplit("/", 1)[1].split(".")[0]
    quality = {name(r): r for r in I.quality_table(images).collect()}
    assert set(quality) == {"noise", "blank", "tiny"} and quality["blank"].blurry and not quality["blank"].quality_pass and quality["tiny"].low_resolution
    errors = files.error_results(images).collect()
    assert [r.doc_id.rsplit("/", 1)[1] for r in errors] == ["corrupt.png"] and errors[0].needs_review and errors[0].merchant_name is None
    dark = {name(r): r for r in I.quality_table(I.degraded(images, "dark", 1.0)).collect()}
    assert set(dark) == set(quality) and dark["noise"].dark and not quality["noise"].dark


@pytest.mark.parametrize("seed", range(3))
def test_degradations_of_a_crop(seed):
    img = np.random.default_rng(seed).integers(0, 256, (20, 30)).astype(np.uint8)
    assert I.plan_of("mixed", 1.0, seed) == I.plan_of("mixed", 1.0, seed) and I.degrade(img, "mixed", 1.0, seed).shape == img.shape
