import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import recognition as C
from paperloom.operators import images as I


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("v")).first().v


def test_reply_and_transactions(spark):
    assert value(spark, C.reply_json(F.col("s"), "a int"), s='x {"a": 3} y').a == 3
    assert value(spark, C.reply_json(F.col("s"), "a int"), s="none") is None
    got = value(spark, C.transactions(F.col("s")), s='[{"date": "1/2/26", "description": "ABC", "amount": "-4,500"}, null, 7, "x", {"other": 1}]')
    assert [tuple(t) for t in got] == [("2026-02-01", "abc", -4500.0, None)]


def test_codec(spark):
    assert value(spark, C.encode_chars(F.col("s"), "abc"), s="ca?b") == [3, 1, 2]
    assert value(spark, C.collapse(F.col("x"), "abc"), x=[1, 1, 0, 1, 2, 2, 0]) == "aab"
    assert value(spark, C.softmax(F.col("x")), x=[1.0, 1.0]) == [0.5, 0.5]
    assert value(spark, C.nfc(F.col("s")), s="é") == "é"


def test_wer(spark):
    assert value(spark, C.wer("p", "g"), p="a b d", g="a b c") == pytest.approx(1 / 3)
    assert value(spark, C.wer("p", "g"), p="", g="") == 0 and value(spark, C.wer("p", "g"), p="x", g="") == 1


def test_wer_equals_brute_force(spark):
    import random

    r = random.Random(2)
    rows = [(" ".join(r.choices("a b c dd é 日本".split(), k=r.randrange(12))), "  ".join(r.choices("a b c dd é 日本".split(), k=r.randrange(12)))) for _ in range(80)]

    def distance(p, g):
        best = {(0, j): j for j in range(len(g) + 1)} | {(i, 0): i for i in range(len(p) + 1)}
        for i in range(1, len(p) + 1):
            for j in range(1, len(g) + 1):
                best[i, j] = min(best[i - 1, j] + 1, best[i, j - 1] + 1, best[i - 1, j - 1] + (p[i - 1] != g[j - 1]))
        return best[len(p), len(g)]

    got = {(x.p, x.g): x.v for x in spark.createDataFrame(rows, "p string, g string").select("p", "g", C.wer("p", "g").alias("v")).collect()}
    for p, g in rows:
        want = distance(p.split(), g.split()) / len(g.split()) if g.split() else float(bool(p.split()))
        assert got[p, g] == pytest.approx(want)


def page(angle=0.0):
    y, x = np.mgrid[:600, :700]
    t = np.radians(angle)
    u, v = (x - 350) * np.cos(t) + (y - 300) * np.sin(t), -(x - 350) * np.sin(t) + (y - 300) * np.cos(t)
    return np.where((abs(u) < 200) & (abs(v) < 100), 0, 255).astype(np.uint8)


def test_quality():
    assert I.quality(page())["skew"] == pytest.approx(0, abs=0.5) and not I.quality(page())["rotated"]
    assert I.quality(page(10))["skew"] == pytest.approx(10, abs=0.5) and I.quality(page(10))["rotated"]
    flat = I.quality(np.full((500, 500), 200, np.uint8))
    assert flat["blurry"] and not flat["dark"] and not flat["low_resolution"] and not flat["quality_pass"]
    rng = np.random.default_rng(1).integers(0, 256, (500, 400)).astype(np.uint8)
    q = I.quality(rng)
    assert q["quality_pass"] and q["low_resolution"] and not q["dark"]


def test_size_plan(spark):
    plan = lambda h, w: tuple(value(spark, I.size_plan(F.col("h"), F.col("w")), h=h, w=w))
    assert plan(1000, 2000) == (1000, 2000) and plan(360, 720) == (720, 1440) and plan(6000, 3000) == (3000, 1500)


@pytest.mark.parametrize("kind", ["dark", "low_contrast", "fade", "noise", "blur", "motion_blur", "low_res", "tear", "rotate", "perspective", "mixed"])
@pytest.mark.parametrize("shape", [(60, 80), (60, 80, 3)])
def test_degrade(kind, shape):
    img = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    got = I.degrade(img, kind, 0.7, 3)
    assert got.shape == shape and got.dtype == np.uint8 and (got != img).any()
    assert (got == I.degrade(img, kind, 0.7, 3)).all()


def test_projection_rows():
    img = np.full((100, 50), 255, np.uint8)
    img[10:30, 5:45] = 0
    img[50:75, 5:45] = 0
    assert I.projection_rows(img, (0, 0, 50, 100)) == [[0, 10, 50, 30], [0, 50, 50, 75]]
    assert I.projection_rows(img[:40], (0, 0, 50, 40)) == []


def test_repeats_equal_the_pattern_and_are_quick(spark):
    import random
    import time

    r = random.Random(5)
    texts = [None, "", "abcd" * 5, "abcd" * 4 + "abc", "aaaa" * 5, "a" * 19, "ab\u2028cd" * 9, "x" * 7 + "\n" + "y" * 20]
    for _ in range(1500):
        block = "".join(r.choice("ab é\n\U0001f600") for _ in range(r.randint(1, 9)))
        texts.append("".join(r.choice("ab \n") for _ in range(r.randint(0, 30))) + block * r.randint(1, 8) + "".join(r.choice("abc") for _ in range(r.randint(0, 12))))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {x.k: (x.a, x.b) for x in rows.select("k", C.repeats("t").alias("a"), rows.t.rlike(r"(.{4,})\1{4,}").alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and 100 < sum(a is True for a, _ in got.values()) < 1400
    long = "".join(r.choice("abcdefgh ") for _ in range(4000))
    C.has_repeats(long)
    began = time.perf_counter()
    assert not any(C.has_repeats(long) for _ in range(20)) and time.perf_counter() - began < 1
    assert C.has_repeats(long[:1000] + long[:500] * 5)
