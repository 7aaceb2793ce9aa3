from pyspark.sql import functions as F

from paperloom.functions import normalise as N


def values(spark, fn, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", fn(F.col("t")).alias("v")).orderBy("k").collect()
    return [r.v for r in rows]


def test_money(spark):
    assert values(spark, N.norm_money, ["235,000", "1.250.000", "25.12.2018", None, "x 9.00"]) == [235000.0, 1.25, None, None, 9.0]


def test_date(spark):
    assert values(spark, N.norm_date, ["31/05/2026", "1/2/26", "45/13/2026", "none", None]) == ["2026-05-31", "2026-02-01", "2026-13-45", None, None]


def test_signed_money(spark):
    got = values(spark, N.signed_money, ["-4,500,000", "30,063,058", "(1,500,000)", "9,900,000 CR", "4,500,000 DR", "4,500,000DR", ""])
    assert got == [-4500000.0, 30063058.0, -1500000.0, 9900000.0, -4500000.0, 4500000.0, None]


def test_payment_and_text(spark):
    assert values(spark, N.norm_payment, ["QR Pay"]) == ["QR"]
    assert values(spark, N.norm_text, ["  A \n b  ", None]) == ["a b", ""]
    assert values(spark, N.norm_invoice, ["invoice hd1234"]) == ["HD1234"]


def test_payment_normalises_a_text_once(spark):
    plan = spark.range(1).select(N.norm_payment(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
