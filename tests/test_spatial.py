"""Box joins against all pairs, and near-linear work on a large page."""

import random

from pyspark.sql import functions as F

from paperloom.operators import spatial

SCHEMA = "page string, id long, x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n, pages):
    out = []
    for k in range(n):
        x, y = rng.choice([0.0, 8.0, 16.0, rng.uniform(-300, 300)]), rng.choice([0.0, -8.0, rng.uniform(-300, 300)])
        side = lambda: rng.choice([0.0, 8.0, rng.uniform(0, 3), rng.uniform(0, 60), rng.uniform(0, 900)])
        out.append((rng.choice(pages), k, x, y, x + side(), y + side()))
    return out


def test_touching_equals_all_pairs(spark):
    rng = random.Random(1)
    a, b = boxes(rng, 300, ["p", "q", None]), boxes(rng, 250, ["p", "q", "r", None])
    a += [("p", 900, None, 0.0, 1.0, 1.0), ("p", 901, 5.0, 0.0, 4.0, 9.0), ("p", 902, 0.0, 0.0, 1e-9, 1e-9)]
    got = [(r.l_id, r.r_id) for r in spatial.touching(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "page").collect()]
    ok = lambda r: None not in r and r[4] >= r[2] and r[5] >= r[3]
    want = {(l[1], r[1]) for l in a for r in b if ok(l) and ok(r) and l[0] == r[0] and max(l[2], r[2]) <= min(l[4], r[4]) and max(l[3], r[3]) <= min(l[5], r[5])}  # noqa: E741
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    none = spark.createDataFrame([], SCHEMA)
    assert spatial.touching(none, spark.createDataFrame(b, SCHEMA), "page").count() == 0 and spatial.touching(spark.createDataFrame(a, SCHEMA), none, "page").count() == 0


def test_share(spark):
    pair = spatial.touching(spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 10.0)], SCHEMA), spark.createDataFrame([("p", 2, 5.0, 5.0, 20.0, 20.0), ("p", 3, 10.0, 0.0, 11.0, 1.0)], SCHEMA), "page")
    assert {r.r_id: r.s for r in pair.select("r_id", spatial.overlap_share().alias("s")).collect()} == {2: 0.25, 3: 0.0}


def test_a_large_page_makes_no_square(spark):
    """100,000 boxes against 100,000 regions of one page: rows that meet in a cell stay near the pairs that touch."""
    side = 316
    made = spark.range(side * side).select(F.lit("p").alias("page"), "id", (F.col("id") % side * 20.0).alias("x0"), (F.floor(F.col("id") / side) * 20.0).alias("y0")).withColumn("x1", F.col("x0") + 12).withColumn("y1", F.col("y0") + 12)
    regions = made.withColumn("x0", F.col("x0") + 6).withColumn("x1", F.col("x1") + 6)
    pairs = spatial.touching(made, regions, "page")
    assert pairs.count() == side * side  # each region overlaps the box it was shifted from, and no other
    assert pairs.filter("l_id <> r_id").count() == 0
    met = spatial._filed(made.toDF(*[f"l_{c}" for c in made.columns]), "l_", spatial._levels(regions.toDF(*[f"r_{c}" for c in regions.columns]), "r_")).count()
    assert met <= 4 * side * side


def test_nearest_span_equals_all_pairs(spark):
    rng = random.Random(2)
    points = [(rng.choice(["p", "q", "none"]), k, rng.choice([10.0, 15.0, 20.0, rng.uniform(0, 200)])) for k in range(300)]
    spans = [(rng.choice(["p", "q"]), j, lo, lo + rng.choice([0.0, 10.0, 30.0])) for j, lo in enumerate(rng.choices([0.0, 5.0, 10.0, 40.0, 90.0, 150.0, 151.5], k=24))]
    got = {r.id: r.idx for r in spatial.nearest_span(spark.createDataFrame(points, "page string, id long, at double"), spark.createDataFrame(spans, "page string, idx long, lo double, hi double"), "page", "at").collect()}
    want = {}
    for page, k, at in points:
        own = [(not lo <= at <= hi, 0 if lo <= at <= hi else abs(at - (lo + hi) / 2), j) for p, j, lo, hi in spans if p == page]
        if own:
            want[k] = min(own)[2]
    assert got == want
