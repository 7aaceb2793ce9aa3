"""Prefix scans over hot keys against plain windows and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.scan import Count, Last, Session, Sum, cuts, scan

SCHEMA = "k string, t double, id long, a long, b long"
OPS = [Sum("a", "total"), Count("n"), Last("b", "known"), Session("t", 5.0, "session")]


def expected(rows):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for own in by.values():
        total = known = last = None
        session = 0
        for n, (k, t, i, a, b) in enumerate(sorted(own, key=lambda r: (r[1], r[2])), 1):
            total = total if a is None else (total or 0) + a
            session += last is not None and t - last > 5.0
            out[k, i] = (total, n, known, session)
            known, last = known if b is None else b, t
    return out


def made(seed, n, hot):
    rng = random.Random(seed)
    keys = ["hot"] * hot + [None] * 3 + [f"k{j}" for j in range(10)]
    return [(rng.choice(keys), float(rng.randint(0, n)) / 2, j, rng.choice([None, rng.randint(-9, 9)]), rng.choice([None, None, rng.randint(0, 99)])) for j in range(n)]


@pytest.mark.parametrize("hot, parts", [(0, 4), (7, 4), (40, 16), (500, 3)])
def test_equals_plain_python(spark, hot, parts):
    rows = made(hot, 1500, hot)
    got = {(r.k, r.id): (r.total, r.n, r.known, r.session) for r in scan(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "id"], OPS, parts=parts).collect()}
    assert got == expected(rows)


def test_a_hot_key_is_split(spark):
    rows = [("hot", float(j), j, 1, None) for j in range(4000)] + [(f"k{j}", float(j), j, 1, 1) for j in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA)
    hot = cuts(df, ["k"], F.col("t"), parts=8)
    assert [h[0] for h in hot] == ["hot"]
    edges = [-1.0, *hot[0][1], 4000.0]
    sizes = [sum(a < t <= b for t in range(4000)) for a, b in zip(edges, edges[1:])]
    assert len(sizes) == 11 and max(sizes) <= 1.1 * 12000 / 32  # none over a quarter of a partition's fair share by much
    out = scan(df, ["k"], ["t", "id"], OPS, parts=8)
    assert "__block" in out._jdf.queryExecution().optimizedPlan().toString()
    last = out.filter("k = 'hot' and t = 3999").first()
    assert (last.total, last.n, last.known, last.session) == (4000, 4000, None, 0)


def test_ties_and_odd_rows(spark):
    rows = [("hot", 1.0, j, 1, j % 3 or None) for j in range(300)] + [("hot", 50.0, 300 + j, 2, None) for j in range(100)]  # one place holds most of the key
    got = {(r.k, r.id): (r.total, r.n, r.known, r.session) for r in scan(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "id"], OPS, parts=8).collect()}
    assert got == expected(rows)
    empty = scan(spark.createDataFrame([], SCHEMA), ["k"], ["t", "id"], OPS)
    assert empty.count() == 0 and empty.columns == ["k", "t", "id", "a", "b", "total", "n", "known", "session"]
    nulls = spark.createDataFrame([(None, None, 1, 5, 7), (None, 2.0, 2, 6, None)], SCHEMA)
    assert sorted((r.id, r.total, r.n, r.known) for r in scan(nulls, ["k"], ["t", "id"], OPS[:3]).collect()) == [(1, 5, 1, None), (2, 11, 2, 7)]


def test_two_keys_and_own_spread(spark):
    rows = [(f"k{j % 2}", float(j % 4), j, j, None) for j in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit(1))
    out = scan(df, ["g", "k"], ["t", "id"], [Sum("a", "total")], spread=F.col("t") * 1000 + F.col("id"), parts=4)
    want = {}
    for key in ("k0", "k1"):
        total = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += r[3]
            want[r[2]] = total
    assert {r.id: r.total for r in out.collect()} == want
