"""Nearest neighbours: exact where everything is visited, measured recall elsewhere, and odd rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from paperloom.llm import ann

CLASH = "id v cell row cells score rank ep qp query_id q".split()


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return frame.selectExpr("*", *(f"'x' AS {c}" for c in CLASH))


def answers(result):
    got = {}
    for r in result.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in got.items()}


def exact(x, q):
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[q, d] * x[:, d]
    s[q] = -np.inf
    return s


def test_exact_when_all_are_visited(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[50:200] = x[50]
    got = answers(ann.nearest(frame_of(spark, list(enumerate(x.tolist()))), enough=400))
    assert set(got) == set(range(0, 400, 20))
    for q, rows in got.items():
        s = exact(x, q)
        want = np.lexsort((np.arange(400), -s))[:20].tolist()
        assert [(r, v) for r, v, _ in rows] == list(zip(range(1, 21), want)) and all(z == s[v] for _, v, z in rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(k, [1.0 * k, 1.0]) for k in range(1, 22)] + [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [None, 1.0]), (120, [inf, 1.0]), (140, []), (None, [9.0, 9.0])]
    rows += [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (160, [3.0]), (180, [0.0, 1.0, 2.0])]  # repeats: the smallest counts; shorter and longer ones
    got = answers(ann.nearest(frame_of(spark, rows), top=3))
    assert set(got) == {0, 20, 160, 180}
    assert got[0] == [(1, 21, 21.0), (2, 20, 20.0), (3, 19, 19.0)] and got[160] == [(1, 21, 63.0), (2, 20, 60.0), (3, 19, 57.0)]
    assert got[180] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]  # ties to smaller ids
    for none in ([], [(20, None)], [(20, [0.0])]):
        empty = ann.nearest(frame_of(spark, none))
        assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert answers(ann.nearest(frame_of(spark, [(20, [1.0])]))) == {}
    assert answers(ann.nearest(frame_of(spark, [(20, [2.0]), (1, [1.5])]))) == {20: [(1, 1, 3.0)]}


def table(name):
    t = pq.read_table(f"/root/testdata/{name}/embeddings.parquet")
    return t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), float)


def made(n, dims, clusters=0):
    rng = np.random.default_rng(n + dims)
    x = rng.normal(size=(n, dims))
    if clusters:
        x = rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] + 0.15 * x
    return np.arange(n), x


@pytest.mark.parametrize("name, least", [("sf0.001", 0.9), ("sf0.01", 0.9), ("sf0.1", 0.9), ((4000, 384), 0.9), ((12000, 64), 0.9), ((12000, 64, 100), 0.9), ((3000, 3), 0.9)])
def test_recall(spark, name, least):
    ids, x = table(name) if isinstance(name, str) else made(*name)
    got = answers(ann.nearest(spark.createDataFrame([(int(k), v) for k, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>")))
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[queries].tolist())
    place, found = {k: j for j, k in enumerate(ids.tolist())}, 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        rows = got[ids[q]]
        assert len(rows) == 20 and all(abs(s[place[v]] - z) < 1e-9 * max(1, abs(z)) for _, v, z in rows)
        found += len({v for _, v, _ in rows} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert found >= least * 20 * len(queries)


def test_clustered_vectors_need_few_entries(spark, monkeypatch):
    """The walk's length follows the data: a small share of clustered rows is enough."""
    ids, x = made(12000, 64, 100)
    seen = []
    keep = ann.measured
    monkeypatch.setattr(ann, "measured", lambda *a: seen.append(keep(*a)) or seen[-1])
    ann.nearest(spark.createDataFrame([(int(k), v) for k, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>")).count()
    assert seen[0] < 0.1 * len(ids)
