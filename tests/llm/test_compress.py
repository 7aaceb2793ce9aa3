"""Vector codes against a brute-force version in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from paperloom.llm import compress


def brute(rows):
    """rows: (vec_id, vector, label). Returns {row number: (code, error, label_error)} and the codebooks' digest."""
    kept = [(k, i, v, label) for k, (i, v, label) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(1, *(len(v) for _, _, v, _ in kept)) // 8) * 8
    e = dims // 8
    whole = {k: [math.floor(4096 * x) if abs(x) < 1e290 else int(x) * 4096 for x in v] + [0] * (dims - len(v)) for k, _, v, _ in kept}
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:16]
    books = [[whole[k][p * e : (p + 1) * e] for k, *_ in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda part, book: min(range(len(book)), key=lambda j: (far(part, book[j]), j))
    for _ in range(6):
        for p in range(8):
            own = {}
            for y in whole.values():
                part = y[p * e : (p + 1) * e]
                own.setdefault(nearest(part, books[p]), []).append(part)
            for j, parts in own.items():
                books[p][j] = [sum(c) // len(parts) for c in zip(*parts)]
    out = {}
    for k, y in whole.items():
        codes = [nearest(y[p * e : (p + 1) * e], books[p]) for p in range(8)]
        out[k] = ["".join(f"{c:02x}" for c in codes), sum(far(y[p * e : (p + 1) * e], books[p][c]) for p, c in enumerate(codes))]
    by = {}
    for k, _, _, label in kept:
        by[label] = by.get(label, 0) + out[k][1]
    for k, _, _, label in kept:
        out[k].append(by[label])
    return out, hashlib.sha256(",".join(str(x) for b in books for r in b for x in r).encode()).hexdigest()


def check(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "'x' AS error", "'x' AS part", "'x' AS v", "'x' AS id")
    want, digest = brute(rows)
    clip = lambda x: x if x < 2**63 else None
    total = {}
    for k, (code, error, label) in want.items():
        lost = any(w[1] >= 2**63 for j, w in want.items() if rows[j][2] == rows[k][2])
        total.setdefault((rows[k][0], code, clip(error), None if lost else clip(label)), 0)
        total[rows[k][0], code, clip(error), None if lost else clip(label)] += 1
    got = {}
    for r in compress.encode_vectors(frame).collect():
        assert r.codebooks_sha256 == digest
        key = (r.vec_id, r.code, r.error, r.label_error)
        got[key] = got.get(key, 0) + 1
    assert got == total


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)) * 0.2  # 20 components: padded to 24
    x[50:150] = x[3]
    rows = [(k * 3, v.tolist(), [None, 1, 2][k % 3] if k < 250 else 7) for k, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 20, 1), (5002, [float("nan")] * 20, 1), (5003, [None] * 20, 1), (5004, [float("inf")] + [0.0] * 19, 1), (5005, [], 2), (5006, [0.5, -0.25], None), (None, [1.0] * 20, 2), (6, x[7].tolist(), 1), (6, x[7].tolist(), 1)]
    check(spark, rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 16)).tolist(), k % 2) for k in range(60)] + [(100, [1e300] * 8, 3), (101, [1e12] * 8, 4)]
    check(spark, rows)


def test_few_rows_and_none(spark):
    check(spark, [(1, [0.1] * 8, None), (2, [0.1] * 8, None), (3, [0.3] * 8, 1)])
    empty = compress.encode_vectors(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_embeddings_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    want, digest = brute(rows)
    got = {r.vec_id: r for r in compress.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(want)
    for k, (code, error, label) in want.items():
        r = got[rows[k][0]]
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == (code, error, label, digest)


@pytest.mark.parametrize("scale", [1, 100, 2**20])
def test_screening_never_drops_the_nearest(scale):
    rng = np.random.default_rng(scale)
    c = rng.integers(-scale * 100, scale * 100, size=(16, 48))
    y = np.concatenate([rng.integers(-scale * 100, scale * 100, size=(500, 48)), (c[rng.integers(0, 16, 500)] + c[rng.integers(0, 16, 500)]) // 2])
    far = ((y[:, None, :] - c[None]) ** 2).sum(axis=2)
    open_ = compress.screen(y, c)
    assert open_[far == far.min(axis=1, keepdims=True)].all()
    assert open_[:500].sum() < 600  # and seldom leaves more than one
    assert (compress.assign(y, c) == far.argmin(axis=1)).all()
