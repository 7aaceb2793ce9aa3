"""Approximate nearest neighbours by an inverted multi-index.

The halves of the vectors are quantised apart, so k centroids each make k * k cells. A query walks the pairs of centroids by
their summed inner products with a heap, best first, until the cells visited hold enough entries; their entries are
reranked exactly. Codebooks are fitted on a bounded sample (the rows with the smallest hashes); every row is indexed.

How many entries are enough is measured: a bounded sample of queries is compared with all rows, and the walk goes as far as it
must for RECALL of their true neighbours. So clustered vectors need few entries, vectors without structure (whose cells say
little) a fixed share of them; there the work grows with the square of the rows, as any exact search does.

Entries and queries meet by the first half's centroid, a query with the list of cells that it visits there, in blocks of
bounded size: a centroid with many entries or visitors is split, so one vector that a third of the rows share does no harm. Each block returns its best `top` per query only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

TOP = 20
#: Rows that codebooks are fitted on, and bytes that these may take on the driver.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Share of their true neighbours that the sampled queries must find, and how many queries are sampled.
RECALL, ASKED = 0.96, 200
#: Centroids a half: FINE times the fourth root of the rows. Finer cells make longer walks.
FINE, MOST = 2.5, 256
#: Bytes of vectors in a block of entries or of queries.
BLOCK_BYTES = 8 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def visit(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Cells by descending summed inner product, until they hold `enough` entries. The heap holds the frontier of pairs."""
        a, b = self.first @ q[: self.half], self.second @ q[self.half :]
        ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[ia], b[ib]
        heap, seen, out, n = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, [], 0
        while heap and n < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(ia[i]) * len(b) + int(ib[j])
            if sizes[cell]:
                out.append(cell)
                n += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[x] + b[y]), x, y))
        return out


def rerank(q: np.ndarray, e: np.ndarray, ids: np.ndarray, own: np.ndarray, top: int, visited: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, score) of each query's best entries in the cells it visits; ids ascend. Scores sum in the order of dimensions, so equal vectors tie."""
    rough = q @ e.T
    rough[~visited | (ids[None, :] == own[:, None])] = -np.inf
    rows, cols = [], []
    slack = 1e-9 * (1 + np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(initial=0))
    for k in range(len(q)):
        r = rough[k]
        floor = np.partition(r, len(r) - top)[len(r) - top] - slack if len(r) > top else -np.inf
        near = np.flatnonzero((r >= floor) & (r > -np.inf))
        rows.append(np.full(len(near), k))
        cols.append(near)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    exact = np.zeros(len(rows))
    for d in range(q.shape[1]):
        exact += q[rows, d] * e[cols, d]
    order = np.lexsort((cols, -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    start = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - start < top
    return rows[keep], cols[keep], exact[keep]


def matrix(col, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros after those shorter than dims."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n, flat = np.diff(np.asarray(col.offsets)), np.asarray(col.flatten(), np.float64)
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims)[None, :] < n[:, None]] = flat
    return out


def order_of(index: MultiIndex, q: np.ndarray) -> np.ndarray:
    """All cells in the order in which a query walks them."""
    sums = (index.first @ q[: index.half])[:, None] + (index.second @ q[index.half :])[None, :]
    return np.argsort(-sums.ravel(), kind="stable")


def measured(index: MultiIndex, placed: DataFrame, sizes: np.ndarray, query_mod: int, top: int, recall: float, dims: int) -> int:
    """Entries that a walk must hold for the sampled queries to find `recall` of their true neighbours. Each sampled query is compared with every row."""
    asked = placed.filter(F.col("id") % query_mod == 0).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(ASKED).select("id", "v").toArrow()  # ASKED rows
    if not asked.num_rows:
        return top
    own, q = asked.column("id").to_numpy(), matrix(asked.column("v"), dims)

    def best(batches):
        ids, cells, scores = (np.zeros((len(q), 0), t) for t in (np.int64, np.int32, np.float64))
        for b in batches:
            if not b.num_rows:
                continue
            i, c = column(b, "id").to_numpy(), column(b, "cell").to_numpy()
            s = q @ matrix(column(b, "v"), dims).T
            s[own[:, None] == i[None, :]] = -np.inf
            ids, cells = (np.concatenate((x, np.broadcast_to(y, s.shape)), axis=1) for x, y in ((ids, i), (cells, c)))
            scores = np.concatenate((scores, s), axis=1)
            if scores.shape[1] > top:
                keep = np.argpartition(-scores, top - 1, axis=1)[:, :top]
                ids, cells, scores = (np.take_along_axis(x, keep, axis=1) for x in (ids, cells, scores))
        for k in range(len(q)):
            there = np.flatnonzero(scores[k] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), k), pa.int32()), pa.array(ids[k, there], pa.int64()), pa.array(cells[k, there], pa.int32()), pa.array(scores[k, there], pa.float64())], ["q", "id", "cell", "score"])

    found = placed.mapInArrow(best, "q int, id long, cell int, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    need = []
    before = {}
    for r in found.withColumn("place", place).filter(F.col("place") <= top).select("q", "cell").collect():  # ASKED * top rows at most
        if r.q not in before:
            order = order_of(index, q[r.q])
            held = np.cumsum(sizes[order])
            before[r.q] = np.empty(len(sizes), np.int64)
            before[r.q][order] = held - sizes[order]
        need.append(int(before[r.q][r.cell]) + 1)
    return max(top, sorted(need)[-int(-recall * len(need) // 1) - 1]) if need else top


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_mod: int = 20, top: int = TOP, enough: int | None = None, k: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found, by inner product, of each row whose id divides by query_mod.

    Null vectors, zero ones and those holding a null or non-finite component take no part, nor do null ids. Vectors shorter than the longest
    count as if zeros followed. A query's own id is no candidate for it. Rows that repeat an id count once, with the vector
    smallest in order. Ties go to smaller ids. With fewer candidates all are returned. An empty table gives an empty result.
    enough: entries to visit, in place of the measured number; the number of rows makes the search exact.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.max(F.size(v)).alias("d"), F.count("*").alias("n")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = size.d, size.n
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims), max(2000, total // 4)))
    sample = matrix(rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most).select("v").toArrow().column("v"), dims)
    k = min(k or int(np.clip(round(FINE * total**0.25), 2, MOST)), 1 << 16)
    half = max(1, dims // 2)
    index = MultiIndex(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k) if dims > 1 else np.zeros((1, 0)))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "v"), pa.array(index.cells(matrix(column(b, "v"), dims)), pa.int32())], ["id", "v", "cell"])

    width = len(index.second)
    placed = cut(rows.mapInArrow(place, "id long, v array<double>, cell int").withColumn("row", F.floor(F.col("cell") / width).cast("int")))
    sizes = np.zeros(len(index.first) * width, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell at most
        sizes[r.cell] = r.n
    enough = enough or measured(index, placed, sizes, query_mod, top, recall, dims)

    def walk(batches):
        for b in batches:
            ids, x = column(b, "id").to_numpy(), matrix(column(b, "v"), dims)
            for s in range(0, len(ids), 200):
                of, at, cells = [], [], []
                for k, q in enumerate(x[s : s + 200]):
                    seen = np.sort(np.array(index.visit(q, sizes, enough + 1), np.int64))
                    own = np.unique(seen // width)
                    of += [s + k] * len(own)
                    at += own.tolist()
                    cells += np.split(seen % width, np.searchsorted(seen // width, own)[1:]) if len(own) else []
                yield pa.RecordBatch.from_arrays([pa.array(ids[of], pa.int64()), column(b, "v").take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary())], ["id", "v", "row", "cells"])

    asked = cut(placed.filter(F.col("id") % query_mod == 0).select("id", "v").mapInArrow(walk, "id long, v array<double>, row int, cells binary"))
    visits = {r.row: r.n for r in asked.groupBy("row").agg(F.count("*").alias("n")).collect()}  # a row for each centroid at most
    block = max(256, BLOCK_BYTES // (8 * dims))
    split = lambda n: F.element_at(F.array(*[F.lit(max(1, -(-int(x) // block))) for x in n]), F.col("row") + 1)
    e_parts, q_parts = split(sizes.reshape(-1, width).sum(axis=1)), split([visits.get(c, 0) for c in range(len(index.first))])
    salt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    entries = placed.withColumn("ep", salt(e_parts)).withColumn("qp", every(q_parts))
    queries = asked.withColumn("qp", salt(q_parts)).withColumn("ep", every(e_parts))

    def score(e: pa.Table, q: pa.Table) -> pa.Table:
        if not e.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        e = e.sort_by("id")
        (ids, x), (own, y) = ((t.column("id").to_numpy(), matrix(t.column("v"), dims)) for t in (e, q))
        place = e.column("cell").to_numpy() % width
        open_ = np.zeros((len(own), width), bool)
        for k, c in enumerate(q.column("cells").to_pylist()):
            open_[k, np.frombuffer(c, np.uint16)] = True
        parts = [rerank(y[s : s + 256], x, ids, own[s : s + 256], top, open_[s : s + 256][:, place]) for s in range(0, len(own), 256)]
        return pa.table({"query_id": np.concatenate([own[s * 256 + r] for s, (r, _, _) in enumerate(parts)]), "vec_id": np.concatenate([ids[c] for _, c, _ in parts]), "score": np.concatenate([z for _, _, z in parts])})

    key = ("row", "ep", "qp")
    found = entries.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(score, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
