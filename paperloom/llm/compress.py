"""Vector codes by product quantisation in whole numbers, with assignments that are exact.

Components become whole numbers and vectors are cut into parts, each with a codebook of its own. The nearest entry of a part
is found by screening: |c|^2 - 2 v.c from one float32 matrix product, with an interval that bounds its rounding error. Only
entries whose interval reaches that of the best are computed again, in int64; ties go to the smaller index. Parts whose numbers
are too large for int64 distances are computed in Python's whole numbers instead.

A round is a pass over the table: every task sums the parts of each entry, Spark adds the sums (in limbs of 32 bits, so no
total overflows) and the driver gets one row for each limb of each component of the codebooks, whose size is fixed by the dimensions. The
table isn't cached: each round reads it again.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, cut, join_hot

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Unit roundoff of float32.
_U32 = 2.0**-24
_LIMB = 32


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), in int64 where that holds all of them, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([[math.floor(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in row] for row in x.tolist()], object)


def fits(y: np.ndarray, c: np.ndarray) -> bool:
    """Whether all squared distances are below 2**62."""
    if y.dtype == object or c.dtype == object:
        return False
    most = int(np.abs(y).max(initial=0)) + int(np.abs(c).max(initial=0))
    return most * most * max(1, y.shape[1]) < 2**62


def screen(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest: a row for each vector, a column for each entry. Never leaves out a nearest one."""
    p = y.shape[1]
    product = (y.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    square = (c * c).sum(axis=1).astype(np.float64)
    reach = np.sqrt((y.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
    gamma = (p + 4) * _U32 / (1 - (p + 4) * _U32)  # p products, p - 1 sums in any order, both factors rounded
    bound = (2 * gamma * reach + 2.0**-50 * (square + 2 * reach)) * (1 + 2.0**-40)
    about = square - 2 * product
    return about - bound <= (about + bound).min(axis=1, keepdims=True)


def assign(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of each row's nearest entry, the smallest of those that tie."""
    if not len(y):
        return np.zeros(0, np.int64)
    if not fits(y, c):
        far = ((y.astype(object)[:, None, :] - c.astype(object)[None, :, :]) ** 2).sum(axis=2)
        return np.array([min(range(len(r)), key=r.__getitem__) for r in far.tolist()], np.int64)
    open_ = screen(y, c)
    out = open_.argmax(axis=1)
    again = np.flatnonzero(open_.sum(axis=1) > 1)
    for s in range(0, len(again), 65536):
        own = again[s : s + 65536]
        rows, cols = np.nonzero(open_[own])
        far = ((y[own[rows]] - c[cols]) ** 2).sum(axis=1)
        start = np.searchsorted(rows, np.arange(len(own)))
        least = np.minimum.reduceat(far, start)
        hit = np.flatnonzero(far == least[rows])
        out[own] = cols[hit[np.searchsorted(rows[hit], np.arange(len(own)))]]
    return out


def distance(y: np.ndarray, c: np.ndarray, own: np.ndarray) -> list[int]:
    """Squared distance of each row to its entry, as Python's whole numbers."""
    if not fits(y, c):
        y, c = y.astype(object), c.astype(object)
    return ((y - c[own]) ** 2).sum(axis=1).tolist() if len(y) else []


class Codebooks:
    """One codebook a part: arrays of (entries, components), in int64 where that holds them."""

    def __init__(self, first: list[list[int]], dims: int):
        self.each = dims // PARTS
        self.books = [self._array([v[p * self.each : (p + 1) * self.each] for v in first]) for p in range(PARTS)]

    def _array(self, rows) -> np.ndarray:
        small = all(abs(x) < 2**62 for r in rows for x in r)
        return np.array(rows, np.int64 if small else object).reshape(len(rows), self.each)

    def part(self, y: np.ndarray, p: int) -> np.ndarray:
        return y[:, p * self.each : (p + 1) * self.each]

    def moved(self, sums: dict[tuple[int, int, int], int], counts: dict[tuple[int, int], int]) -> None:
        """Every used entry becomes the floored mean of its parts."""
        for p, book in enumerate(self.books):
            rows = book.tolist()
            for e in range(len(rows)):
                if n := counts.get((p, e)):
                    rows[e] = [sums.get((p, e, k), 0) // n for k in range(self.each)]
            self.books[p] = self._array(rows)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for row in book.tolist() for x in row).encode()).hexdigest()


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros after those shorter than dims."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), np.float64)
    if len(n) and (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims)[None, :] < n[:, None]] = flat
    return out


def _limbs(value: int):
    """(place, limb) of a whole number; all but the last limb are in [0, 2**32)."""
    k = 0
    while not -(2**_LIMB) <= value < 2**_LIMB:
        yield k, value & (2**_LIMB - 1)
        value >>= _LIMB
        k += 1
    yield k, value


def _sums(books: Codebooks, dims: int):
    """A task's sums: (part, entry, component, limb's place, limb); component -1 counts."""

    def add(batches):
        total = [[[0] * books.each for _ in book] for book in books.books]
        counts = [np.zeros(len(book), np.int64) for book in books.books]
        for b in batches:
            if not b.num_rows:
                continue
            y = whole(matrix(column(b, "v"), dims))
            for p, book in enumerate(books.books):
                part = books.part(y, p)
                own = assign(part, book)
                counts[p] += np.bincount(own, minlength=len(book))
                for e in np.unique(own):
                    rows = part[own == e]
                    if rows.dtype != object and len(rows) * int(np.abs(rows).max(initial=0)) >= 2**62:
                        rows = rows.astype(object)
                    total[p][e] = [a + x for a, x in zip(total[p][e], rows.sum(axis=0).tolist(), strict=True)]
        out = [(p, e, -1, 0, int(n)) for p, c in enumerate(counts) for e, n in enumerate(c) if n]
        out += [(p, e, k, at, x) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist() for k, s in enumerate(total[p][e]) for at, x in _limbs(s)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["part", "entry", "dim", "place", "limb"])

    return add


CODES = pa.schema([("id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _codes(books: Codebooks, dims: int):
    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = whole(matrix(column(b, "v"), dims))
            own = np.zeros((len(y), PARTS), np.uint8)
            error = [0] * len(y)
            for p, book in enumerate(books.books):
                part = books.part(y, p)
                own[:, p] = assign(part, book)
                error = [a + x for a, x in zip(error, distance(part, book, own[:, p]), strict=True)]
            yield batch_of(CODES, column(b, "id"), column(b, "label"), [r.tobytes().hex() for r in own], [x if x < 2**63 else None for x in error])

    return encode


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is neither null nor holds a null or non-finite component.

    Every other row stays: zero vectors, equal vectors, rows that repeat an id (each is a row of its own) and null ids. The codebooks start from
    the rows first by id (null ids last), then by vector; with fewer rows than ENTRIES there are fewer entries. Vectors shorter than the
    longest, rounded up to a multiple of PARTS, count as if zeros followed. Distances that tie go to the smaller index. An error beyond 64
    bits is null, and so is the sum of a label that holds one or passes 64 bits. An empty table gives an empty result. The table is
    read once for each round and twice more; other columns, whatever their names, are left alone.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    longest = rows.agg(F.max(F.size(v))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dims = -(-max(longest, 1) // PARTS) * PARTS
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = Codebooks([whole(np.array([list(r.v) + [0.0] * (dims - len(r.v))])).tolist()[0] for r in first], dims)
    for _ in range(ROUNDS):
        found = rows.select("v").mapInArrow(_sums(books, dims), "part int, entry int, dim int, place int, limb long")
        sums, counts = {}, {}
        for r in found.groupBy("part", "entry", "dim", "place").agg(F.sum("limb").alias("limb")).collect():  # fixed by the dimensions
            if r.dim < 0:
                counts[r.part, r.entry] = r.limb
            else:
                sums[r.part, r.entry, r.dim] = sums.get((r.part, r.entry, r.dim), 0) + (r.limb << _LIMB * r.place)
        books.moved(sums, counts)
    coded = cut(rows.mapInArrow(_codes(books, dims), "id long, label string, code string, error long"))
    coded = coded.select("id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("label"), "code", "error")
    big = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.try_add(big, F.lit(0))).alias("total"))
    totals = totals.select("label", F.col("total").try_cast("long").alias("label_error"))
    return join_hot(coded, totals, ["label"], by="id", how="left").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def query(spark, sf_dir):
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
