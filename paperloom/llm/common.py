"""Shared helpers: Arrow blocks of texts, vectorised words and hashes, lineage cuts."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised code of a Python worker.
BLOCK_BYTES = 4 << 20
#: Rows that Spark puts in one Arrow batch while these operators run; bounds the workers' memory on long texts.
ARROW_ROWS = 1000

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower (never raise) the session's Arrow batch size, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; one of our own only where that is unset, which a local master alone can share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="paperloom-"))
        own = spark._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())  # Spark's, of this application; gone when it ends
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage; survives lost executors.

    The size that Spark estimated for df goes too: the estimates of joins multiply, and over many rounds planning would take longer than the work.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    jdf = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def forget(*cuts: DataFrame) -> None:
    """Delete the files of what cut() gave and nothing will read again."""
    for df in cuts:
        spark = df.sparkSession
        todo = [df._jdf.queryExecution().toRdd()]
        while todo:
            rdd = todo.pop()
            if rdd.getCheckpointFile().isDefined():
                path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            else:
                own = rdd.dependencies()
                todo += [own.apply(k).rdd() for k in range(own.size())]


class Bits:
    """A set of 64-bit values as a bit map of bounded size (2**MOST_LOG2 bits, 8 MB, at most): has() may be true for others, never false for its own.

    Once there are more values than bits it holds nothing back, and what it filters for must be exact without it.
    """

    MOST_LOG2, LEAST_LOG2, PART = 26, 15, 15

    def __init__(self, log2: int, words: np.ndarray):
        self.log2, self.words = log2, words

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Bits:
        n = df.count()
        log2 = min(max((16 * n).bit_length(), cls.LEAST_LOG2), cls.MOST_LOG2)
        slot = F.shiftrightunsigned(F.xxhash64(F.col(name).cast("long")), 64 - log2)
        parts = df.select(F.shiftright(slot, cls.PART).alias("part"), slot.bitwiseAND((1 << cls.PART) - 1).alias("bit"))
        words = np.zeros((1 << log2) // 8, np.uint8)
        size = (1 << cls.PART) // 8
        for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 4 KB for each part
            words[r.part * size : (r.part + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)
        return cls(log2, words)

    def has(self, values: np.ndarray) -> np.ndarray:
        slot = xxhash64(values) >> _U(64 - self.log2)
        return (self.words[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 > 0


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle, as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which holds each key once; keys that many rows of left share are split, and their rows of right copied.

    A key is hot with over a quarter of a partition's fair share of left's rows, so at most four keys a partition are; these alone are
    broadcast, and copied as often as they have quarters. by: a column that deals a key's rows out. left is read twice: cut() it first.
    """
    n = F.col("__n")
    counts = left.groupBy(*on).agg(F.count("*").alias("__n"))
    share = max(1, -(-left.count() // (4 * width(left.sparkSession))))
    hot = F.broadcast(cut(counts.filter(n > share).select(*on, F.ceil(n / share).cast("int").alias("__parts"))))
    dealt = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__parts"))).cast("int"))
    copied = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return dealt.drop("__parts").join(copied.drop("__parts"), [*on, "__salt"], how).drop("__salt")


def crc_mod(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo mod."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, _U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def xxhash64(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64() gives for longs, unsigned. The factors are XXH64's fixed values."""
    p = [_U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turn = lambda v, k: v << _U(k) | v >> _U(64 - k)
    x = np.asarray(x, np.int64).view(_U)
    h = (turn(x * p[1], 31) * p[0]) ^ (_U(seed + 8) + p[4])
    h = turn(h, 27) * p[0] + p[3]
    h = (h ^ h >> _U(33)) * p[1]
    h = (h ^ h >> _U(29)) * p[2]
    return h ^ h >> _U(32)


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_R = {}


def _multipliers(n: int) -> np.ndarray:
    if len(_R.get("r", ())) < n:
        _R["r"] = randoms(max(256, 2 * n), 11)
    return _R["r"]


class Texts:
    """A block of texts as one byte array; nulls are empty texts."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.at, self.n = whole[at[0] : at[-1]], at - at[0], len(column)

    def bytes(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def words(self, lower: bool = True, apart: np.ndarray = _SPACE):
        """Words are runs of bytes other than those apart (space and 0x09-0x0D). Returns (starts, lengths, doc of each, 64-bit hash of each)."""
        data = _LOWER[self.data] if lower else self.data
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0, _U)
        inside = ~apart[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = self.at[:-1][self.at[:-1] < n]
        first[edge] |= inside[edge]
        starts = np.flatnonzero(first)
        if not len(starts):
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0, _U)
        place = np.zeros(n, np.int32 if n < 2**31 else np.int64)
        place[starts] = starts
        np.maximum.accumulate(place, out=place)
        place = np.arange(n, dtype=place.dtype) - place
        lengths = np.add.reduceat(inside, starts, dtype=np.int64)
        h = _multipliers(int(lengths.max()) + 1)[np.where(inside, place, 0)]
        h *= data.astype(_U) + _U(1)
        h[~inside] = 0
        h = mix(np.add.reduceat(h, starts) + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))
        return starts, lengths, np.searchsorted(self.at, starts, "right") - 1, h


def blocks(batches, target: int = BLOCK_BYTES, text: str = "text"):
    """Slices of record batches of about `target` bytes of text (one text at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0), np.int64)
        part, start = np.cumsum(size) // target, 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1), b.num_rows]:
            if stop > start:
                yield b.slice(start, stop - start)
            start = stop


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def ints(batch, name: str) -> np.ndarray:
    return np.asarray(pc.fill_null(column(batch, name), 0)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
