"""Hierarchical residual packing of token sequences.

Each partition packs its pieces by best fit, longest first, and keeps nearly full bins as they are. Underfull
bins then travel as items: rounds of best fit merge them in groups, an eighth as many groups each round, until
groups would hold more than `group_rows` bins; groups never grow beyond that, whatever the input. A bin that no
other underfull bin can join is emitted at once. Pieces are never cut to fill a bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, vocabulary
from .common import Texts, batch_of, blocks, column, cut, documents, ints, small_batches, width

CAPACITY = 2048
NEARLY_FULL = 0.985
FAN_IN = 8
GROUP_ROWS = 10_000


def best_fit(sizes, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin, offset) of each item. Residuals live in a bit mask, so an item costs O(1) big-int steps."""
    sizes = np.asarray(sizes, np.int64)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    mask, stacks, n = 0, [[] for _ in range(capacity + 1)], 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            own = stacks[r].pop()
            if not stacks[r]:
                mask ^= 1 << r
        else:
            own, r, n = n, capacity, n + 1
        bins[k], offsets[k] = own, capacity - r
        left = r - size
        stacks[left].append(own)
        mask |= 1 << left
    return bins, offsets


def pieces_of(docs: DataFrame, path: str | None, capacity: int) -> DataFrame:
    """Pieces of every document with the bin that its partition's best fit gave: doc_id, piece, start, length, ids_crc32, bin, offset."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        bpe, rows = codec(path or vocabulary(), speculate=False), []
        for b in blocks(batches):
            ids, at = bpe.encode_block(Texts(column(b, "text")))
            for k, doc in enumerate(column(b, "doc_id").to_pylist()):
                own = np.append(ids[at[k] : at[k + 1]], 0).astype("<u4")
                rows += [(doc, p, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(own), capacity))]
        if not rows:
            return
        length = np.array([r[3] for r in rows])
        bins, offset = best_fit(length, capacity)
        fill = np.bincount(bins, weights=length).astype(np.int64)[bins]
        first = TaskContext.get().partitionId() << 36
        for s in range(0, len(rows), 10_000):
            part = [*zip(*rows[s : s + 10_000], strict=True)]
            yield batch_of(schema, *part, first + bins[s : s + 10_000], offset[s : s + 10_000], fill[s : s + 10_000])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long")


def _merge_round(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Best fit of whole bins within each group; a merged bin lists the bins in it and their offsets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        fill = table.column("fill").to_numpy()
        bins, offset = best_fit(fill, capacity)
        members, offsets, name = table.column("members").to_pylist(), table.column("offsets").to_pylist(), table.column("bin").to_pylist()
        out: dict[int, list] = {}
        for k, own in enumerate(bins.tolist()):
            row = out.setdefault(own, [name[k], 0, [], []])
            row[1] += int(fill[k])
            row[2] += members[k]
            row[3] += [x + int(offset[k]) for x in offsets[k]]
        cols = [*zip(*out.values(), strict=True)]
        return pa.table({"bin": pa.array(cols[0], pa.int64()), "fill": pa.array(cols[1], pa.int64()), "members": pa.array(cols[2], pa.list_(pa.int64())), "offsets": pa.array(cols[3], pa.list_(pa.int64()))})

    return items.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("g")).applyInArrow(run, "bin long, fill long, members array<long>, offsets array<long>")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tree-merge of the partitions' underfull bins. pieces: as pieces_of gives them, best materialised. Adds sequence_id."""
    bins = pieces.groupBy("bin").agg(F.max("fill").alias("fill"))
    items = cut(bins.filter(F.col("fill") < int(capacity * nearly_full)).select("bin", "fill", F.array("bin").alias("members"), F.array(F.lit(0).cast("long")).alias("offsets")))
    done, groups = [], max(1, width(pieces.sparkSession) // fan_in)
    while True:
        n, least = items.agg(F.count("*"), F.min("fill")).first()
        if not n:
            break
        done.append(items.filter(F.col("fill") + least > capacity))
        items = items.filter(F.col("fill") + least <= capacity)
        floor = -(-n // group_rows)
        items = cut(_merge_round(items, max(groups, floor), capacity))
        if groups <= floor or groups == 1:
            done.append(items)
            break
        full = items.filter(F.col("fill") >= int(capacity * nearly_full))
        done.append(full)
        items, groups = items.filter(F.col("fill") < int(capacity * nearly_full)), max(1, groups // fan_in)
    if not done:
        return pieces.select("*", F.col("bin").alias("sequence_id")).drop("bin", "fill")
    moved = done[0]
    for d in done[1:]:
        moved = moved.unionByName(d)
    moved = moved.select(F.col("bin").alias("root"), F.explode(F.arrays_zip("members", "offsets")).alias("m")).select(F.col("m.members").alias("bin"), "root", F.col("m.offsets").alias("shift"))
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most `capacity` tokens from whole documents, each ended by id 0; longer ones are cut in pieces.

    Null and empty texts are one piece of one token; each repeated row is a document of its own (its piece rows
    repeat); ties go to the earlier row; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pack(cut(pieces_of(docs, path, capacity)), capacity)


def query(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
