"""A keyed table in a folder: upserts by key, each batch once, readers never see half of one.

A version is a manifest, a small JSON file v<number> that lists the data files of each of the table's buckets, and the last batch that
each writer had merged. Data files are Parquet, never changed once written. An upsert writes new files for the buckets that its keys fall
into, then the manifest of the next version; creating that file, which fails where it exists already, is what commits. A writer that loses this race
starts over from the new version. A batch whose number its writer's last one has reached is known and left out, so a replayed batch
changes nothing, and what a crashed one had written belongs to no version.

    table = Table(spark, folder, keys=("doc_id",), order="seq")
    stream.writeStream.foreachBatch(table.sink("query name"))
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class Conflict(Exception):
    """Another writer has committed the version first."""


@dataclass
class Version:
    number: int = 0
    schema: str = ""
    buckets: int = BUCKETS
    #: Folders of each bucket's files, by the bucket's number.
    files: dict[int, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema, "buckets": self.buckets, "files": {str(k): v for k, v in self.files.items()}, "batches": self.batches})

    @classmethod
    def of(cls, text: str) -> Version:
        v = json.loads(text)
        return cls(v["number"], v["schema"], v["buckets"], {int(k): f for k, f in v["files"].items()}, v["batches"])


class Table:
    """keys: the columns that tell rows apart. order: of two rows of a key the one with the greater order stays; where that ties, or without one, the one that comes with the later batch (in a batch: the greater row)."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), tuple(keys), order, buckets

    # ---- manifests, through Hadoop's file systems, so that any store will do
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._fs(f"{self.folder}/versions")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[1:].isdigit()) if fs.exists(p) else []

    def version(self, number: int | None = None) -> Version:
        """The latest version, or an earlier one by its number; number 0 is the empty table."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return Version(buckets=self.buckets)
        p, fs = self._fs(f"{self.folder}/versions/v{number}")
        stream = fs.open(p)
        try:
            return Version.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, v: Version) -> None:
        """The manifest is written aside and takes its number in one step that fails where it is taken: by a link on a local disk, elsewhere by a rename."""
        p, fs = self._fs(f"{self.folder}/versions/v{v.number}")
        aside, _ = self._fs(f"{self.folder}/versions/.aside-{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(v.text().encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), p.toUri().getPath())
            elif fs.exists(p) or not fs.rename(aside, p):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"version {v.number} is there already") from None
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)

    # ---- rows
    def read(self, number: int | None = None) -> DataFrame:
        """One row a key, of the latest or an earlier version."""
        v = self.version(number)
        if not v.number:
            raise FileNotFoundError(f"{self.folder} holds no version")
        paths = [f for files in v.files.values() for f in files]
        rows = self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)
        return rows.drop("__bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, writer: str = "", batch: int | None = None, tries: int = 5) -> int:
        """Merges rows by key; returns the version that holds them. A batch that its writer's later or equal number has reached is left out.

        Rows whose key holds a null are keyed by the null. Rows of a batch that share a key count once. Columns must be those of the table.
        """
        for _ in range(tries):
            now = self.version()
            if batch is not None and now.batches.get(writer, -1) >= batch:
                return now.number
            if now.number and now.buckets != self.buckets:
                self.buckets = now.buckets
            merged = self._merged(now, rows, writer, batch)
            try:
                self._commit(merged)
                return merged.number
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers were faster")

    def _merged(self, now: Version, rows: DataFrame, writer: str, batch: int | None) -> Version:
        rows = rows.drop("__bucket").withColumn("__bucket", self._bucket())
        at = f"{self.folder}/data/{uuid.uuid4().hex}"
        value = [c for c in rows.columns if c not in self.keys and c != "__bucket"]
        if now.number and set(rows.columns) != {*_names(now.schema), "__bucket"}:
            raise ValueError(f"the table has the columns {', '.join(_names(now.schema))}")
        touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # a row for each bucket at most
        old = [f for b in touched for f in now.files.get(b, [])]
        both = rows.withColumn("__late", F.lit(1))
        if old:
            kept = self.spark.read.schema(now.schema).parquet(*old).withColumn("__bucket", self._bucket()).withColumn("__late", F.lit(0))
            both = both.unionByName(kept)
        first = [F.col(self.order).alias("__order")] if self.order else []
        last = F.max(F.struct(*first, F.col("__late"), *[F.col(c) for c in value])).alias("r")
        out = both.groupBy("__bucket", *self.keys).agg(last).select("__bucket", *self.keys, *[F.col(f"r.{c}").alias(c) for c in value]).select(*rows.columns)
        out.write.partitionBy("__bucket").parquet(at)
        files = {b: f for b, f in now.files.items() if b not in touched} | {b: [f"{at}/__bucket={b}"] for b in touched}
        schema = now.schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__bucket").schema)
        return Version(now.number + 1, schema, self.buckets, files, now.batches | ({writer: batch} if batch is not None else {}))

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: every micro-batch is merged once, however often it is delivered."""

        def write(rows: DataFrame, batch: int) -> None:
            Table(rows.sparkSession, self.folder, self.keys, self.order, self.buckets).upsert(rows, writer, batch)

        return write

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last `keep` versions, and data that no kept version lists; returns how many folders went. Not while a writer is at work."""
        numbers = self._numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        live = {f.rsplit("/", 2)[1] for v in kept for files in v.files.values() for f in files}
        for n in numbers[:-keep]:
            p, fs = self._fs(f"{self.folder}/versions/v{n}")
            fs.delete(p, False)
        p, fs = self._fs(f"{self.folder}/data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in live] if fs.exists(p) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names
