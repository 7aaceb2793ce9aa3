"""The keyed table: upserts, replayed and crashed batches, racing writers, earlier versions, against plain Python."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from paperloom.sources.tables import Conflict, Table

SCHEMA = "k long, name string, seq long, v string"


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(1), {}
    table = Table(spark, str(tmp_path / "t"), ("k", "name"), "seq", buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    for batch in range(5):
        rows = [(rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.randint(0, 30), rng.choice(["x", "y", None])) for _ in range(25)]
        assert table.upsert(spark.createDataFrame(rows, SCHEMA)) == batch + 1
        # the greater seq; of equal ones the later batch, in it the greater row
        rank = lambda r, late: (r[2], late, r[3] is not None, r[3] or "")
        for r in rows:
            old = want.get(r[:2])
            if old is None or rank(r, 1) > rank(old[0], old[1] == batch):
                want[r[:2]] = (r, batch)
    got = table.read()
    assert got.columns == ["k", "name", "seq", "v"] and sorted(map(tuple, got.collect()), key=repr) == sorted((r for r, _ in want.values()), key=repr)
    assert table.read(1).count() < got.count() and table.version(5).number == 5


def test_without_an_order_the_later_batch_wins(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ("k",))
    table.upsert(spark.createDataFrame([(1, "z"), (2, "b")], "k long, v string"))
    table.upsert(spark.createDataFrame([(1, "a"), (3, "c"), (3, "d")], "k long, v string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b"), (3, "d")]
    table.upsert(spark.createDataFrame([], "k long, v string"))
    assert table.read().count() == 3
    with pytest.raises(ValueError, match="columns"):
        table.upsert(spark.createDataFrame([(1, 2)], "k long, w long"))


def test_replayed_and_crashed_batches_leave_one_row_a_key(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    table = Table(spark, at, ("k",), "seq")
    batch = lambda *rows: spark.createDataFrame(rows, "k long, seq long, v string")
    assert table.upsert(batch((1, 1, "a"), (2, 1, "a")), "w", 0) == 1
    commit = Table._commit
    monkeypatch.setattr(Table, "_commit", lambda self, v: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(batch((2, 2, "b"), (3, 1, "b")), "w", 1)  # its files are written, its manifest isn't
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, "a"), (2, 1, "a")]
    monkeypatch.setattr(Table, "_commit", commit)
    assert table.upsert(batch((2, 2, "b"), (3, 1, "b")), "w", 1) == 2
    for again in (0, 1):
        assert table.upsert(batch((2, 9, "replayed")), "w", again) == 2
    assert table.upsert(batch((4, 1, "other writer")), "x", 0) == 3
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "b"), (4, 1, "other writer")]
    assert table.vacuum(keep=1) >= 1 and table.read().count() == 4 and table.vacuum(keep=1) == 0


def test_racing_writers_lose_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    write = lambda k: Table(spark, at, ("k",), buckets=2).upsert(spark.createDataFrame([(k, f"w{k}"), (100 + k, "x")], "k long, v string"), f"w{k}", 0, tries=20)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(4)))
    assert sorted(numbers) == [1, 2, 3, 4] and Table(spark, at, ("k",)).read().count() == 8


def test_a_taken_version_is_refused(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ("k",))
    table.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    with pytest.raises(Conflict):
        table._commit(table.version())
    assert table.read().count() == 1


def test_a_stream_that_restarts_repeats_nothing(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(j, k * 10 + j, f"f{k}") for j in range(k, k + 3)], "k long, seq long, v string").coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    table = Table(spark, str(tmp_path / "t"), ("k",), "seq")
    stream = lambda: spark.readStream.schema("k long, seq long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/f*"))
    merge = table.sink("w")

    def lost(rows, batch):
        merge(rows, batch)
        if batch == 1:
            raise RuntimeError("after the merge, before the stream knows")

    start = lambda f: stream().writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="before the stream knows"):
        start(lost).awaitTermination()
    before = table.version().number
    start(merge).awaitTermination()
    assert before == 2 and table.version().number == 3  # the second batch came twice and was merged once
    assert table.read().count() == 5 and table.read().agg(F.max("seq")).first()[0] == 24
