"""Archives read by ranges of members, with filters at the source, odd members, and written by tasks."""

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.sources import archives


@pytest.fixture(scope="module")
def session(spark):
    archives.register(spark)
    return spark


def make(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)


def test_a_large_archive_is_read_by_several_tasks(session, tmp_path):
    members = [(f"d{k % 3}/f{k:04d}.{'txt' if k % 2 else 'jpg'}", os.urandom(3000 + k)) for k in range(400)]
    make(tmp_path / "a.zip", members)
    t = session.read.format("archive").option("partitionBytes", 200_000).load(str(tmp_path / "a.zip"))
    assert 6 <= t.rdd.getNumPartitions() <= 8
    assert t.select(F.spark_partition_id()).distinct().count() == t.rdd.getNumPartitions()
    got = {r.member: (bytes(r.content), r.size, r.error) for r in t.collect()}
    assert got == {name: (content, len(content), None) for name, content in members}


def test_filters_reach_the_source(session, tmp_path, capsys):
    make(tmp_path / "a.zip", [(f"crops/{k}.jpg", b"x" * k) for k in range(50)] + [("train.txt", b"t"), ("crops/", b""), ("other.csv", b"c")])
    make(tmp_path / "b.zip", [("train.txt", b"u")])
    t = session.read.format("archive").option("partitionBytes", 1).load(str(tmp_path))
    wanted = t.filter(F.col("member").startswith("crops/") & F.col("member").endswith(".jpg") & (F.col("size") >= 40) & (F.length("content") != 43))
    wanted.explain("formatted")
    plan = capsys.readouterr().out
    assert "StringStartsWith" in plan or "startswith" in plan.lower() or "PushedFilters" in plan
    assert sorted(r.member for r in wanted.collect()) == [f"crops/{k}.jpg" for k in range(40, 50) if k != 43]
    assert wanted.rdd.getNumPartitions() == 10  # a task for each member that passes, none for the others
    assert sorted(bytes(r.content) for r in t.filter("member = 'train.txt'").collect()) == [b"t", b"u"]
    assert t.filter(F.col("member").isin("train.txt", "other.csv") & F.col("archive").endswith("a.zip")).count() == 2
    assert t.filter("member = 'nothing'").count() == 0 and t.filter("member is null").count() == 0
    names = session.read.format("archive").option("content", "false").load(str(tmp_path))
    assert names.filter("content is null and error is null").count() == 53


def test_odd_archives(session, tmp_path):
    make(tmp_path / "a.zip", [("same.txt", b"one"), ("Größe/日本.txt", "é".encode()), ("empty", b"")])
    with zipfile.ZipFile(tmp_path / "a.zip", "a", zipfile.ZIP_STORED) as z, pytest.warns(UserWarning):
        z.writestr("same.txt", b"two")
    make(tmp_path / "bz.zip", [("x", b"y" * 100)], zipfile.ZIP_BZIP2)
    make(tmp_path / "sub.ZIP", [("deep", b"z")])
    (tmp_path / "not.zip").write_bytes(b"no archive")
    (tmp_path / "note.txt").write_bytes(b"not one either")
    make(tmp_path / "broken.zip", [("ok", b"fine"), ("bad", b"0123456789" * 50), ("late", b"also fine")], zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "broken.zip").read_bytes())
    at = raw.index(b"0123456789")
    raw[at : at + 4] = b"????"
    (tmp_path / "broken.zip").write_bytes(raw)
    rows = [(os.path.basename(r.archive), r.member, None if r.content is None else bytes(r.content), r.error) for r in session.read.format("archive").load(str(tmp_path)).collect()]
    assert sorted(r[2] for r in rows if r[1] == "same.txt") == [b"one", b"two"]
    assert ("a.zip", "Größe/日本.txt", "é".encode(), None) in rows and ("a.zip", "empty", b"", None) in rows and ("sub.ZIP", "deep", b"z", None) in rows
    assert {r[1] for r in rows if r[0] == "broken.zip" and r[3] is None} == {"ok", "late"}
    bad = {(r[0], r[1]): r[3] for r in rows if r[3]}
    assert set(bad) == {("broken.zip", "bad"), ("not.zip", None), ("bz.zip", "x")} and "sum" in bad["broken.zip", "bad"] and "method" in bad["bz.zip", "x"]
    with pytest.raises(ValueError, match="encrypted"):
        archives.unpacked(None, archives.Member("x", 0, 0, 0, 0, 0, 1))
    with pytest.raises(ValueError, match="no header"):
        import io

        archives.unpacked(io.BytesIO(struct.pack("<30x")), archives.Member("x", 0, 0, 0, 0, 0, 0))


def test_empty_and_missing(session, tmp_path):
    assert session.read.format("archive").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        session.read.format("archive").load(str(tmp_path / "none.zip")).count()


def test_written_archives_read_back(session, tmp_path):
    at = str(tmp_path / "out")
    df = session.range(300).select(F.concat(F.lit("m/"), F.col("id").cast("string")).alias("member"), F.repeat(F.col("id").cast("string"), 20).cast("binary").alias("content")).repartition(4)
    df.write.format("archive").mode("append").save(at)
    assert len(os.listdir(at)) == 4 and all(zipfile.is_zipfile(f"{at}/{f}") for f in os.listdir(at))
    back = lambda: {r.member: bytes(r.content) for r in session.read.format("archive").load(at).collect()}
    assert back() == {f"m/{k}": (str(k) * 20).encode() for k in range(300)}
    df.limit(3).coalesce(1).write.format("archive").mode("overwrite").save(f"file://{at}")
    assert len(os.listdir(at)) == 1 and len(back()) == 3
    with pytest.raises(Exception, match="columns member and content"):
        session.range(1).write.format("archive").mode("append").save(at)


def test_a_failed_write_leaves_nothing(session, tmp_path):
    at = str(tmp_path / "out")
    df = session.range(100).repartition(4).select(F.col("id").cast("string").alias("member"), F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        df.write.format("archive").mode("append").save(at)
    assert not os.path.isdir(at) or not [f for f in os.listdir(at) if f.endswith(".zip")]
