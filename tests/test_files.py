from pyspark.sql import Row

from paperloom.sources import files


def test_box_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,5,2,5,9,1,9,a,b\n1,2,3\nx,2,5,2,5,9,1,9,bad\n")
    got = files.box_tokens(spark, str(tmp_path)).collect()
    assert [(r.text, r.x0, r.y0, r.x1, r.y1, r.conf) for r in got] == [("a,b", 1.0, 2.0, 5.0, 9.0, 1.0)]


def test_key_gold(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"company": " Shop  A ", "date": "31/05/2026", "total": "235,000"}')
    r = files.key_gold(spark, str(tmp_path)).first()
    assert (r.merchant_name, r.date, r.total_amount) == ("shop a", "2026-05-31", 235000.0)


def test_labels_json(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.json").write_text(f'[{{"image": "i{k}", "gold": {{"date": "d"}}, "tokens": [{{"text": "t", "bbox": [0, 1, 2, 3], "conf": 1.0}}]}}, {{"image": "j{k}"}}]')
    rows = files.labels_json(spark, [str(tmp_path / "1.json"), str(tmp_path / "2.json")]).orderBy("image").collect()
    assert [r.image for r in rows] == ["i1", "i2", "j1", "j2"] and rows[0].tokens[0].bbox[3] == 3.0 and rows[2].tokens is None


def test_label_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.jpg\tx\ty\n\n   \nbroken\n")
    assert sorted((r.name, r.text) for r in files.label_lines(spark, str(tmp_path)).collect() if r.text) == [("a.jpg", "x\ty")]
    assert files.label_lines(spark, str(tmp_path)).filter("text is null").first().name == "broken"


def test_region_gold(spark, tmp_path):
    (tmp_path / "g.csv").write_text("img_id,anno_polygons,anno_texts,anno_labels\ni,\"[{'bbox': [1, 2, 3, 4]}, {'bbox': [5, 6, 7, 8]}, {'bbox': [1, 1, 1, 1]}]\",A|||B,SELLER|||OTHER|||SELLER\nj,oops,A,SELLER\n")
    got = files.region_gold(spark, str(tmp_path)).collect()
    assert [(r.img_id, r.label, r.text, r.x0, r.y0, r.x1, r.y1) for r in got] == [("i", "SELLER", "A", 1.0, 2.0, 4.0, 6.0)]


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.txt", "hi")
        z.writestr("c.bin", "no")
    assert [(r.member, bytes(r.content)) for r in files.zip_members(spark, str(tmp_path)).collect()] == [("a/b.txt", b"hi")]


def test_images(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes([9] * 4) for _ in range(3)))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"junk")
    (tmp_path / "c.png").write_bytes(b"")
    t = files.images(spark, str(tmp_path))
    assert {r.origin[-5:]: (r.height, r.width, r.error) for r in t.collect()} == {"a.png": (3, 4, None), "b.png": (None, None, "unsupported or corrupted")}
    assert {(r.doc_type, r.route, r.needs_review) for r in files.error_results(t).collect()} == {("unknown", "error", True)}

    from paperloom.operators.images import quality_table

    assert [(r.dark, r.low_resolution, r.blurry) for r in quality_table(t).collect()] == [(True, True, True)]


def test_feedback_and_exposition(spark, tmp_path):
    fb = spark.createDataFrame([Row(document_id="a", note="x"), Row(document_id="z", note="y")])
    known = spark.createDataFrame([Row(document_id="a")])
    for k in (1, 2):
        assert [r.status for r in files.append_feedback(fb, known, str(tmp_path / "f")).collect()] == [404]
        assert spark.read.json(str(tmp_path / "f")).count() == k
    assert files.exposition(spark.createDataFrame([Row(endpoint="e", n=3)])).first().line == 'requests_total{endpoint="e"} 3'


def test_mix(spark):
    one = spark.createDataFrame([Row(v=1)])
    assert sorted(r.v for r in files.mix([(one, 2), (spark.createDataFrame([Row(v=2)]), 1)]).collect()) == [1, 1, 2]
