"""Collocations against a brute-force version by the stated rules, with every way of dealing prefixes."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from paperloom.llm import collocations, queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, covered, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rank = []
        for p, a in often.items():
            if inside[p] and 100 * inside[p] >= covered * a:
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]]))
        for place, (score, _, p, a, l, r) in enumerate(sorted(rank)[:top], 1):  # noqa: E741
            out.append((lang, place, p.decode(), a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "and", "é", "ÀB", "日本", "x-y", "a\x01b", "a", "\xa0"] + [f"w{k}" for k in range(25)]
    weights = [30, 20, 10] + [3] * (len(vocabulary) - 3)
    rows = [("en", None), (None, ""), ("en", " .. \n\t"), ("de", "the of " * 3000), ("de", "the of " * 3000), (None, "The Of,the of;THE OF the\x0bof the\tof the\n of")]
    for k in range(300):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        if rng.random() < 0.4:
            words[5:5] = ["once", "upon", "a", "time", "the"]
        rows.append((["en", "de", None][k % 3], "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]) for w in words)))
    return rows


@pytest.mark.parametrize("how", ["as is", "no common words", "all split", "two steps", "small blocks"])
def test_equals_brute_force(spark, monkeypatch, how):
    if how == "no common words":
        monkeypatch.setattr(collocations, "COMMON", 3)
    if how == "all split":
        monkeypatch.setattr(collocations, "BUCKETS", 2)
    if how == "two steps":
        monkeypatch.setattr(collocations, "SHARD", 500)
        monkeypatch.setattr(collocations, "ONE_STEP", 4)
    if how == "small blocks":
        monkeypatch.setattr(collocations, "BLOCK", 2000)
    rows = corpus(1)
    frame = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr("*", "'x' AS g", "'x' AS a", "'x' AS rank", "'x' AS phrase").repartition(3)
    least, top = (6, 40) if how != "as is" else (12, 2000)
    got = sorted(tuple(r) for r in collocations.mine_collocations(frame, least=least, top=top).collect())
    want = brute(rows, least, 80, top)
    assert got == want and len(want) > 40


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = collocations.query(spark, "/root/testdata/sf0.01")
    cursor = db.execute(queries.OP11)
    assert got.columns == [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_no_rows(spark):
    for rows in ([], [(None, None)], [("a b", "en")]):
        assert collocations.mine_collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2**63 - 1, size=(5, 1000))
    assert (collocations.unpack(collocations.pack(rows), 1000) == rows).all()
