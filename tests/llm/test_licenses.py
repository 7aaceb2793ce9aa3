"""License scans against a brute-force version over word lists."""

import random
import re

import pytest

from paperloom.llm import licenses

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute_base(text):
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_spans(text, least=licenses.LEAST):
    """Spans of phrases and notices by the stated rules, from all pairs of places."""
    w, spans, notices = words(text), [], []
    for t, (label, own) in enumerate([*licenses.PHRASES, *licenses.NOTICES]):
        own = words(own)
        k, phrase = min(4, len(own)), t < len(licenses.PHRASES)
        hits = {}
        for p in range(len(w) - k + 1):
            for q in range(len(own) - k + 1):
                if w[p : p + k] == own[q : q + k]:
                    hits.setdefault(p - q, set()).add(q)
        groups, last = [], None
        for d in sorted(hits):
            if last is None or d - last > (0 if phrase else min(len(own) // 8, 4)):
                groups.append([])
            groups[-1].append(d)
            last = d
        for g in groups:
            found = len({q + j for d in g for q in hits[d] for j in range(k)})
            span = (min(d + min(hits[d]) for d in g), max(d + max(hits[d]) + k for d in g), label, phrase, found / len(own))
            if phrase and found == len(own):
                spans.append(span)
            elif not phrase and span[4] >= least:
                notices.append((span[0], span[1], t, found, span))
    group, reach = [], 0
    for n in [*sorted(notices, key=lambda n: n[:3]), None]:
        if group and (n is None or n[0] >= reach):
            spans.append(min(group, key=lambda n: (-n[3], -n[4][4], n[4][2], n[0], n[2]))[4])
            group = []
        if n:
            group.append(n)
            reach = max(reach, n[1])
    return sorted(spans)


def texts():
    rng = random.Random(1)
    notice = [text for _, text in licenses.NOTICES]
    filler = "the of and to software license general public gnu cc by mit apache is this under permission a copy"
    out = [None, "", "...", "CC BY", "cc by cc by", "MIT-License", "Größe MIT Lizenz", "the mit licenses", "mit license\x00mit license", notice[0], notice[14].replace("modify", "change it"), "Licensed under CC BY-NC 4.0. Released under the MIT License."]
    out += ["gnu general public license " * 3000, " ".join(notice), " ".join(notice * 3)]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += rng.choices(filler.split(), k=rng.randint(0, 25))
            piece = rng.choice(notice).split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(piece))
                piece[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["x", "y"]])
            w += piece[rng.choice([0, 0, 5]) :]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(licenses, "BROADCAST", 0)
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "mit license"), (3, "cc by")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS uid", "'x' AS spans", "'x' AS label", "'x' AS k")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), r.spans) for r in licenses.scan_licenses(frame).collect())
    want = []
    for k, t in rows:
        spans = brute_spans(t)
        n, base, first, last, labels = brute_base(t)
        want.append((k is None, k or 0, n, base, first, last, labels, ",".join(sorted({s[2] for s in spans})), round(max((s[4] for s in spans), default=0.0), 9), ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)))
    assert got == sorted(want, key=lambda r: r[:4])


def test_documents_equal_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in licenses.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for k, t in rows.items():
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())


def test_no_rows(spark):
    got = licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
