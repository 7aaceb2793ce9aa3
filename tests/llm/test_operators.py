"""The training-data operators against brute force, round trips and edge cases on small tables."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import bpe, language, links, minhash, ngram, packing, secrets, spotsigs, toxicity
from paperloom.llm.common import Texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
EDGE = [
    (1, None, None, None, None, "a"), (2, "", "en", "s", 0, "a"), (3, " \t\n ", "en", "s", 3, "a"), (4, "one", "en", "s", 3, "a"),
    (5, "the cat sat on the mat and the dog ran to the house of it", "en", "s", 57, "a"), (6, "the cat sat on the mat and the dog ran to the house of it", "en", "t", 57, "b"),
    (7, "word " * 30000, "en", "s", 150000, "a"), (8, 'token = "abcdef0123456789abcdef" ok', "en", "s", 36, "a"), (9, "Größe É 日本語 🤣", "de", "s", 14, "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(edge, empty):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.vocabulary()), bpe.BpeCodec(bpe.vocabulary())
    for text in [t for _, t, *_ in EDGE if t is not None] + ["It's <|endoftext|> x　y \x1c ΑΣ İ ½", "a" * 3000]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(edge).count() == len(EDGE) and bpe.encode_decode(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdethingLMN'.,!0 \n\té日"), max_size=60))
def test_bpe_random(text):
    from tokenizers import Tokenizer

    lib = test_bpe_random.__dict__.setdefault("lib", Tokenizer.from_file(bpe.vocabulary()))
    own = test_bpe_random.__dict__.setdefault("own", bpe.BpeCodec(bpe.vocabulary()))
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_packing(edge, empty):
    rows = packing.pack_documents(edge).collect()
    by = {}
    for r in rows:
        assert 1 <= r.length <= 2048
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert {r.doc_id for r in rows} == {d[0] for d in EDGE}
    assert packing.pack_documents(empty).count() == 0


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 10**12, 1000).astype(np.uint64))
    ef = ngram.EliasFano.of(x)
    assert (ef[np.arange(1000)] == x).all()
    q = np.concatenate((x[::7], rng.integers(0, 10**12, 500).astype(np.uint64), [np.uint64(2**63)]))
    assert (ef.successor(q) == np.searchsorted(x, q)).all()
    w, v, u = (rng.integers(10, 40, 3000).astype(np.uint64) for _ in range(3))
    g, n = np.unique(np.stack((w, v, u)), axis=1, return_counts=True)
    hot = (ngram.Hot(), ngram.Hot())
    trie = ngram.Trie.build(*g, n, hot, 0.01)
    trie.save(str(tmp_path / "t"))
    mapped = ngram.Trie.map(str(tmp_path / "t"))
    num, den, c = mapped.lookup(*g, 0.01, hot)
    cw, cp = Counter(), Counter()
    for a, b, k in zip(g[0].tolist(), g[1].tolist(), n.tolist()):
        cw[a] += k
        cp[a, b] += k
    for k in range(0, g.shape[1], 97):
        a, b = int(g[0, k]), int(g[1, k])
        assert c[k] == cw[a]
        assert abs(num[k] - np.log10(n[k] + ngram.A * cp[a, b] + 0.01 * (cw[a] + 0.1))) < 1e-3
        assert abs(den[k] - np.log10(cp[a, b] + ngram.A * cw[a] + ngram.MU)) < 1e-3


def test_lm_scores(edge, empty):
    rows = {r.doc_id: r for r in ngram.score_documents(edge).collect()}
    assert len(rows) == len(EDGE) and rows[1].n_tokens == 1 and rows[7].n_tokens == 30001
    assert all(r.score < 0 and r.base_score < 0 for r in rows.values())
    assert ngram.score_documents(empty).count() == 0


def test_minhash(edge, empty):
    rows = {r.doc_id: r for r in minhash.near_duplicates(edge).collect()}
    assert rows[6].component_id == 5 and not rows[6].kept and rows[5].kept
    assert rows[1].n_shingles == rows[2].n_shingles == rows[3].n_shingles == 0 and rows[3].kept and rows[4].n_shingles == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(6)]
    docs = []
    for k in range(120):
        words = list(base[k % 6])
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 60))] = f"x{k}"
        docs.append((k, " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == label


def families(members, pairs, shared, unique, extra):
    """A template family: documents of a shared passage and a tail each; of the first ones, pairs share a part of their tails."""
    word = lambda *k: "w" + "x".join(map(str, k))
    docs = []
    for k in range(members):
        common = [word("p", k // 2, x) for x in range(extra)] if k < 2 * pairs else [word("q", k, x) for x in range(extra)]
        docs.append((k, " ".join([word(x) for x in range(shared)] + common + [word("t", k, x) for x in range(unique)])))
    return docs


def test_minhash_finds_pairs_in_template_families(spark):
    docs = families(300, 100, 204, 34, 7)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert like(0, 1) >= 0.75 and like(0, 2) < 0.75 and like(298, 299) < 0.75
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 if k < 200 else k for k in range(300)}


def test_shared_prefixes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(5)
    sets, base = [], np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    for k in range(150):
        x = base[rng.random(len(base)) < rng.uniform(0.8, 1)] if k % 3 else base[: int(rng.integers(1, 9))]
        sets.append(np.unique(np.concatenate((x, rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)))))
    frame = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "doc_id long, shingles binary")
    members = spark.createDataFrame([(k, k % 40) for k in range(150)], "rep long, component long")
    got = {(r.a, r.b) for r in minhash.shared_prefixes(members, frame).collect()}
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if a % 40 != b % 40 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= got and all(a < b and a % 40 != b % 40 for a, b in got)


def test_spotsigs(spark, edge, empty):
    rows = {r.doc_id: r for r in spotsigs.fingerprint_documents(edge).collect()}
    assert len(rows) == len(EDGE)
    assert rows[5].fingerprint == rows[6].fingerprint and rows[5].near_next == 1.0
    assert rows[1].n_chars == 0 and rows[1].near_next == 1.0 and rows[3].near_next == 0.0
    assert spotsigs.fingerprint_documents(empty).count() == 0
    text = "the quick fox of a red barn in the cold town was for sale and the old man took it to his home by the long road"
    docs = [(1, text), (2, text.replace("quick", "slow")), (4, text + " now"), (3, "nothing here is like the other text at all for the rest of us")]
    assert [(r.a, r.b) for r in spotsigs.pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [(1, 2)]
    assert {r.doc_id: r.rep for r in spotsigs.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_language_and_toxicity(spark, edge, empty):
    docs = [(k, ("the and of that with this from " if k % 2 else "der die und nicht mit auf ein ") * 5 + f"w{k}" + (" moron scum" if k % 5 == 1 else ""), "en" if k % 2 else "de", "s", 0, "") for k in range(200)]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = language.identify_languages(frame).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in language.identify_languages(edge).collect()}[1] == "und"
    assert language.identify_languages(empty).count() == 0
    labels = spark.createDataFrame([(k, int(k % 5 == 1)) for k in range(0, 200)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame, labels).collect()
    assert sum(r.predicted == int(r.doc_id % 5 == 1) for r in got) >= 198
    assert toxicity.score_toxicity(empty, labels.limit(0)).count() == 0
    assert toxicity.score_toxicity(edge, labels.limit(0)).count() == len(EDGE)


def test_language_rejects_unlearned_languages_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.filter("doc_id % 4 <> 2"))
    strange = [
        "Wczoraj wieczorem poszliśmy do kina, żeby zobaczyć nowy film o przyrodzie", "Hôm nay trời rất đẹp và chúng tôi đi dạo trong công viên gần nhà",
        "Σήμερα ο καιρός είναι καλός και πηγαίνουμε στη θάλασσα", "Сегодня хорошая погода и мы идем гулять в парк", "今天天气很好我们去公园散步",
        "asdkjh qwpoei zmxncb qpwoei laksjd zxmnbv qowieu alskdj", "dGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kZWQgZGF0YQ==aGVsbG8gd29ybGQ",
    ]
    assert model.predict(Texts(pa.array(strange)))[2].all()
    held = language.identify(docs.filter("doc_id % 4 = 2"), model, keep=("lang", "text")).filter("lang is not null and score > 0")
    assert held.count() > 100 and held.filter("rejected").count() <= held.count() // 100


def test_secrets(edge, empty):
    rows = {r.doc_id: r for r in secrets.find_secrets(edge).collect()}
    assert (rows[8].n_assign, rows[8].n_hex) == (1, 1) and rows[8].spans == "assign:0:31,hex:9:31" and rows[1].spans == ""
    assert secrets.find_secrets(empty).count() == 0
    out = {r.doc_id: r for r in secrets.redact(edge).collect()}
    assert out[8].text == '[secret]" ok' and out[8].n_chars == 12 and out[1].text is None and out[7].text == EDGE[6][1]


def test_copied_examples(spark):
    docs = [(k, "AKIA" + "B" * 16, "en", f"s{k}", 20, "") for k in range(4)] + [(9, "AKIA" + "C" * 16, "en", "s1", 20, "")]
    rows = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert rows[0].n_copied == 1 and rows[9].n_copied == 0


def test_links(spark):
    pages = [(1, "http://A.example.com/en/71?x", None), (2, "https://b.org/es/1", '<a href="http://c.net/x">'), (3, "http://c.net/fr/", ""), (4, None, None), (5, "nourl", ""), (6, "http://d.info/a", "<a href='//b.org/es/1'>"), (7, "http://b.org/es/2", "")]
    rows = {r.page_id: r for r in links.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert rows[2].verdict == "block" and rows[6].verdict == "block" and rows[4].host == "" and rows[5].verdict == "allow"
    assert links.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_words():
    t = Texts(pa.array(["Ab  cd\tab", None, "é\x0bAB"]))
    starts, lengths, doc, h = t.words()
    assert doc.tolist() == [0, 0, 0, 2, 2] and lengths.tolist() == [2, 2, 2, 2, 2]
    assert h[0] == h[2] == h[4] and h[1] != h[0]
