"""The n-gram model against a brute-force version: whole query, split n-grams, repeated and null ids."""

import random
from collections import Counter
from math import log10
from zlib import crc32

import pytest

from paperloom.llm import ngram


def brute(docs, held=lambda i: i is not None and crc32(str(i).encode()) % 10 == 0):
    """doc rows -> (doc_id, held_out, n_tokens, n_known, base, score), with the mixture as the module's docstring has it."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(lower)).split(" ") if w]
    rows = [(i, ["<s>", "<s>", *split(t), "</s>"]) for i, t in docs]
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if held(i):
            continue
        texts += 1
        for k in range(2, len(t)):
            one[t[k]] += 1
            two[t[k - 1], t[k]] += 1
            three[t[k - 2], t[k - 1], t[k]] += 1
    n, v = sum(one.values()), len(one)
    z = n + 0.1 * (v + 1)
    one_context, two_context = Counter(one), Counter(two)
    one_context["<s>"], two_context["<s>", "<s>"] = texts, texts
    out = []
    for i, t in rows:
        base = sum(log10((one[w] + 0.1) / z) for w in t[2:])
        score = 0.0
        for k in range(2, len(t)):
            u, w0, w = t[k - 2], t[k - 1], t[k]
            score += log10((three[u, w0, w] + ngram.A * two[w0, w] + ngram.MU / z * (one[w] + 0.1)) / (two_context[u, w0] + ngram.A * one_context[w0] + ngram.MU))
        out.append((i, held(i), len(t) - 2, sum(one[w] > 0 for w in t[2:]), base, score))
    return out, n


def texts(n, seed):
    r = random.Random(seed)
    line = "the same line in many places"
    for k in range(n):
        words = [r.choice(["the", "of", "a", f"w{r.randrange(30)}", f"x{r.randrange(3000)}"]) for _ in range(r.randrange(0, 60))]
        yield k, " ".join(words) + (" " + line if k % 3 == 0 else "")


@pytest.mark.parametrize("shard_tokens,common", [(2_000_000, 1 << 18), (300, 1 << 18), (300, 8)])
def test_scores_equal_brute_force(spark, shard_tokens, common):
    docs = [*texts(150, 4), (1, "THE same\tline"), (1, "THE same\tline"), (1, "other"), (None, "the of a"), (None, None), (200, None), (201, ""), (202, " \n "), (203, "É the 日本"), (204, "the " * 3000)]
    want, n = brute(docs)
    frame = spark.createDataFrame([(i, t, "x", 1.0, 0) for i, t in docs], "doc_id long, text string, shard string, score double, block long")
    got = ngram.score_documents(frame.repartition(3), shard_tokens=shard_tokens, common=common).collect()
    assert {r.train_tokens for r in got} == {n}
    key = lambda r: (str(r[0]), r[2], round(r[4], 3))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    want.sort(key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert abs(g[4] - w[4]) < 1e-7 * (1 + abs(w[4])) and abs(g[5] - w[5]) < 2e-4 * (1 + w[2]) ** 0.5 + 1e-5 * w[2]


def test_nothing_to_learn_from(spark):
    held = [k for k in range(60) if crc32(str(k).encode()) % 10 == 0]
    got = ngram.score_documents(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-6 for r in got)  # V + 1 is 1: the unknown word is certain
