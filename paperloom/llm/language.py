"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte 1- to 3-grams (in lower case, without digits and punctuation), of length one. Document frequencies
come from all training documents; several centroids for every language from spherical k-means over a sample by a hash of
doc_id, each of its rows taken with the chance that makes SAMPLE documents of them all (all, if there are fewer). Each
language is clustered by one task; the driver gets its centroids, 64 KB a language. A text takes the language of the centroid with the
largest cosine. It is rejected when it has no letter or when its cosine, times `reject`, is below nearly all (all but QUANTILE)
cosines of its language's texts of about as many distinct grams, on which cosines depend. These come from the sample's
documents and from pieces of them, cut at words to lengths that double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, column, crc_mod, cut, documents, forget, small_batches

DIMS = 4096
CENTROIDS = 4
#: Sample size of each language.
SAMPLE = 520
REJECT = 2.0
#: Classes go by the binary logarithm of the distinct grams; a class counts if it has LEAST texts. Pieces are cut up to 3 << PIECES characters.
CLASSES, QUANTILE, LEAST, PIECES = 16, 0.01, 20, 14
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def folded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case (A-Z and the Latin-1 letters), each run of other ASCII as one space; bounds of the texts."""
    data = _FOLD[texts.data]
    after = np.flatnonzero(texts.data[:-1] == 0xC3) + 1
    b = data[after]
    data[after] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, b)
    keep = data != 32
    keep[1:] |= keep[:-1]
    return data[keep].astype(np.uint32), np.concatenate(([0], np.cumsum(keep)))[texts.at]


def gram_counts(texts: Texts, dims: int = DIMS) -> np.ndarray:
    """Hashed gram counts of each text, as rows."""
    data, edges = folded(texts)
    n, cells = len(data), np.zeros((texts.n, dims), np.float32)
    codes = []
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)
    code = np.zeros(n, np.uint32)
    for k in range(min(3, n)):
        code[: n - k] = code[: n - k] << np.uint32(8) | data[k:]
        h = ((code + np.uint32(k << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - dims.bit_length() + 1)
        h[left <= k] = dims  # beyond the text's end
        codes.append(h)
    for d in range(texts.n):
        s, e = edges[d], edges[d + 1]
        for h in codes:
            cells[d] += np.bincount(h[s:e], minlength=dims + 1)[:dims]
    return cells


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x


def has_letter(texts: Texts) -> np.ndarray:
    edges = texts.at
    total = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))
    out = total[edges[1:]] > total[edges[:-1]]
    for d in np.flatnonzero(~out & (np.diff(edges) > 0)).tolist():
        out[d] = any(c.isalpha() for c in texts.bytes(d).decode("utf-8", "replace"))
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids; farthest-first start, empty clusters dropped."""
    at = [int(np.random.default_rng(seed).integers(len(x)))]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin((x @ x[at].T).max(axis=1))))
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def gram_classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(np.int32), CLASSES - 1)


def pieces(text: str) -> list[str]:
    """The text, and a piece from its start and one from its middle for each length below its own."""
    out = [text]
    for k in range(1, PIECES + 1):
        n = 3 << k
        if n >= len(text):
            break
        for at in (0, len(text) // 2):
            at = text.find(" ", at) + 1 if at else 0
            end = text.find(" ", at + n - n // 4, at + n + n // 4)
            out.append(text[at : end if end > 0 else at + n])
    return out


def floors_of(quantiles: dict[int, float], reject: float) -> np.ndarray:
    """The cosine below which each class rejects: its low quantile over reject, and no less than in the class before it, as junk in the sample can pull one class down."""
    return np.maximum.accumulate([max(0.0, quantiles.get(k, 0.0)) / reject for k in range(CLASSES)])


class Model:
    """idf, centroids (rows), the language of each, and the cosine below which each rejects, by class of distinct grams."""

    def __init__(self, idf, centroids, languages, floors):
        self.idf, self.centroids, self.languages, self.floors = idf, centroids, languages, floors

    def predict(self, texts: Texts):
        """(language or und, cosine in 0..1, rejected) of each text."""
        letters = has_letter(texts)
        if not self.languages:
            return ["und"] * texts.n, np.zeros(texts.n), np.ones(texts.n, bool)
        counts = gram_counts(texts, len(self.idf))
        classes = gram_classes(counts)
        v = vectors(counts, self.idf)
        # a product's last digits hang on how many texts it holds: equal texts must agree, so the winner's cosine is summed text by text
        best = np.round(v @ self.centroids.T, 6).argmax(axis=1)
        score = np.clip(np.einsum("ij,ij->i", v, self.centroids[best]), 0, 1).astype(float)
        score[~letters] = 0.0
        return [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], score, ~letters | (score < self.floors[best, classes])


def train(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, reject: float = REJECT, dims: int = DIMS) -> Model:
    """docs: doc_id, text, lang; rows without text or lang are left out."""
    rows = docs.filter("text is not null and lang is not null and length(text) > 0")
    if rows.isEmpty():
        return Model(np.zeros(dims, np.float32), np.zeros((0, dims), np.float32), [], np.zeros((0, CLASSES)))

    def frequencies(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in blocks(batches):
            df += (gram_counts(Texts(column(b, "text")), dims) > 0).sum(axis=0)
            n += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, dims), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["dim", "n"])

    df = np.zeros(dims + 1)
    for r in rows.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r.dim] = r.n
    idf = np.log((1 + df[dims]) / (1 + df[:dims])).astype(np.float32) + np.float32(0.1)
    scale = 1 << 30
    shares = rows.groupBy("lang").agg(F.least(F.lit(scale), F.ceil(F.lit(float(scale) * sample) / F.count("*"))).cast("long").alias("share"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(scale))
    picked = rows.join(F.broadcast(cut(shares)), "lang").filter(h < F.col("share"))  # a row for each language
    picked = cut(picked.groupBy("lang", "doc_id").agg(F.min("text").alias("text")))

    def cluster(table: pa.Table) -> pa.Table:
        x = np.concatenate([gram_counts(Texts(t), dims) for t in table.sort_by("doc_id").column("text").chunks])
        c = spherical_kmeans(vectors(x, idf), centroids).astype(np.float32)
        return pa.table({"lang": table.column("lang")[: len(c)], "k": np.arange(len(c)), "c": pa.array([x.tobytes() for x in c], pa.binary())})

    got = sorted(picked.groupBy("lang").applyInArrow(cluster, "lang string, k long, c binary").collect())
    names, all_c = [r.lang for r in got], np.stack([np.frombuffer(bytes(r.c), np.float32) for r in got])
    by_lang = {name: all_c[[k for k, x in enumerate(names) if x == name]] for name in dict.fromkeys(names)}

    def own_cosines(batches):
        for b in batches:
            for name, text in zip(column(b, "lang").to_pylist(), column(b, "text").to_pylist(), strict=True):
                if name in by_lang:
                    cut = Texts(pa.array(pieces(text), pa.string()))
                    counts, letters = gram_counts(cut, dims), has_letter(cut)
                    own = (vectors(counts, idf) @ by_lang[name].T).max(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * int(letters.sum()), pa.string()), pa.array(gram_classes(counts)[letters]), pa.array(own[letters].astype(float))], ["lang", "class", "cosine"])

    lows: dict[str, dict[int, float]] = {name: {} for name in by_lang}
    own = picked.select("lang", "text").mapInArrow(own_cosines, "lang string, class int, cosine double")
    for r in own.groupBy("lang", "class").agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(QUANTILE)).alias("low")).filter(F.col("n") >= LEAST).collect():
        lows[r.lang][r["class"]] = r.low
    forget(picked)
    floors = {name: floors_of(low, reject) for name, low in lows.items()}
    return Model(idf, all_c, names, np.stack([floors[name] for name in names]))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text and the columns of keep) with lang_pred, score and rejected."""
    names = list(dict.fromkeys(["doc_id", "text", *keep]))
    kept = [f for f in docs.select(*names).schema.fields if f.name != "text" or "text" in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        for b in blocks(batches):
            lang, score, rejected = model.predict(Texts(column(b, "text")))
            yield pa.RecordBatch.from_arrays([*(column(b, f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*(f.name for f in kept), "lang_pred", "score", "rejected"])

    return docs.select(*names).mapInArrow(run, ddl)


def identify_languages(docs: DataFrame, holdout_mod: int = 4, holdout: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; learns from the documents that aren't held out.

    Null texts and those without a letter are und, with score 0, and rejected. With no document to learn from, all are und.
    Ties go to the language first in the alphabet. Very long texts are read whole. Repeated rows give repeated results, an empty table an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    doc_id = docs["doc_id"].cast("long")
    held = F.coalesce(crc_mod(doc_id, holdout_mod) == holdout, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), held.alias("held"))
    return identify(rows, train(rows.filter("not held"))).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), holdout_mod) == holdout, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def query(spark, sf_dir):
    return identify_languages(documents(spark, sf_dir))
