"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed binary features (words, and their first four and five bytes) is trained from confirmed
toxic documents and unlabelled text only. The risk is  P * R+(positive)  +  max(0, R-(unlabelled) - P * R-(positive)),
P being the class prior; when the second part falls below zero, the step climbs it instead, so that the model can't
explain the hidden positives among the unlabelled away. P is the share of toxic ones among labelled training documents times a margin that is chosen on training rows: by folds, the
one under which models tell held positives from documents labelled clean best.
Both are samples by a hash of doc_id, each row taken with the chance that makes POSITIVES and UNLABELLED documents of
them all (all, if there are fewer). Features are counted and chosen where the sample is; the driver gets the chosen
features (MOST of them at most) and, for each sampled document, which of them it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch_of, blocks, column, crc_mod, cut, documents, forget, mix, small_batches

POSITIVES, UNLABELLED = 1500, 4500
ROUNDS = 1500
#: Share of the positives that a feature must be in, so that copies of one document choose none.
LEAST_SHARE = 0.02
#: What the share of toxic ones among labelled documents may be multiplied by (the middle one where nothing tells): too small a prior turns
#: hidden positives into negatives, while the bound at zero holds too large a one. Folds and rounds of the choice.
MARGINS, FOLDS, CHOICE_ROUNDS = (1.0, 1.15, 1.3), 3, 300
#: Features of a model, the ones with the largest excess among positives; the size of the model, not a cap on documents.
MOST = 4096
_U = np.uint64
_PUNCTUATION = b".,!?;:\"'()"


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features in the order of the words and the bounds of each text; one may repeat within a text."""
    table = np.zeros(256, bool)
    table[[*_PUNCTUATION]] = True
    data = texts.data
    if len(data) and table[data].any():  # punctuation counts as space
        clean = Texts.__new__(Texts)
        clean.data, clean.at, clean.n = np.where(table[data], 32, data).astype(np.uint8), texts.at, texts.n
        texts = clean
    starts, lengths, doc, h = texts.words()
    low = texts.data | np.where((texts.data >= 65) & (texts.data <= 90), 32, 0).astype(np.uint8)
    padded = np.concatenate((low, np.zeros(5, np.uint8))).astype(_U)
    parts = [h >> _U(1)]
    code = np.zeros(len(starts), _U)
    for k in range(5):
        code = code << _U(8) | np.where(lengths > k, padded[starts + k], _U(0))
        if k >= 3:
            parts.append(mix(code + _U(k)) >> _U(1))
    at = np.searchsorted(doc, np.arange(texts.n + 1)) * len(parts)
    return np.stack(parts, axis=1).reshape(-1).view(np.int64), at


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of the chosen features (sorted hashes) and a bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, float(bias)

    def score(self, texts: Texts) -> np.ndarray:
        """Sigmoid of the summed weights of the distinct chosen features."""
        out = np.full(texts.n, self.bias)
        if len(self.chosen):
            codes, at = features(texts)
            k = np.minimum(np.searchsorted(self.chosen, codes), len(self.chosen) - 1)
            hit = np.flatnonzero(self.chosen[k] == codes)
            cell = np.unique((np.searchsorted(at, hit, "right") - 1) * len(self.chosen) + k[hit])
            out += np.bincount(cell // len(self.chosen), weights=self.weights[cell % len(self.chosen)], minlength=texts.n)
        return sigmoid(out)


def choose(counts: DataFrame, n_p: int, n_u: int, prior: float, most: int = MOST) -> np.ndarray:
    """Sorted codes of the features (code, in_p, in_u: documents of either sample that have it) of whose documents at least
    half would be positive under the prior, beyond what chance explains."""
    expected = F.col("in_u") * (n_p / n_u)
    excess = (F.col("in_p") - expected) / F.sqrt(expected + 0.5)
    good = (F.col("in_p") >= max(3, LEAST_SHARE * n_p)) & (prior * F.col("in_p") >= 0.5 * expected) & (excess >= 4)
    rows = counts.filter(good).select("code", excess.alias("excess")).orderBy(F.desc("excess"), "code").limit(most).collect()
    return np.sort(np.array([r.code for r in rows], np.int64))


def fit(rows: list[np.ndarray], positive: np.ndarray, chosen: np.ndarray, prior: float, rounds: int = ROUNDS, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Full-batch descent on the non-negative risk with logistic loss. rows: each document's features, as places in chosen."""
    bias, n_p, n_u = float(np.log(prior / (1 - prior))), int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not len(chosen):
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    flat, of = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    w, b, is_p = np.zeros(len(chosen)), bias, positive
    for _ in range(rounds):
        z = np.bincount(of, weights=w[flat], minlength=len(rows)) + b
        s, loss = sigmoid(z), np.logaddexp(0, z)
        if loss[~is_p].mean() - prior * loss[is_p].mean() >= 0:
            g = np.where(is_p, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)
        else:
            g = np.where(is_p, prior * s / n_p, -s / n_u)
        w -= rate * (np.bincount(flat, weights=g[of], minlength=len(chosen)) + decay * w)
        b -= rate * g.sum()
    return Model(chosen, w, b)


def chosen_margin(rows: list[np.ndarray], positive: np.ndarray, clean: np.ndarray, fold: np.ndarray, chosen: np.ndarray, share: float) -> float:
    """The margin whose models, each fitted without a fold, get most of that fold right: the mean of the shares of positives and of clean documents. Ties go to the one nearest the middle, then to the larger."""
    middle = MARGINS[len(MARGINS) // 2]
    if min(positive.sum(), clean.sum()) < 10 * FOLDS or not len(chosen):
        return middle
    best = {}
    for margin in MARGINS:
        z = np.zeros(len(rows))
        for k in range(FOLDS):
            own = np.flatnonzero(fold != k)
            model = fit([rows[i] for i in own], positive[own], chosen, bounded(margin * share), CHOICE_ROUNDS)
            for i in np.flatnonzero(fold == k):
                z[i] = model.bias + (model.weights[rows[i].astype(np.int64)].sum() if len(model.weights) else 0.0)
        best[margin] = ((z[positive] >= 0).mean() + (z[clean] < 0).mean()) / 2
    return max(MARGINS, key=lambda m: (round(best[m], 9), -abs(m - middle), m))


def bounded(prior: float) -> float:
    return min(max(prior, 0.01), 0.9)


def train(rows: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """rows: doc_id, text. labels: doc_id, toxic; both without what is held out. Of rows that share a doc_id the smallest text counts."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = None if prior is not None else float(labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.1)
    prior = bounded(prior if share is None else MARGINS[len(MARGINS) // 2] * share)
    rows = rows.filter("doc_id is not null").select("doc_id", "text")
    scale = 1 << 30
    chance = lambda n, total, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(scale)) < int(scale * min(1.0, n / max(total, 1)))
    toxic = cut(labels.filter("toxic = 1").select("doc_id").join(rows.select("doc_id"), "doc_id", "left_semi"))
    known = F.broadcast(toxic.filter(chance(positives, toxic.count(), 1)).withColumn("positive", F.lit(True)))  # about `positives` ids, whatever the input
    total = rows.count()
    own = [rows.join(known, "doc_id"), rows.filter(chance(unlabelled, total, 2)).withColumn("positive", F.lit(False))]
    sample = own[0].unionByName(own[1]).groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    told = F.broadcast(sample.select("doc_id").distinct()).join(labels, "doc_id").select("doc_id", (F.col("toxic") == 0).alias("clean"))  # of the sampled ids
    sample = cut(sample.join(told, "doc_id", "left").withColumn("clean", F.coalesce("clean", F.lit(False))))
    n_p, n_u = (sample.filter(c).count() for c in ("positive", "not positive"))
    counted = pa.schema([("code", pa.int64()), ("in_p", pa.int64()), ("in_u", pa.int64())])

    def count(batches):
        for b in blocks(batches, 1 << 20):
            codes, at = features(Texts(column(b, "text")))
            once = [np.unique(codes[s:e]) for s, e in zip(at, at[1:])]
            code, place = np.unique(np.concatenate(once), return_inverse=True)
            of_p = np.repeat(np.asarray(column(b, "positive")), [len(x) for x in once])
            n = [np.bincount(place[of_p == k], minlength=len(code)).astype(np.int64) for k in (True, False)]
            yield batch_of(counted, code, *n)

    model = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if n_p and n_u:
        counts = sample.mapInArrow(count, "code long, in_p long, in_u long").groupBy("code").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
        chosen = choose(counts, n_p, n_u, prior)

        def places(batches):
            for b in blocks(batches, 1 << 20):
                codes, at = features(Texts(column(b, "text")))
                k = np.minimum(np.searchsorted(chosen, codes), max(len(chosen) - 1, 0))
                hit = chosen[k] == codes if len(chosen) else np.zeros(len(codes), bool)
                own = [np.unique(k[s:e][hit[s:e]]).astype(np.uint16).tobytes() for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "positive"), column(b, "clean"), pa.array(own, pa.binary())], ["doc_id", "positive", "clean", "x"])

        got = sorted(sample.mapInArrow(places, "doc_id long, positive boolean, clean boolean, x binary").collect())
        own, positive, clean = [np.frombuffer(bytes(r.x), np.uint16) for r in got], np.array([r.positive for r in got]), np.array([r.clean for r in got])
        if share is not None:
            fold = (mix(np.array([r.doc_id for r in got], np.int64).view(_U)) % _U(FOLDS)).astype(np.int64)  # an id's rows share a fold
            prior = bounded(share * chosen_margin(own, positive, clean & ~positive, fold, chosen, share))
        model = fit(own, positive, chosen, prior)
    forget(toxic, sample)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    names = list(dict.fromkeys(["doc_id", "text", *keep]))
    kept = [f for f in docs.select(*names).schema.fields if f.name != "text" or "text" in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tox_score double"

    def run(batches):
        for b in blocks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([*(column(b, f.name) for f in kept), pa.array(model.score(Texts(column(b, "text"))))], [*(f.name for f in kept), "tox_score"])

    return docs.select(*names).mapInArrow(run, ddl)


def holdout(doc_id, mod: int = 5):
    return F.coalesce(crc_mod(doc_id, mod) == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, holdout_mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels of documents that aren't held out.

    Null and empty texts score what the bias alone gives. Without positives or unlabelled text every score is that of
    an untrained bias (below 0.5). Very long texts are read whole; no ties arise. An empty table gives an empty result, and other columns,
    whatever their names, are left alone. Repeated label rows count once, toxic if any says so; repeated documents give repeated results.
    """
    small_batches(docs.sparkSession)
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), docs["text"].cast("string").alias("text"))
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    learn = ~holdout(F.col("doc_id"), holdout_mod)
    model = train(rows.filter(learn), labels.filter(learn))
    out = score(rows, model)
    return out.select("doc_id", holdout(F.col("doc_id"), holdout_mod).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
