"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text's words are lower-cased (A-Z) and stripped of ASCII punctuation. Each anchor (a stop word) followed by CHAIN content
words (every DISTANCE-th of those after it) gives a signature; the set of a text's signatures, hashed to 32 bits, is its
fingerprint. A text with words but no full chain has one signature, of all its words. Two fingerprints are compared by
Jaccard; `pairs` finds all likely ones by partitions of set length and an inverted index on rare signatures.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, batch_of, blocks, column, cut, documents, mix, randoms, small_batches, width

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu als "
    "à au aux ce dans de des du elle en est et il la le les ne pas pour qui que sur un une "
    "al como con del el es las lo los más no para por se su una y"
).split()
DISTANCE, CHAIN = 1, 2
_U = np.uint64
_STRIP = np.zeros(256, bool)
_STRIP[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _bare(texts: Texts) -> Texts:
    out = Texts.__new__(Texts)
    out.data, out.at, out.n = np.where(_STRIP[texts.data], 32, texts.data).astype(np.uint8), texts.at, texts.n
    return out


def _anchor_hashes() -> np.ndarray:
    return np.sort(Texts(pa.array([" ".join(dict.fromkeys(ANCHORS))])).words()[3])


def signature_sets(texts: Texts, distance: int = DISTANCE, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of each text, and their bounds."""
    _, _, doc, h = _bare(texts).words()
    anchors = _anchor_hashes()
    k = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
    anchor = anchors[k] == h
    content = np.flatnonzero(~anchor)
    before = np.cumsum(~anchor)  # content words up to here
    spots = np.flatnonzero(anchor)
    last = before[spots] + distance * (chain - 1)
    spots = spots[last < len(content)]
    first = before[spots]
    spots, first = (x[doc[content[first + distance * (chain - 1)]] == doc[spots]] for x in (spots, first)) if len(spots) else (spots, first)
    r = randoms(chain + 2, 41)
    s = mix(h[spots]) * r[0]
    for j in range(chain):
        s += mix(h[content[first + distance * j]] + r[j + 1])* r[j + 1] if len(spots) else s
    owner = doc[spots]
    lone = np.setdiff1d(doc, owner)
    if len(lone):
        pick = np.isin(doc, lone)
        order = np.arange(len(h), dtype=_U)
        whole = np.zeros(texts.n, _U)
        start = np.searchsorted(doc, np.arange(texts.n)).astype(_U)
        np.add.at(whole, doc[pick], mix(h[pick] ^ mix(order[pick] - start[doc[pick]])))
        s, owner = np.concatenate((s, mix(whole[lone] ^ r[-1]))), np.concatenate((owner, lone))
    s = (mix(s) >> _U(32)).astype(np.uint32)
    key = np.unique(owner.astype(_U) << _U(32) | s.astype(_U))
    return (key & _U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted((key >> _U(32)).astype(np.int64), np.arange(texts.n + 1))


def fingerprint(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 at once where the lengths alone rule `least` out. Two empty sets are alike (1)."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(many):
        return 1.0
    if not len(few) or len(few) < least * len(many):
        return 0.0
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    j = both / (len(a) + len(b) - both)
    return j if j >= least else 0.0


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that split the documents into about equal parts; at most parts - 1 of them."""
    if parts < 2:
        return []
    got = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(got or []))


def _part(doc_id, bounds: list[int]):
    """How many bounds are at or below the id: a binary search as an expression."""
    if not bounds:
        return F.lit(0)
    at, n = F.array(*[F.lit(b).cast("long") for b in bounds]), len(bounds)
    steps = [F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)]
    return F.reduce(F.array(*steps), F.lit(0), lambda p, s: F.when((p + s <= n) & (F.try_element_at(at, F.least(p + s, F.lit(n))) <= doc_id), p + s).otherwise(p))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near it is to that and to the next document.

    The edited text ends in the next document's beginning: its last floor(n_chars/2) code points give way to as many
    of the next document (or all it has), in ascending doc_id, the first following the last. Texts are dealt once, by
    ranges of doc_id; each range also gets the first document of the one after it.

    Null texts are empty; empty ones have the empty fingerprint, and are alike (1) to empty ones only (else 0). Rows
    that share a doc_id follow each other in the order of their texts; a null doc_id comes first. A lone document is its own
    next. Very long texts are read whole. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = -(2**63)
    docs = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(least)).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    parts = parts or width(spark)
    ids = docs.select("doc_id")
    bounds = _bounds(ids, parts)
    firsts = {r.p: r.d for r in ids.groupBy(_part(F.col("doc_id"), bounds).alias("p")).agg(F.min("doc_id").alias("d")).collect()}
    n_parts, present = len(bounds) + 1, sorted(firsts)
    before = dict(zip(present, present[-1:] + present[:-1]))  # each part's first document also goes to the part before it
    of_part = lambda values: F.array(*[F.lit(values.get(p)).cast("long") for p in range(n_parts)])
    part = _part(F.col("doc_id"), bounds).cast("int")
    extra = F.when(F.get(of_part(firsts), part) == F.col("doc_id"), F.get(of_part(before), part)).cast("int")
    rows = docs.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(part.alias("p"), F.lit(0).alias("late")), F.struct(extra.alias("p"), F.lit(1).alias("late"))), lambda x: x.p.isNotNull())).alias("at"))
    rows = rows.select(F.col("at.p").alias("p"), F.col("at.late").alias("late"), "doc_id", "text").repartitionById(n_parts, F.col("p")).sortWithinPartitions("late", "doc_id", "text").drop("p")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64())])

    def run(batches):
        carry, late_seen = None, False

        def emit(ids, texts):  # the last text only follows
            edited = []
            for a, b in zip(texts, texts[1:]):
                n = len(a) // 2
                edited.append(a[: len(a) - n] + b[:n])
            own, at = signature_sets(Texts(pa.array(texts, pa.large_string())))
            new, to = signature_sets(Texts(pa.array(edited, pa.large_string())))
            sets, changed = [own[s:e] for s, e in zip(at, at[1:])], [new[s:e] for s, e in zip(to, to[1:])]
            n = len(edited)
            return batch_of(
                schema, [None if x == least else x for x in ids[:n]], [len(x) for x in texts[:n]], [hashlib.sha256(x.encode()).hexdigest() for x in edited], [fingerprint(x) for x in sets[:n]], [fingerprint(x) for x in changed],
                [pruned_jaccard(a, b) for a, b in zip(sets, changed)], [pruned_jaccard(a, b) for a, b in zip(sets, sets[1:])], [len(x) for x in sets[:n]],
            )

        for b in blocks(batches, 1 << 20):
            ids, texts, late = column(b, "doc_id").to_pylist(), column(b, "text").to_pylist(), column(b, "late").to_pylist()
            stop = late.index(1) + 1 if 1 in late else len(late)  # of repeated first documents, the first one follows
            if late_seen:
                continue
            late_seen = stop <= len(late) and late[stop - 1] == 1
            ids, texts = ids[:stop], texts[:stop]
            if carry:
                ids, texts = [carry[0], *ids], [carry[1], *texts]
            if len(ids) > 1:
                yield emit(ids, texts)
            carry = (ids[-1], texts[-1])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, fp, sigs of documents that have an id and a signature."""
    small_batches(docs.sparkSession, 500)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("doc_id is not null")

    def run(batches):
        for b in blocks(batches):
            sets, at = signature_sets(Texts(column(b, "text")))
            own = [sets[s:e] for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([len(x) for x in own], pa.int32()), pa.array([fingerprint(x) for x in own]), pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], ["doc_id", "n", "fp", "sigs"])

    return docs.mapInArrow(run, "doc_id long, n int, fp string, sigs array<long>").filter("n > 0")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and rep, the smallest doc_id with the same fingerprint."""
    sets = _sets(docs, id_col, text_col).select("doc_id", F.sha2("fp", 256).alias("fp"))
    return sets.join(sets.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp").select("doc_id", "rep")


def pairs(docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints with Jaccard >= least, by their smallest doc_id; `classes` tells who shares one.

    Sets are partitioned by the logarithm of their length to base 1/least, so partners lie in one's own partition or the
    next. Within a partition they meet through the rarest signatures of their prefix, longest possible for the threshold.
    """
    sets = _sets(docs, id_col, text_col)
    reps = cut(sets.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sigs").alias("sigs")).drop("fp"))
    tokens = reps.select("doc_id", "n", F.explode("sigs").alias("sig"))
    freq = tokens.groupBy("sig").agg(F.count("*").alias("df"))
    w = Window.partitionBy("doc_id").orderBy("df", "sig")
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / least) if least < 1 else 1e9)).cast("int")
    prefix = tokens.join(freq, "sig").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("doc_id", "n", "sig", level.alias("level"))
    other = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"))
    found = prefix.withColumnRenamed("doc_id", "a").join(other, ["sig", "level"]).filter((F.col("a") != F.col("b")) & (F.col("n") <= F.col("nb")) & (F.col("n") >= F.col("nb") * least - 1e-9) & ((F.col("n") < F.col("nb")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    x, y = reps.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), reps.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    scored = found.join(x, "a").join(y, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (both / (F.size("sa") + F.size("sb") - both)).alias("likeness"))
    return scored.filter(F.col("likeness") >= least - 1e-12)


def query(spark, sf_dir):
    return fingerprint_documents(documents(spark, sf_dir))
