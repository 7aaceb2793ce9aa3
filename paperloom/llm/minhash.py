"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star edges.

1. Every document gets its set of five-word shingles, a 128-bit fingerprint of the set and the bucket keys of its
   bands. Equal sets are one class, named by its smallest doc_id; only classes go on.
2. Each bucket emits a star from its smallest member to the others, so n members make n - 1 candidates. Centres are
   found by a pre-aggregated minimum, never by gathering a bucket in one task. Of the stars that reach a class, the one
   with the most shared bands is confirmed first: a candidate for each class at most.
3. Candidates are confirmed on the full sets, and connected components found by minimum labels with pointer jumping.
4. Buckets that then still span several components may hide further links. All their members go to an exact join: the
   rarest shingles of each set, as many as any partner must meet, with the places that bound the overlap. It leaves no
   pair of a bucket untested, so the stars decide only in which order links are found.

A pair at the threshold shares no bucket with probability (1 - 0.75^5)^51, about 1e-6, and less above it. The work of
step 4 is (members outside a shingle's largest component) x (its members), in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Texts, batch_of, blocks, column, cut, documents, forget, ints, mix, randoms, runs, small_batches

WORDS = 5
BINS_LOG2 = 8
BAND_ROWS = 5
PERCENT = 75
#: Slots for shingle frequencies, and members of a join key in one block.
SLOTS_LOG2, BLOCK = 20, 1024
_U = np.uint64


def shingle_sets(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their bounds; a text of fewer words is one shingle, one without words none."""
    _, _, doc, h = texts.words()
    sizes = np.bincount(doc, minlength=texts.n)
    factors = randoms(words + 1, 77)
    n = len(h)
    s = np.zeros(n, _U)
    for k in range(min(words, n)):
        s[: n - k] += mix(h[k:] ^ factors[k])[: n - k] * factors[k]
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(n)  # words from here to the text's end
    full = left >= words
    for d in np.flatnonzero((sizes > 0) & (sizes < words)).tolist():
        at = int(ends[d] - sizes[d])
        whole = mix(h[at : ends[d]] ^ factors[: sizes[d]]) * factors[: sizes[d]]
        s[at : at + 1] = whole.sum(keepdims=True) + factors[words : words + 1] * sizes[d : d + 1].astype(_U)
        full[at] = True
    s, doc = mix(s[full]), doc[full]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(texts.n + 1))


def densified(sets: np.ndarray, at: np.ndarray, bins_log2: int = BINS_LOG2) -> np.ndarray:
    """One-permutation signatures, a row for each non-empty set. Each empty bin probes bins in a fixed random order until it meets a full one."""
    k = 1 << bins_log2
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cell = owner * k + (sets >> _U(64 - bins_log2)).astype(np.int64)  # sorted, and the first of a cell is its minimum
    first = runs(cell)[:-1]
    sig, full = np.zeros((len(at) - 1) * k, _U), np.zeros((len(at) - 1) * k, bool)
    sig[cell[first]], full[cell[first]] = sets[first], True
    empty = np.flatnonzero(~full & np.repeat(np.diff(at) > 0, k))
    source, step = np.zeros(len(empty), np.int64), 0
    todo = np.arange(len(empty))
    while len(todo):
        b = empty[todo] % k
        probe = empty[todo] - b + (mix(b.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(step)) >> _U(64 - bins_log2)).astype(np.int64)
        hit = full[probe]
        source[todo[hit]] = probe[hit]
        todo, step = todo[~hit], step + 1
    sig[empty] = sig[source]
    return sig.reshape(-1, k)


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    r = randoms(rows, 5)
    keys = np.zeros((len(sig), bands), _U)
    for k in range(rows):
        keys += mix(sig[:, k : bands * rows : rows]) * r[k]
    return mix(keys + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fa and fb (fingerprint of the set), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in blocks(batches):
            sets, at = shingle_sets(Texts(column(b, "text")))
            n = np.diff(at)
            padded = np.concatenate((sets, [_U(0)]))
            sums = [np.where(n > 0, np.add.reduceat(mix(padded ^ c), at[:-1]), _U(0)).view(np.int64) for c in randoms(2, 99)]
            keys = band_keys(densified(sets, at))
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(n > 0, keys.shape[1], 0)))).astype(np.int32), pa.array(keys[n > 0].reshape(-1)))
            yield batch_of(schema, column(b, "doc_id"), n, *sums, lists)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fa long, fb long, bands array<long>")


def bucket_rows(classes: DataFrame, bits: Bits) -> DataFrame:
    """(key, rep) of the buckets whose keys are in bits, and a few others."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        for b in batches:
            lists = column(b, "bands")
            keys = np.asarray(lists.flatten())
            hit = bits.has(keys)
            yield batch_of(schema, keys[hit], np.repeat(ints(b, "rep"), np.diff(np.asarray(lists.offsets)))[hit])

    return classes.select("rep", "bands").mapInArrow(run, "key long, rep long")


def full_sets(docs: DataFrame, bits: Bits | None = None) -> DataFrame:
    """doc_id, f (hash of the set) and shingles of the documents whose ids are in bits, and a few others. Rows that repeat an id and a set count once."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for whole in batches:
            ids = column(whole, "doc_id")
            wanted = np.asarray(ids.is_valid())
            if bits is not None:
                wanted = wanted & bits.has(np.asarray(ids.fill_null(0)))
            for b in blocks([whole.filter(pa.array(wanted))]):
                sets, at = shingle_sets(Texts(column(b, "text")))
                sums = np.where(np.diff(at) > 0, np.add.reduceat(mix(np.concatenate((sets, [_U(0)]))), at[:-1]), _U(0))
                yield batch_of(schema, column(b, "doc_id"), sums.view(np.int64), [sets[s:e].tobytes() for s, e in zip(at, at[1:])])

    return docs.mapInArrow(run, "doc_id long, f long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union. An id with several sets is linked by any of them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for k, (x, y) in enumerate(zip(column(t, "sa"), column(t, "sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch_of(schema, column(t, "a").filter(pa.array(keep)), column(t, "b").filter(pa.array(keep)))

    return rows.mapInArrow(run, "a long, b long")


def rarity(held: DataFrame) -> np.ndarray:
    """By slot of the shingles' hashes, a class of how many sets hold one; 0 where one component only does, so nothing is brought together."""
    slots = 1 << SLOTS_LOG2

    def frequencies(batches):
        n, low, high = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max), np.full(slots, np.iinfo(np.int64).min)
        for b in batches:
            for component, x in zip(column(b, "component").to_pylist(), column(b, "shingles"), strict=True):
                at = (np.frombuffer(x.as_buffer(), _U) >> _U(64 - SLOTS_LOG2)).astype(np.int64)
                np.add.at(n, at, 1)
                low[at], high[at] = np.minimum(low[at], component), np.maximum(high[at], component)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(low[at]), pa.array(high[at])], ["slot", "n", "low", "high"])

    found = held.mapInArrow(frequencies, "slot int, n long, low long, high long").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    found = found.select("slot", F.least(F.lit(255), F.lit(1) + F.floor(F.log2("n") * 4)).cast("short").alias("c")).toArrow()  # a row for each slot at most
    out = np.zeros(slots, np.uint8)
    out[np.asarray(found["slot"])] = np.asarray(found["c"])
    return out


def shared_prefixes(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a < b, of members (rep, component) of different components: all that are as alike as percent are among them.

    Sets are ordered by rarity. Two sets of n and m shingles that are as alike as percent share least = ceil(percent * (n + m) /
    (100 + percent)) of them, so their first common one stands at places p and q with 1 + min(n - p, m - q) - 1 >= least,
    within the first n - ceil(percent * n / 100) + 1 of either.
    """
    held = cut(sets.join(members.select(F.col("rep").alias("doc_id"), "component"), "doc_id").select("doc_id", "component", "shingles"))
    classes = rarity(held)
    schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("rep", pa.int64()), ("component", pa.int64())])

    def run(batches):
        for t in batches:
            keys, places, sizes = [], [], []
            for x in column(t, "shingles"):
                x = np.frombuffer(x.as_buffer(), _U)
                c, n = classes[(x >> _U(64 - SLOTS_LOG2)).astype(np.int64)], len(x)
                order = np.lexsort((x, c))[: n - -(-percent * n // 100) + 1]
                at = np.flatnonzero(c[order] > 0)
                keys.append(x[order[at]].view(np.int64))
                places.append(at)
                sizes.append(len(at))
            n = np.array([len(x.as_buffer()) // 8 for x in column(t, "shingles")], np.int64)
            if sum(sizes):
                yield batch_of(schema, np.concatenate(keys), np.concatenate(places), np.repeat(n, sizes), np.repeat(ints(t, "doc_id"), sizes), np.repeat(ints(t, "component"), sizes))

    rows = cut(held.mapInArrow(run, "key long, place int, n int, rep long, component long"))
    # a key counts if it brings components together. Its members outside its largest component (rest) meet all its
    # members, in a grid of blocks: a cell joins BLOCK of the one and BLOCK of the other
    own = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    grid = own.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main")).filter(F.col("all") > F.col("main.n"))
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    grid = cut(grid.select("key", F.col("main.component").alias("main"), blocks_of(F.col("all")).alias("across"), blocks_of(F.col("all") - F.col("main.n")).alias("down")))
    dealt = rows.join(grid, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = dealt.filter("component <> main").withColumn("i", salt("down")).withColumn("j", every("across")).alias("l")
    right = dealt.withColumn("j", salt("across")).withColumn("i", every("down")).alias("r")
    n, m = F.col("l.n").cast("long"), F.col("r.n").cast("long")
    least = F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    fits = (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep"))) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - F.col("l.place"), m - F.col("r.place")) >= least)
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
    return left.join(right, [*on, fits]).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b): the smallest id reachable. A round takes the least of a vertex's label, its neighbours' and its label's label.

    What the joins of a round read was cut before, so that Spark can split the task of a vertex or label that many rows share.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    none = F.lit(None).cast("long")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        of = labels.select(F.col("a").alias("b"), F.col("label").alias("to"))
        near = both.join(of, "b").select("a", "to", none.alias("was"))
        far = labels.withColumnRenamed("label", "b").join(of, "b").select("a", "to", none.alias("was"))
        moved = cut(near.unionByName(far).unionByName(labels.select("a", F.col("label").alias("to"), F.col("label").alias("was"))).groupBy("a").agg(F.min("to").alias("label"), F.max("was").alias("was")))
        forget(labels)
        labels = moved.select("a", "label")
        if moved.filter("label < was").isEmpty():
            forget(both)
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and link with nothing. Rows that share a doc_id are one document: they are
    linked, by whatever any of their texts links with, and each has its row. A null doc_id links with nothing and is kept.
    Very long texts are compared whole, by all their shingles. Equal texts share a group, whose smallest doc_id is kept; no other tie arises. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sig = cut(signatures(docs))
    real = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(real.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    rows = classes.select("rep", F.explode("bands").alias("key"))
    stars = cut(rows.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    members = cut(bucket_rows(classes, Bits.of(stars, "key")).join(stars, "key").select("key", "rep", "centre"))
    reps = cut(sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n_shingles", "fa", "fb").join(classes.select("fa", "fb", "rep"), ["fa", "fb"]).select("doc_id", "n_shingles", "rep"))
    alone = sig.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    forget(classes, stars)

    repeated = reps.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc_id")
    links = reps.join(repeated, "doc_id").filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = members.filter("rep > centre").groupBy("rep", "centre").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("best"))
    pairs = cut(stars.select((-F.col("best.c")).alias("a"), F.col("rep").alias("b")))
    label = None
    if not pairs.isEmpty():
        ids = members.select(F.col("rep").alias("doc_id")).distinct()
        texts = full_sets(docs, Bits.of(ids, "doc_id")).join(ids, "doc_id", "left_semi")
        sets = cut(texts.groupBy("doc_id", "f").agg(F.first("shingles").alias("shingles")).drop("f"))
        links = cut(links.unionByName(confirmed(pairs, sets, percent)))
        label = components(links)
        seen = members.select("key", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        split = cut(seen.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"))
        left = cut(seen.join(split, "key").select("rep", "component").distinct())
        if not left.isEmpty():
            found = cut(confirmed(shared_prefixes(left, sets, percent), sets, percent))
            if not found.isEmpty():
                label = components(links.unionByName(found))
        forget(split, left, sets)
    elif not links.isEmpty():
        label = components(links)
    forget(members, pairs)
    out = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left") if label is not None else reps.withColumn("component", F.lit(None).cast("long"))
    linked = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
