"""Phrase collocations by pattern growth over contiguous words.

A pass over the texts counts the words of each language; words below the least count part the pieces. A second pass projects
every place onto its prefix of two words: the pointer is the window of up to four words that starts there, equal windows of a
block of text as one with a count. Windows are dealt by prefix, packed in blobs. A task sorts its windows, so every prefix
is a range of them, and grows each frequent prefix to the right, depth first: the runs of the next word within the range are its
children. Counts of all parts of a phrase come from joins of the frequent phrases with themselves.

Prefixes that may hold more than a quarter of a task's windows (by a sketch of BUCKETS sums over all places, which never
underestimates) are dealt by the whole window instead; their tasks emit partial counts, which Spark adds. The sketch has a
fixed size: with many more places than it can tell apart all prefixes are dealt so, which changes the volume but no result.

Words are told apart by 62 bits of a hash of language and word; the most frequent ones (COMMON at most) travel as small numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bits, Texts, batch_of, blocks, column, cut, documents, forget, ints, join_hot, mix, small_batches, width

LEAST, LONGEST, TOP = 30, 4, 2000
#: Of 100 occurrences of a phrase, so many in one longer phrase make it a part of that.
COVERED = 80
SCALE = 2_000_000
#: Windows of a task, words with a small code, sums of the sketch, bytes of text in a block.
SHARD, COMMON, BUCKETS, BLOCK = 1_500_000, 1 << 18, 1 << 17, 6 << 20
#: Shards up to which windows are dealt in one step.
ONE_STEP = 4096
#: Parts that a language's candidates are ranked in first.
RANK_PARTS = 256

_U = np.uint64
_HARD = np.zeros(256, bool)  # parts pieces
_HARD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _HARD.copy()
_APART[[0x20, 0x09]] = True


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(_U) * _U(0x9E3779B97F4A7C15) + mix(b.astype(_U)))


class Words:
    """The words of a block: ids (by language), and whether the next word follows in the same piece."""

    def __init__(self, batch):
        self.texts = Texts(column(batch, "text"))
        self.starts, self.lengths, self.doc, h = self.texts.words(apart=_APART)
        g = ints(batch, "g").view(_U)[self.doc]
        self.ids = ((mix(h ^ mix(g)) >> _U(2)) | _U(1 << 62)).astype(np.int64)
        hard = np.cumsum(_HARD[self.texts.data], dtype=np.int64)[self.starts] if len(self.starts) else self.starts
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[:-1] = (hard[1:] == hard[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.g = g.view(np.int64)


COUNTS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_WORD, _TOKENS, _PLACES = 0, 1, 2


def _counts(buckets: int, block: int):
    """Words (kind 0: id, language), tokens of each language (1) and places by the bucket of their first two words (2)."""

    def count(batches):
        sketch = np.zeros(buckets, np.int64)
        rows = lambda kind, a, b, n: batch_of(COUNTS, np.full(len(a), kind), a, b, n)
        for b in blocks(batches, block):
            w = Words(b)
            if not len(w.ids):
                continue
            ids, first, n = np.unique(w.ids, return_index=True, return_counts=True)
            yield rows(_WORD, ids, w.g[first], n)
            g, n = np.unique(w.g, return_counts=True)
            yield rows(_TOKENS, g, np.zeros(len(g), np.int64), n)
            two = np.flatnonzero(w.follows)
            sketch += np.bincount((_pair(w.ids[two], w.ids[two + 1]) % _U(buckets)).astype(np.int64), minlength=buckets)
        used = np.flatnonzero(sketch)
        if len(used):
            yield rows(_PLACES, used, np.zeros(len(used), np.int64), sketch[used])

    return count


def pack(columns: np.ndarray) -> bytes:
    """Rows of 64-bit numbers, by planes of equal bytes, compressed."""
    planes = np.ascontiguousarray(columns, np.int64).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(blob, decompressed_size=(LONGEST + 1) * n * 8, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(LONGEST + 1, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(LONGEST + 1, n)


def _ordered(w: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Order of windows by their words, or by `first` before that. Words are ranked densely, so that two fit one key."""
    dense = np.unique(w, return_inverse=True)[1].reshape(w.shape)
    size = int(dense.max(initial=0)) + 1
    low = dense[2] * size + dense[3]
    high = dense[0] * size + dense[1]
    return np.lexsort((low, high) if first is None else (low, high, first))


BLOBS = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])


def _blobs(w: np.ndarray, n: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A blob for each shard; equal windows are added."""
    order = _ordered(w, shard)
    w, n, shard = w[:, order], n[order], shard[order]
    new = np.ones(len(n), bool)
    new[1:] = (w[:, 1:] != w[:, :-1]).any(axis=0) | (shard[1:] != shard[:-1])
    first = np.flatnonzero(new)
    rows = np.vstack([w[:, first], np.add.reduceat(n, first)])
    shard = shard[first]
    bounds = [*np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(shard)]
    return batch_of(BLOBS, shard[bounds[:-1]], np.diff(bounds), [pack(rows[:, s:e]) for s, e in zip(bounds, bounds[1:])])


class Dealer:
    """Which shard a window goes to, and which words take part; the same on all machines."""

    def __init__(self, common: np.ndarray, frequent: Bits, hot: np.ndarray, shards: int):
        self.common, self.sorted, self.frequent, self.hot, self.shards = common, np.argsort(common), frequent, hot, shards

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of ids: 1 to COMMON for common ones, 0 for those that can't be frequent, else the id."""
        own = self.common[self.sorted]
        at = np.minimum(np.searchsorted(own, ids), max(len(own) - 1, 0))
        known = own[at] == ids if len(own) else np.zeros(len(ids), bool)
        return np.where(known, self.sorted[at] + 1 if len(own) else 0, np.where(self.frequent.has(ids), ids, 0))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        small = (codes > 0) & (codes <= len(self.common))
        return np.where(small, self.common[np.where(small, codes - 1, 0)] if len(self.common) else 0, codes)

    def split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows of codes: their pair's hash, and whether it is dealt by the whole window."""
        pair = _pair(self.ids(w[0]), self.ids(w[1]))
        return pair, self.hot[(pair % _U(len(self.hot))).astype(np.int64)]

    def shard(self, w: np.ndarray) -> np.ndarray:
        pair, hot = self.split(w)
        return (np.where(hot, mix(_pair(w[2], w[3]) ^ pair), mix(pair)) % _U(self.shards)).astype(np.int64)


def _windows(dealer: Dealer, block: int):
    def project(batches):
        for b in blocks(batches, block):
            words = Words(b)
            if not len(words.ids):
                continue
            ids, own = np.unique(words.ids, return_inverse=True)
            code = dealer.codes(ids)[own]
            link = words.follows & (code > 0)
            link[:-1] &= code[1:] > 0
            at = np.flatnonzero(link)
            if not len(at):
                continue
            code, link = np.concatenate((code, [0] * LONGEST)), np.concatenate((link, [False] * LONGEST))
            w, on = [code[at]], np.ones(len(at), bool)
            for j in range(1, LONGEST):
                on = on & link[at + j - 1]
                w.append(np.where(on, code[at + j], 0))
            w = np.array(w)
            yield _blobs(w, np.ones(len(at), np.int64), dealer.shard(w))

    return project


def _regroup(dealer: Dealer, most: int):
    """The second step of a deal in two: windows of a group of shards, gathered over many blocks of text and dealt to their own shards."""

    def regroup(batches):
        held, size = [], 0
        flush = lambda: _blobs(*(lambda r: (r[:LONGEST], r[LONGEST], dealer.shard(r[:LONGEST])))(np.concatenate(held, axis=1)))
        for b in batches:
            for n, blob in zip(ints(b, "n").tolist(), column(b, "blob").to_pylist(), strict=True):
                held.append(unpack(blob, n))
                size += n
                if size >= most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return regroup


PHRASES = pa.schema([(f"w{j}", pa.int64()) for j in range(1, LONGEST + 1)] + [("a", pa.int64())])


def _grow(dealer: Dealer, least: int):
    """Grows the prefixes of a shard; phrases of two words and more with their counts, partial ones where the prefix is dealt by the whole window."""

    def grow(table: pa.Table) -> pa.Table:
        parts = [unpack(blob, n) for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        rows = np.concatenate(parts, axis=1)
        del parts
        rows = rows[:, _ordered(rows[:LONGEST])]
        w, total = rows[:LONGEST], np.concatenate(([0], np.cumsum(rows[LONGEST])))
        heads, new = {}, np.zeros(w.shape[1], bool)
        new[0] = True
        for j in range(LONGEST):
            new[1:] |= w[j, 1:] != w[j, :-1]
            heads[j + 1] = np.flatnonzero(new)
        found: dict[int, list] = {depth: [] for depth in range(2, LONGEST + 1)}

        def runs(depth: int, lo: int, hi: int):
            """Runs of the phrases of `depth` words in a range: first and last windows, counts."""
            i, j = np.searchsorted(heads[depth], (lo, hi))
            start = heads[depth][i:j]
            stop = np.append(start[1:], hi)
            there = w[depth - 1, start] > 0
            return start[there], stop[there], (total[stop] - total[start])[there]

        def extend(depth: int, lo: int, hi: int):
            start, stop, n = runs(depth, lo, hi)
            often = n >= least
            if not often.any():
                return
            found[depth].append((start[often], n[often]))
            if depth < LONGEST:
                for s, e in zip(start[often].tolist(), stop[often].tolist()):
                    extend(depth + 1, s, e)

        start, stop, n = runs(2, 0, w.shape[1])
        hot = dealer.split(w[:, start])[1]
        often = (n >= least) & ~hot
        found[2].append((start[often | hot], n[often | hot]))
        for s, e in zip(start[often].tolist(), stop[often].tolist()):
            extend(3, s, e)
        for s, e in zip(start[hot].tolist(), stop[hot].tolist()):  # partial: nothing can be left out before the whole window
            for depth in range(3, LONGEST + 1):
                first, _, k = runs(depth, s, e)
                keep = k >= (least if depth == LONGEST else 1)
                found[depth].append((first[keep], k[keep]))
        out = []
        for depth, each in found.items():
            at = np.concatenate([s for s, _ in each]) if each else np.zeros(0, np.int64)
            n = np.concatenate([k for _, k in each]) if each else at
            own = np.where(np.arange(LONGEST)[:, None] < depth, dealer.ids(w[:, at]), 0)
            out.append(np.vstack([own, n]))
        out = np.concatenate(out, axis=1)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=PHRASES)

    return grow


def _named(wanted: Bits, block: int):
    """Spellings of words whose ids pass the bit map."""

    def name(batches):
        for b in blocks(batches, block):
            w = Words(b)
            ids, first = np.unique(w.ids, return_index=True)
            near = wanted.has(ids) if len(ids) else np.zeros(0, bool)
            spell = lambda k: w.texts.data[w.starts[k] : w.starts[k] + w.lengths[k]].tobytes().lower().decode()
            yield pa.RecordBatch.from_arrays([pa.array(ids[near], pa.int64()), pa.array([spell(k) for k in first[near]], pa.string())], ["id", "word"])

    return name


W = [f"w{j}" for j in range(1, LONGEST + 1)]


def frequent_phrases(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts: g (hash of the language), text. Returns phrases (w1 to w4, 0 past the end; a) of two words and more, words (id, g, f), tokens (g, n)."""
    spark = texts.sparkSession
    counts = texts.mapInArrow(_counts(BUCKETS, BLOCK), "kind int, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter((F.col("kind") != _WORD) | (F.col("n") >= least)))
    words = counts.filter(F.col("kind") == _WORD).select(F.col("a").alias("id"), F.col("b").alias("g"), F.col("n").alias("f"))
    tokens = counts.filter(F.col("kind") == _TOKENS).select(F.col("a").alias("g"), "n")
    # the most frequent words, by a least count: classes of counts, some 500 at most
    classes = words.groupBy(F.floor(F.log2(F.col("f").cast("double")) * 8).alias("c")).agg(F.count("*").alias("n"), F.min("f").alias("f")).orderBy(F.desc("c")).collect()
    room, floor = COMMON, None
    for r in classes:
        room -= r.n
        if room < 0:
            break
        floor = r.f
    common = np.array([r.id for r in words.filter(F.col("f") >= floor).collect()] if floor else [], np.int64)  # COMMON at most
    common = np.sort(common)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(width(spark), -(-total // SHARD))
    hot = np.zeros(BUCKETS, bool)
    for r in counts.filter((F.col("kind") == _PLACES) & (F.col("n") > max(1, -(-total // shards)) / 4)).select("a").collect():  # BUCKETS at most
        hot[r.a] = True
    dealer = Dealer(common, Bits.of(words, "id"), hot, shards)
    blobs = texts.mapInArrow(_windows(dealer, BLOCK), "shard long, n long, blob binary")
    if shards > ONE_STEP:
        group = F.floor(F.col("shard") / int(shards**0.5))
        blobs = blobs.repartition(int(shards**0.5) + 1, group).mapInArrow(_regroup(dealer, SHARD), "shard long, n long, blob binary")
    mined = blobs.groupBy("shard").applyInArrow(_grow(dealer, least), ", ".join(f"{c} long" for c in [*W, "a"]))
    phrases = cut(mined.groupBy(*W).agg(F.sum("a").alias("a")).filter(F.col("a") >= least))
    return phrases, words, tokens


def scored_phrases(phrases: DataFrame, words: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases that no longer one covers, with g, the lowest-scoring cut's l, r and score."""
    key = ["x", "y", "z"]
    zero, w = F.lit(0).cast("long"), [F.col(c) for c in W]
    counts = phrases.filter("w4 = 0").select(w[0].alias("x"), w[1].alias("y"), w[2].alias("z"), F.col("a").alias("f"), F.lit(None).cast("long").alias("g"))
    counts = counts.unionByName(words.select(F.col("id").alias("x"), zero.alias("y"), zero.alias("z"), "f", "g"))
    part = lambda k, side, *own: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *[(own[j] if j < len(own) else zero).alias(c) for j, c in enumerate(key)])
    cuts = lambda n: F.array(*[part(k, side, *own) for k in range(1, n) for side, own in ((0, w[:k]), (1, w[k:n]))])
    each = phrases.select(*W, "a", F.explode(F.when(F.col("w3") == 0, cuts(2)).when(F.col("w4") == 0, cuts(3)).otherwise(cuts(4))).alias("p"))
    each = cut(each.select(*W, "a", "p.*", F.xxhash64(*W).alias("by")))
    looked = join_hot(each, counts, key, by="by")
    of = lambda k, side, c: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col(c)))
    wide = looked.groupBy(*W, "a").agg(of(1, 0, "g").alias("g"), *[of(k, s, "f").alias(f"f{k}{s}") for k in range(1, LONGEST) for s in (0, 1)])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    score = lambda k: F.expr(f"CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(7,0)) div (CAST(f{k}0 AS DECIMAL(20,0)) + CAST(f{k}1 AS DECIMAL(20,0)))")
    lowest = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")) for k in range(1, LONGEST)]), lambda s: s.score.isNotNull()))
    wide = wide.select(*W, "a", "g", lowest.alias("s")).select(*W, "a", "g", "s.score", "s.l", "s.r")
    longer = phrases.filter("w3 > 0").select("a", F.explode(F.array(F.struct(w[1].alias("x"), w[2].alias("y"), w[3].alias("z")), F.struct(w[0].alias("x"), w[1].alias("y"), F.when(F.col("w4") > 0, w[2]).otherwise(zero).alias("z")))).alias("p"))
    longer = longer.groupBy("p.x", "p.y", "p.z").agg(F.max("a").alias("most")).select(F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("z").alias("w3"), zero.alias("w4"), "most")
    return wide.join(longer, W, "left").filter(F.col("most").isNull() | (big("most") * 100 < big("a") * covered)).drop("most")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to four words by score, count and phrase.

    Null texts are empty, a null language is `und`. Phrases don't cross the ends of texts or pieces. Long texts are read whole, repeated rows count each
    time. Scores that tie go to the larger count, then to the phrase first by its bytes; cuts that tie to the shorter first part. Tables
    without a frequent phrase, empty ones too, give an empty result; other columns, whatever their names, are left alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    texts = docs.select(F.xxhash64(lang).alias("g"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    phrases, words, tokens = frequent_phrases(texts, least)
    ranked = scored_phrases(phrases, words, covered).withColumn("deal", F.pmod(F.xxhash64(*W), F.lit(RANK_PARTS)))
    for by in (["g", "deal"], ["g"]):
        ranked = ranked.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= top)
    ranked = cut(ranked.select(*W, "a", "l", "r", "g", "score"))
    forget(phrases)
    each = ranked.select(*W, F.posexplode(F.array(*W)).alias("at", "id")).filter("id > 0")
    needed = cut(each.select("id").distinct())
    spelled = texts.mapInArrow(_named(Bits.of(needed, "id"), BLOCK), "id long, word string").groupBy("id").agg(F.min("word").alias("word"))
    spelled = each.join(spelled, "id").groupBy(*W).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s.word), " ").alias("phrase"))
    langs = docs.select(lang.alias("lang")).distinct().select(F.xxhash64("lang").alias("g"), "lang")
    out = ranked.join(spelled, W).join(tokens, "g").join(langs, "g")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return mine_collocations(documents(spark, sf_dir))
