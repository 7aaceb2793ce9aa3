"""Language-model scoring with sharded Elias-Fano n-gram tries.

Model. A trigram mixture whose numerator and denominator are linear in the counts, hence a true distribution:

    p(w | u v) = (c(uvw) + A c(vw) + (MU / Z) (c(w) + 0.1)) / (c(uv) + A c(v) + MU),   Z = N + 0.1 (V + 1)

The last term of the numerator is MU times the smoothed unigram probability. Texts are padded with two starts.
All counts that a predicted word w needs, and those that it needs as the context of its successor, belong to w's
own branch of a reversed trie w -> v -> u. So the corpus is dealt by w: a shard sums the counts of its words,
builds one trie and scores all positions that end in its words; only sums per document leave it.

Trie. Each level holds the ids of the children relative to their parent's range as one monotone Elias-Fano
sequence, monotone Elias-Fano pointers to the next level, and quantised log probabilities: of the level as the
longest match, and of the level as a context. A shard writes its trie to a file of its own and scores through a memory
map of it. Lookups come in sorted order, so a chunk of them decodes only the range of the bits that it touches.

Scale. A position travels to its shard as three word codes (of the COMMON most frequent words, a table of bounded size;
others as hashes) and its document's place in its block of text, some seven bytes; back come sums per document. A
word with over a quarter of a shard's fair share of the tokens is dealt by (w, v), such a pair by (w, v, u), and such
a trigram by block. At most four of each a shard are so frequent; only their counts are broadcast. The number of
shards grows with the tokens. Predicted words are told apart by 64-bit hashes, contexts by 48 bits of theirs.
"""

from __future__ import annotations

import functools
import mmap
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch_of, blocks, column, crc_mod, documents, mix, runs, small_batches, width

A, MU = 0.02, 4.0
ALPHA = 0.1
#: Tokens of a shard.
SHARD_TOKENS = 1_500_000
#: Contexts are told apart by so many bits of their hash, predicted words by all 64.
CONTEXT_BITS = 48
BITS = 16
#: Words that have a code of their own; bytes of text in one block.
COMMON, BLOCK = 1 << 18, 6 << 20
_START, _END = np.uint64(1), np.uint64(2)
_U = np.uint64
_CONTEXT = np.uint64((1 << CONTEXT_BITS) - 1)


# ---- Elias-Fano


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Fixed-width fields in 64-bit words, with one spare word."""
    out = np.zeros(len(values) * bits // 64 + 2, _U)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + _U(bits) > _U(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), _U)
    at = index * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return ((words[word] >> shift) | high) & _U((1 << bits) - 1)


class EliasFano:
    """A non-decreasing sequence: low bits as fixed fields, high parts as gaps in unary."""

    def __init__(self, n, low_bits, low, unary):
        self.n, self.low_bits, self.low, self.unary = n, low_bits, low, unary
        # ones before every STRIDE-th word: where to start decoding
        ones = np.bitwise_count(unary).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))[:: self.STRIDE].copy()

    STRIDE = 64

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> _U(bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) + n if n else 0) // 64 + 2, _U)
        at = high + np.arange(n)
        np.bitwise_or.at(unary, at >> 6, _U(1) << (at & 63).astype(_U))
        return cls(n, bits, _pack(values & _U((1 << bits) - 1), bits), unary)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th one or zero. Decodes the words between the least and the largest k only."""
        if not len(k):
            return k
        words = np.arange(len(self.before), dtype=np.int64) * self.STRIDE
        before = self.before if ones else words * 64 - self.before
        first = max(int(np.searchsorted(before, int(k.min()), "right")) - 1, 0)
        last = int(np.searchsorted(before, int(k.max()), "right"))
        part = self.unary[int(words[first]) : last * self.STRIDE]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little")
        at = np.flatnonzero(bits if ones else bits == 0)
        return at[k - before[first]] + int(words[first]) * 64

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        k = np.asarray(k, np.int64)
        return ((self._select(k, True) - k).astype(_U) << _U(self.low_bits)) | _unpack(self.low, k, self.low_bits)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value not below x (n if there is none)."""
        x = np.asarray(x, _U)
        high = (x >> _U(self.low_bits)).astype(np.int64)
        most = len(self.unary) * 64 - self.n - 1
        lo = np.where(high > 0, self._select(np.clip(high - 1, 0, most), False) - high + 1, 0)
        hi = self._select(np.clip(high, 0, most), False) - high
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        lo[high > most], hi[high > most] = self.n, self.n
        low = x & _U((1 << self.low_bits) - 1)
        while (todo := np.flatnonzero(lo < hi)).size:  # binary search in the bucket of equal high parts
            mid = (lo[todo] + hi[todo]) >> 1
            less = _unpack(self.low, mid, self.low_bits) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        return lo

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.unary]

    @classmethod
    def from_parts(cls, head, low, unary) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low.view(_U), unary.view(_U))


class Quantiser:
    """Equal steps over the values' range, 2**bits of them."""

    def __init__(self, low: float, step: float):
        self.low, self.step = low, step

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> tuple[Quantiser, np.ndarray]:
        low = float(values.min()) if len(values) else 0.0
        step = ((float(values.max()) - low) if len(values) else 0.0) / (2**bits - 1) or 1.0
        return cls(low, step), np.rint((values - low) / step).astype(np.uint16 if bits > 8 else np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step


class Level:
    """Children ids (relative to the parent's range), pointers to their own children, and two quantised values each."""

    def __init__(self, ids, pointers, quantisers, codes):
        self.ids, self.pointers, self.quantisers, self.codes = ids, pointers, quantisers, codes

    @classmethod
    def build(cls, parent: np.ndarray, key: np.ndarray, parents: int, children: np.ndarray | None, values: list[np.ndarray], bits: int) -> Level:
        """parent, key: sorted by both. Each range continues from the last value of the range before it."""
        key = key.astype(_U)
        bounds = runs(parent)
        tops = np.zeros(len(bounds) - 1, _U)
        if len(parent):
            tops = np.cumsum(key[bounds[1:] - 1] + _U(1), dtype=_U)
        base = np.concatenate((np.zeros(1, _U), tops[:-1])) if len(tops) else tops
        ids = EliasFano.of(key + np.repeat(base, np.diff(bounds)))
        own = [Quantiser.of(v, bits) for v in values]
        pointers = EliasFano.of(np.concatenate(([0], np.cumsum(children)))) if children is not None else None
        return cls(ids, pointers, [q for q, _ in own], [c for _, c in own])

    def find(self, begin: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Index of key within [begin, end), by successor search relative to the context's range; -1 if it isn't there."""
        if not self.ids.n:
            return np.full(len(key), -1, np.int64)
        base = np.where(begin > 0, self.ids[np.maximum(begin - 1, 0)] + _U(1), _U(0))
        at = self.ids.successor(base + key.astype(_U))
        inside = (at < end) & (at >= begin)
        hit = inside & (self.ids[np.where(inside, at, 0)] == base + key.astype(_U))
        return np.where(hit, at, -1)

    def value(self, which: int, index: np.ndarray) -> np.ndarray:
        return self.quantisers[which](self.codes[which][index])


def _in_order(w: np.ndarray, v: np.ndarray, u: np.ndarray) -> bool:
    """Whether rows ascend by w, then v, then u."""
    up = u[1:] >= u[:-1]
    for x in (v, w):
        up = (x[1:] > x[:-1]) | ((x[1:] == x[:-1]) & up)
    return bool(up.all())


class Trie:
    """Reversed trigram trie: words, their predecessors, and theirs. Words are keyed by 64-bit hashes through a sorted vocabulary."""

    def __init__(self, vocabulary: EliasFano, words: Level, pairs: Level, triples: Level):
        self.vocabulary, self.levels = vocabulary, [words, pairs, triples]

    @classmethod
    def build(cls, w, v, u, count, hot: tuple[Hot, Hot], scale: float, a: float = A, mu: float = MU, bits: int = BITS) -> Trie:
        """w, v, u: hashes, with the training counts; rows distinct. hot: counts of split words and pairs. scale: MU / Z."""
        words = np.unique(np.concatenate((w, v, u)))
        w, v, u = (np.searchsorted(words, x) for x in (w, v, u))
        if not _in_order(w, v, u):
            order = np.lexsort((u, v, w))
            w, v, u, count = w[order], v[order], u[order], count[order]
        return cls.of_ranks(words, w, v, u, count, hot, scale, a, mu, bits)

    @classmethod
    def of_ranks(cls, words, w, v, u, count, hot: tuple[Hot, Hot], scale: float, a: float = A, mu: float = MU, bits: int = BITS) -> Trie:
        """As build(), of places in the sorted hashes `words`, in ascending order."""
        keep = count > 0
        w, v, u, count = w[keep], v[keep], u[keep], count[keep]
        used = np.zeros(len(words), bool)
        for x in (w, v, u):
            used[x] = True
        place = np.cumsum(used) - 1
        words, w, v, u = words[used], place[w], place[v], place[u]
        pair_at = runs(w.astype(_U) << _U(32) | v.astype(_U)) if len(w) else runs(w)
        pw, pv = w[pair_at[:-1]], v[pair_at[:-1]]
        pair_count = np.add.reduceat(count, pair_at[:-1]) if len(w) else count
        word_at = runs(pw)
        ww = pw[word_at[:-1]]
        word_count = np.add.reduceat(pair_count, word_at[:-1]) if len(pw) else pair_count
        word_count = hot[0].of(words[ww], word_count)
        pair_count = hot[1].of(pair_key(words[pw], words[pv]), pair_count)
        floor = scale * (word_count + ALPHA)  # MU times the unigram probability
        of_word = np.repeat(np.arange(len(ww)), np.diff(word_at))
        of_pair = np.repeat(np.arange(len(pw)), np.diff(pair_at))
        back = floor[of_word] + a * pair_count
        log = np.log10
        one = Level.build(np.zeros(len(ww), np.int64), ww, 1, np.diff(word_at), [log(floor), log(a * word_count + mu), log(word_count + ALPHA)], bits)
        two = Level.build(of_word, pv, len(ww), np.diff(pair_at), [log(back), log(pair_count + a * word_count[of_word] + mu)], bits)
        three = Level.build(of_pair, u, len(pw), None, [log(back[of_pair] + count)], bits)
        one.exact = word_count
        return cls(EliasFano.of(words), one, two, three)

    def index(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary, -1 for unknown ones."""
        at = self.vocabulary.successor(h)
        ok = at < self.vocabulary.n
        ok[ok] = self.vocabulary[at[ok]] == h[ok]
        return np.where(ok, at, -1)

    def lookup(self, w, v, u, scale: float, hot: tuple[Hot, Hot], mu: float = MU, a: float = A, places: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each trigram: log10 of the numerator, log10 of the denominator of contexts that end in (v, w), and the count of w.

        hot: counts of words and pairs dealt over several shards, for those whose training rows are elsewhere. places: index() of w, v and u, if known.
        """
        one, two, three = self.levels
        n, no = len(w), np.full(len(w), -1, np.int64)
        at = runs(w)  # equal words mostly stand together
        wi, vi, ui = places or (np.repeat(self.index(w[at[:-1]]), np.diff(at)), self.index(v), self.index(u))
        k1, k2, k3 = no.copy(), no.copy(), no.copy()
        own = wi[at[:-1]]
        k1 = np.where(own >= 0, one.find(np.zeros(len(own), np.int64), np.full(len(own), one.ids.n), np.maximum(own, 0)), -1)
        k1 = np.repeat(k1, np.diff(at))
        s = np.flatnonzero((k1 >= 0) & (vi >= 0))
        k2[s] = two.find(one.pointers[k1[s]].astype(np.int64), one.pointers[k1[s] + 1].astype(np.int64), vi[s])
        s = np.flatnonzero((k2 >= 0) & (ui >= 0))
        k3[s] = three.find(two.pointers[k2[s]].astype(np.int64), two.pointers[k2[s] + 1].astype(np.int64), ui[s])
        count = np.where(k1 >= 0, one.exact[k1], 0) if one.ids.n else np.zeros(n, np.int64)
        num = np.where(k1 >= 0, one.value(0, k1), np.log10(scale * ALPHA)) if one.ids.n else np.full(n, np.log10(scale * ALPHA))
        den = np.where(k1 >= 0, one.value(1, k1), np.log10(mu)) if one.ids.n else np.full(n, np.log10(mu))
        lost = np.flatnonzero(k1 < 0)
        if len(hot[0].keys) and len(lost):
            c = hot[0].of(w[lost], np.zeros(len(lost), np.int64))
            count[lost], num[lost], den[lost] = c, np.log10(scale * (c + ALPHA)), np.log10(a * c + mu)
        s = np.flatnonzero(k2 >= 0)
        num[s], den[s] = two.value(0, k2[s]), two.value(1, k2[s])
        lost = np.flatnonzero(k2 < 0)
        if len(hot[1].keys) and len(lost):
            c = hot[1].of(pair_key(w[lost], v[lost]), np.zeros(len(lost), np.int64))
            lost, c = lost[c > 0], c[c > 0]
            num[lost], den[lost] = np.log10(scale * (count[lost] + ALPHA) + a * c), np.log10(c + a * count[lost] + mu)
        s = np.flatnonzero(k3 >= 0)
        num[s] = three.value(0, k3[s])
        return num, den, count

    # ---- one buffer

    def to_bytes(self) -> bytes:
        parts = self.vocabulary.parts()
        for x in self.levels:
            parts += x.ids.parts() + (x.pointers.parts() if x.pointers else [])
            parts += [np.array([y for q in x.quantisers for y in (q.low, q.step)])] + x.codes
        parts.append(self.levels[0].exact)
        pad = [p.tobytes() + bytes(-p.nbytes % 8) for p in parts]
        kinds = "".join({"i8": "i", "u8": "u", "f8": "f", "u2": "h", "u1": "b"}[p.dtype.str[1:]] for p in parts)
        return struct.pack("<q", len(parts)) + b"".join(struct.pack("<cxxxxxxxq", k.encode(), p.size) for k, p in zip(kinds, parts, strict=True)) + b"".join(pad)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Views into the buffer: bytes, or a memory map of a file that to_bytes() filled."""
        buffer = memoryview(buffer)
        (n,), at = struct.unpack_from("<q", buffer), 8 + 0
        heads = [struct.unpack_from("<cxxxxxxxq", buffer, 8 + 16 * k) for k in range(n)]
        at, parts = 8 + 16 * n, []
        for kind, size in heads:
            p = np.frombuffer(buffer, {b"i": np.int64, b"u": _U, b"f": np.float64, b"h": np.uint16, b"b": np.uint8}[kind], size, at)
            parts.append(p)
            at += -(-p.nbytes // 8) * 8
        take = iter(parts)
        ef = lambda: EliasFano.from_parts(*(next(take) for _ in range(3)))
        vocabulary, levels = ef(), []
        for k, values in enumerate((3, 2, 1)):
            ids, pointers = ef(), ef() if k < 2 else None
            q = next(take)
            levels.append(Level(ids, pointers, [Quantiser(q[2 * j], q[2 * j + 1]) for j in range(values)], [next(take) for _ in range(values)]))
        levels[0].exact = next(take)
        return cls(vocabulary, *levels)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def map(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


# ---- the corpus


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w, v, u, doc) of every token, each text ended by the end token and padded with starts."""
    _, _, doc, h = texts.words()
    sizes = np.bincount(doc, minlength=texts.n) + 1
    ends = np.cumsum(sizes)
    w = np.full(int(ends[-1]) if texts.n else 0, _END, _U)
    of = np.repeat(np.arange(texts.n), sizes)
    inner = np.ones(len(w), bool)
    inner[ends - 1] = False
    w[inner] = h
    v, u = np.full(len(w), _START, _U), np.full(len(w), _START, _U)
    v[1:] = np.where(of[1:] == of[:-1], w[:-1], _START)
    if len(w) > 2:
        u[2:] = np.where(of[2:] == of[:-2], w[:-2], _START)
    return w, v, u, of


def _deal(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ _U(0x5DEECE66D)) % _U(n)).astype(np.int32)


def pair_key(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(mix(w) ^ (v & _CONTEXT))


def triple_key(w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(mix(pair_key(w, v)) ^ (u & _CONTEXT) ^ _U(0x9E3779B97F4A7C15))


class Hot:
    """Counts of the n-grams of one order that are dealt over several shards, by their keys (sorted)."""

    def __init__(self, keys=(), counts=()):
        keys, counts = np.array(keys, _U), np.array(counts, np.int64)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def of(self, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        at = self.find(keys)
        return np.where(at >= 0, self.counts[at], other) if len(self.counts) else other


def _counts(rows: DataFrame, parts: int, order: int, hot: Hot, floor: int, common: int = 0) -> dict:
    """Training counts of n-grams whose suffix (of one word less) is hot: tokens n, distinct ones v, training texts, the n-grams
    that count floor or more (with floor 0: over a sixteenth of a part's tokens), and the `common` most frequent ones. Blocks are summed before they are dealt.
    """
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.int64())])

    def count(batches):
        for b in blocks(batches, BLOCK):
            w, v, u, _ = _tokens(Texts(column(b, "text")))
            if order > 1:
                own = np.flatnonzero(hot.find(w if order == 2 else pair_key(w, v)) >= 0)
                w = pair_key(w[own], v[own]) if order == 2 else triple_key(w[own], v[own], u[own])
            keys, n = np.unique(w, return_counts=True)
            part = _deal(keys, parts)
            by = np.argsort(part, kind="stable")
            keys, n, part = keys[by], n[by].astype(np.uint32), part[by]
            at = runs(part)
            if len(keys):
                yield batch_of(schema, part[at[:-1]], [keys[s:e].tobytes() for s, e in zip(at, at[1:])], [_planes(n[s:e]) for s, e in zip(at, at[1:])], [b.num_rows] + [0] * (len(at) - 2))

    out = pa.schema([("n", pa.int64()), ("v", pa.int64()), ("docs", pa.int64()), ("hot", pa.binary()), ("hot_n", pa.binary()), ("common", pa.binary())])

    def total(batches):
        keys, counts, docs = [], [], 0
        for b in batches:
            keys += [np.frombuffer(x, _U) for x in column(b, "keys").to_pylist()]
            counts += [_from_planes(x) for x in column(b, "counts").to_pylist()]
            docs += sum(column(b, "docs").to_pylist())
            if len(keys) > 64:
                keys, counts = _summed(keys, counts)
        if keys:
            (k,), (n,) = _summed(keys, counts)
            is_hot = n >= (floor or max(1, n.sum() / 16))
            top = k[np.lexsort((k, -n))[: -(-common // parts)]]
            yield batch_of(out, [int(n.sum())], [len(k)], [docs], [k[is_hot].tobytes()], [n[is_hot].astype(np.int64).tobytes()], [top.tobytes()])

    got = rows.filter("train").select("text").mapInArrow(count, "part int, keys binary, counts binary, docs long").repartitionById(parts, F.col("part")).mapInArrow(total, "n long, v long, docs long, hot binary, hot_n binary, common binary").collect()
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(bytes(r[name]), kind) for r in got)])
    return {"n": sum(r.n for r in got), "v": sum(r.v for r in got), "docs": sum(r.docs for r in got), "hot": Hot(join("hot", _U), join("hot_n", np.int64)), "common": np.sort(join("common", _U))}


def _summed(keys, counts):
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return [k], [np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)]


# ---- blobs: arrays of integers as compressed byte planes


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Non-negative integers: how many bytes each takes, how many there are, and their bytes by significance, compressed."""
    x = np.ascontiguousarray(x, _U)
    width = width or max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<BI", width, len(x)) + _zstd()[0].compress(np.ascontiguousarray(planes).tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BI", raw)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_zstd()[1].decompress(raw[5:]), np.uint8).reshape(width, n).T
    return out.view(_U).reshape(-1)


def _bundle(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _unbundle(raw: bytes) -> list[bytes]:
    at, out = 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _coded(h: np.ndarray, code: np.ndarray, n_codes: int, literal_bytes: int) -> tuple[bytes, bytes]:
    """Words as codes (n_codes: none), and the hashes of those without one."""
    rare = code < 0
    literal = np.ascontiguousarray(h[rare]).view(np.uint8).reshape(-1, 8)[:, :literal_bytes]
    return _planes(np.where(rare, n_codes, code)), literal.tobytes()


def _decoded(codes: bytes, literals: bytes, literal_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words (the table's size: none), and the hashes of those without one."""
    literal = np.frombuffer(literals, np.uint8).reshape(-1, literal_bytes)
    wide = np.zeros((len(literal), 8), np.uint8)
    wide[:, :literal_bytes] = literal
    return _from_planes(codes).astype(np.int32), wide.view(_U).reshape(-1)


def _ranked(w, v, u, table: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All hashes of a shard, sorted, and the place of each position's w, v and u among them. w, v, u: codes and hashes, as _decoded() gives them by blob.

    Only rare words are sorted; words with a code find their place by it.
    """
    codes = [np.concatenate([c for c, _ in x]) for x in (w, v, u)]
    rare, of_rare = zip(*(np.unique(np.concatenate([h for _, h in x]), return_inverse=True) for x in (w, [*v, *u])), strict=True)
    split = sum(len(h) for _, h in v)
    of_rare = (of_rare[0], of_rare[1][:split], of_rare[1][split:])
    spaces = (np.concatenate((table, rare[0])), np.concatenate((table & _CONTEXT, rare[1] & _CONTEXT)))
    used = [np.zeros(len(x), bool) for x in spaces]
    ids = []
    for k, (code, own) in enumerate(zip(codes, of_rare, strict=True)):
        code[code == len(table)] = len(table) + own
        used[min(k, 1)][code] = True
        ids.append(code)
    at = [np.flatnonzero(x) for x in used]
    words, place = np.unique(np.concatenate([x[i] for x, i in zip(spaces, at, strict=True)]), return_inverse=True)
    ranks = [np.zeros(len(x), np.int32) for x in spaces]
    ranks[0][at[0]], ranks[1][at[1]] = place[: len(at[0])], place[len(at[0]) :]
    return words, [ranks[min(k, 1)][x] for k, x in enumerate(ids)]


def _position_blobs(rows: DataFrame, shards: int, hot: tuple[Hot, Hot, Hot], table: np.ndarray) -> DataFrame:
    """shard, block, blob: the positions of every block of text, dealt to shards; and with `ids` the documents of the block, dealt by its number."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.bool_()), ("blob", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in blocks(batches, BLOCK):
            number += 1
            w, v, u, doc = _tokens(Texts(column(b, "text")))
            train = np.asarray(column(b, "train"))
            words, at = np.unique(np.concatenate((w, [_START])), return_inverse=True)
            place = np.minimum(np.searchsorted(table, words), max(len(table) - 1, 0))
            code = np.where(table[place] == words, place, -1) if len(table) else np.full(len(words), -1)
            own, start = code[at[:-1]], code[at[-1]]
            back = lambda k: np.where(np.concatenate((np.zeros(min(k, len(doc)), bool), doc[k:] == doc[:-k])), np.roll(own, k), start)
            codes = (own, back(1), back(2))
            shard = _deal(w, shards)
            one = np.flatnonzero(hot[0].find(w) >= 0)
            pair = pair_key(w[one], v[one])
            shard[one] = _deal(pair, shards)
            two = np.flatnonzero(hot[1].find(pair) >= 0)
            triple = triple_key(w[one[two]], v[one[two]], u[one[two]])
            shard[one[two]] = _deal(np.where(hot[2].find(triple) >= 0, mix(triple ^ _U(number)), triple), shards)
            order = np.argsort(shard, kind="stable")  # positions of a shard stay in the order of documents
            cuts = runs(shard[order])
            w, v, u, doc, codes = w[order], v[order], u[order], doc[order], [c[order] for c in codes]
            made = []
            for s, e in zip(cuts, cuts[1:]):
                parts = [_planes(np.diff(doc[s:e], prepend=0)), _planes(train[doc[s:e]].astype(np.uint8))]
                for h, c, size in zip((w, v, u), codes, (8, CONTEXT_BITS // 8, CONTEXT_BITS // 8)):
                    parts += _coded(h[s:e], c[s:e], len(table), size)
                made.append(_bundle(*parts))
            sizes = np.bincount(doc, minlength=b.num_rows)
            ids = column(b, "doc_id")
            whole = _bundle(np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_valid()).astype(np.uint8).tobytes(), _planes(sizes))
            n = len(made)
            yield batch_of(schema, np.append(shard[order[cuts[:-1]]], number % shards), np.full(n + 1, number), np.arange(n + 1) == n, [*made, whole])

    return rows.mapInArrow(run, "shard int, block long, ids boolean, blob binary")


def _score_shard(blobs: list[tuple[int, bytes]], scale: float, hot: tuple[Hot, Hot, Hot], table: np.ndarray):
    """Build the shard's trie from the training positions and score all its positions. Yields (block, sums per document)."""
    parts, trains, docs = ([], [], []), [], []
    for _, blob in blobs:
        gaps, train, *coded = _unbundle(blob)
        docs.append(np.cumsum(_from_planes(gaps)).astype(np.int32))
        trains.append(_from_planes(train).astype(bool))
        for k, size in enumerate((8, CONTEXT_BITS // 8, CONTEXT_BITS // 8)):
            parts[k].append(_decoded(coded[2 * k], coded[2 * k + 1], size))
    if not docs:
        return
    words, (w, v, u) = _ranked(*parts, table)
    parts = None
    bits = max(1, (len(words) - 1).bit_length())
    if 3 * bits <= 63:
        key = (w.astype(np.int64) << 2 * bits) | (v.astype(np.int64) << bits) | u
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        del key
    else:
        order = np.lexsort((u, v, w))
        new = np.ones(len(order), bool)
        new[1:] = False
        for x in (w, v, u):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
    firsts = np.flatnonzero(new)
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    total = np.add.reduceat(np.concatenate(trains)[order].astype(np.int64), firsts)
    w, v, u = (x[order[firsts]] for x in (w, v, u))
    del order, new
    if len(hot[2].keys):
        total = hot[2].of(triple_key(words[w], words[v], words[u]), total)
    handle, path = tempfile.mkstemp(suffix=".trie")  # this task's own; unlinked once it is mapped
    os.close(handle)
    try:
        Trie.of_ranks(words, w, v, u, total, hot[:2], scale).save(path)
        trie = Trie.map(path)
    finally:
        os.unlink(path)
    num, den, c = np.empty(len(w)), np.empty(len(w)), np.empty(len(w), np.int64)
    known_at = np.concatenate([trie.index(words[s : s + 250_000]) for s in range(0, len(words), 250_000)])
    for s in range(0, len(w), 250_000):
        x = [y[s : s + 250_000] for y in (w, v, u)]
        num[s : s + 250_000], den[s : s + 250_000], c[s : s + 250_000] = trie.lookup(*(words[y] for y in x), scale, hot[:2], places=tuple(known_at[y] for y in x))
    den[words[w] == _END] = 0.0  # nothing follows it
    gain, base, known = num - den, np.log10(c + ALPHA), c > 0
    at = 0
    for (block, _), doc in zip(blobs, docs, strict=True):
        k = inverse[at : at + len(doc)]
        at += len(doc)
        cuts = runs(doc)[:-1]
        sums = [np.add.reduceat(x[k], cuts) for x in (known.astype(np.int64), base, gain)]
        # base sums keep 36 bits of their fraction, sums of gains 23
        low = (sums[1].view(_U) + _U(0x8000)).view(np.uint8).reshape(-1, 8)[:, 2:].T
        yield block, _bundle(_planes(np.diff(doc[cuts], prepend=0)), _planes(sums[0]), np.ascontiguousarray(low).tobytes(), sums[2].astype("<f4").tobytes())


def _gather(blocks_):
    """Sums of the documents of some blocks, from all shards. blocks_: rows (block, ids, blob) in any order."""
    known, wide = {}, {}
    for block, is_ids, blob in blocks_:
        parts = _unbundle(blob)
        if is_ids:
            wide[block] = parts
            continue
        gaps, n, low, gain = parts
        doc = np.cumsum(_from_planes(gaps)).astype(np.int64)
        base = np.zeros((len(doc), 8), np.uint8)
        base[:, 2:] = np.frombuffer(low, np.uint8).reshape(6, -1).T
        top = int(doc[-1]) + 1
        sums = known.get(block)
        if sums is None or sums.shape[1] < top:
            grown = np.zeros((3, top))
            if sums is not None:
                grown[:, : sums.shape[1]] = sums
            sums = known[block] = grown
        sums[0, doc] += _from_planes(n)
        sums[1, doc] += base.view(np.float64).reshape(-1)
        sums[2, doc] += np.frombuffer(gain, "<f4")
    for block, (ids, valid, sizes) in wide.items():
        yield pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(valid, np.uint8) == 0), _from_planes(sizes).astype(np.int64), known[block]


def score_documents(docs: DataFrame, holdout_mod: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, common: int = COMMON) -> DataFrame:
    """Log10 probabilities of every document under a model of those that aren't held out, and under its unigrams.

    Null and empty texts have one token, the end. Every row is a document of its own, also where rows share a doc_id or
    have none (such learn). With no training document, counts are zero and every word is as likely as an unknown one.
    Very long texts are scored whole, a block of text by itself. No ties arise. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc_id = docs[id_col].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(crc_mod(doc_id, holdout_mod) != 0, F.lit(True)).alias("train"))
    parts = width(spark)
    words = _counts(rows, parts, 1, Hot(), 0, common)
    total, table = words["n"], words["common"]
    shards = max(parts, -(-total // shard_tokens))
    floor = max(2, -(-total // (4 * shards)))
    often = words["hot"].counts >= floor
    hot = [Hot(words["hot"].keys[often], words["hot"].counts[often])]
    for order in (2, 3):
        hot.append(_counts(rows, parts, order, hot[-1], floor)["hot"] if len(hot[-1].keys) else Hot())
    hot = tuple(hot)
    z = total + ALPHA * (words["v"] + 1)
    scale = MU / z
    first = float(np.log10(words["docs"] + A * words["docs"] + MU))  # the context of each text's first token

    def score(batches):
        own = []
        for b in batches:
            own += zip(column(b, "block").to_pylist(), column(b, "ids").to_pylist(), column(b, "blob").to_pylist(), strict=True)
        kinds = pa.schema([("block", pa.int64()), ("ids", pa.bool_()), ("blob", pa.binary())])
        for row in own:
            if row[1]:
                yield batch_of(kinds, *([x] for x in row))
        for block, sums in _score_shard([(x, blob) for x, ids, blob in own if not ids], scale, hot, table):
            yield batch_of(kinds, [block], [False], [sums])

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())])

    def gather(batches):
        rows = (r for b in batches for r in zip(column(b, "block").to_pylist(), column(b, "ids").to_pylist(), column(b, "blob").to_pylist(), strict=True))
        for ids, sizes, sums in _gather(rows):
            yield batch_of(schema, ids, sizes, np.rint(sums[0]).astype(np.int64), sums[1], sums[2])

    scored = _position_blobs(rows, shards, hot, table).repartitionById(shards, F.col("shard")).select("block", "ids", "blob").mapInArrow(score, "block long, ids boolean, blob binary")
    per_doc = scored.repartition(parts, "block").mapInArrow(gather, "doc_id long, n_tokens long, n_known long, base double, gain double")
    return per_doc.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), holdout_mod) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(z))).alias("base_score"), (F.col("gain") - first).alias("score"),
    )


def query(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))
