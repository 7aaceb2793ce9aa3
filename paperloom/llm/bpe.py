"""BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest vocabulary entries. By the pair lemma of BPE a cut is the
true encoding if and only if each adjacent pair of its tokens (and a lone token by itself) is what merging
gives for the pair's own text. A vectorised check tests every adjacent pair of all new words at once against
a table of judged pairs; only words with a failing pair undergo exact merging.

Texts are cut at white space first, so that each worker encodes a distinct chunk once; chunks are told apart by
a 64-bit hash. The chunk table is bounded by MAX_CHUNKS and starts anew beyond it.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Texts, batch_of, blocks, column, documents, small_batches

MAX_CHUNKS = 800_000
_KNOWN = 100_000
_SHORT = 64
_LONE = 0xFFFFF
_PAIR_BITS = 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    at = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class BpeCodec:
    """Encoder and decoder for a tokenizers file with NFC, white-space folding, lower case and word-end suffix."""

    def __init__(self, path: str, speculate: bool = True):
        self.speculate = speculate
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(words.replace(r"\s", r"\p{White_Space}"))
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, k in [*vocab.items(), *self.special.items()]:
            self.strings[k] = s.encode()
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        end = self.suffix
        self.mid: dict[bytes, int] = {}
        self.end: dict[bytes, int] = {}
        self.text: list[bytes] = [b""] * size
        self.last = np.zeros(size, bool)
        for s, k in vocab.items():
            last = bool(end) and s.endswith(end)
            body = s.removesuffix(end) if last else s
            if body and all(c in back for c in body):
                raw = bytes(back[c] for c in body)
                (self.end if last else self.mid)[raw] = k
                self.text[k], self.last[k] = raw, last
        self.mid_symbol = [vocab[s] for s in symbols]
        self.end_symbol = [vocab[s + end] for s in symbols]
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.made = [vocab[a + b] for a, b in merges]
        self.rank = {vocab[a] << _PAIR_BITS | vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.longest: dict[bytes, int] = {}
        for raw in [*self.mid, *self.end]:
            for n in (1, 2, 3):
                key = raw[:n]
                self.longest[key] = max(self.longest.get(key, 0), len(raw))
        self.pairs = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)
        self.tested = self.failed = 0
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.from_, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.known: dict[bytes, list[int]] = {}

    # ---- one word

    def merge(self, word: bytes, final: bool = True) -> list[int]:
        """Exact merging: the lowest-ranked pair first, the leftmost of equals."""
        ids = [self.mid_symbol[b] for b in word]
        if final and ids:
            ids[-1] = self.end_symbol[word[-1]]
        if len(ids) > _SHORT:
            return self._merge_long(ids)
        rank, none = self.rank, len(self.made)
        ranks = [rank.get(a << _PAIR_BITS | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k] = self.made[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank.get(ids[k - 1] << _PAIR_BITS | ids[k], none)
            if k < len(ranks):
                ranks[k] = rank.get(ids[k] << _PAIR_BITS | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked symbols."""
        rank, made = self.rank, self.made
        pair = lambda k: rank.get(ids[k] << _PAIR_BITS | ids[after[k]])
        n, after, before = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        todo = [(m, k) for k in range(n - 1) if (m := pair(k)) is not None]
        heapq.heapify(todo)
        while todo:
            m, k = heapq.heappop(todo)
            if ids[k] < 0 or after[k] >= n or pair(k) != m:
                continue
            gone = after[k]
            ids[k], ids[gone] = made[m], -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (m := pair(k)) is not None:
                    heapq.heappush(todo, (m, k))
            if (p := before[k]) >= 0 and (m := pair(p)) is not None:
                heapq.heappush(todo, (m, p))
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, mid, longest = [], 0, len(word), self.mid, self.longest
        while i < n:
            most = longest.get(word[i : i + 3]) or longest.get(word[i : i + 2]) or longest[word[i : i + 1]]
            j = min(n, i + most)
            if j == n:
                k = self.end.get(word[i:n])
                j -= k is None
            else:
                k = None
            while k is None:
                k = mid.get(word[i:j])
                if k is None:
                    j -= 1
            out.append(k)
            i = j
        return out

    # ---- many words

    def _judge(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair code (or lone token) is stable under merging; judges the new ones."""
        distinct, inverse = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, distinct), max(0, len(self.pairs) - 1))
        new = distinct[self.pairs[at] != distinct] if len(self.pairs) else distinct
        if len(new):
            said = np.zeros(len(new), bool)
            for k, c in enumerate(new.tolist()):
                a, b = c >> _PAIR_BITS, c & _LONE
                if b == _LONE:
                    said[k] = self.merge(self.text[a], bool(self.last[a])) == [a]
                else:
                    said[k] = self.merge(self.text[a] + self.text[b], bool(self.last[b])) == [a, b]
            pairs, good = np.concatenate((self.pairs, new)), np.concatenate((self.good, said))
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.good = pairs[order], good[order]
        return self.good[np.searchsorted(self.pairs, distinct)][inverse]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        cuts = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        if not lengths.sum():
            return cuts
        flat = np.fromiter((x for c in cuts for x in c), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(cuts)), lengths)
        inner = of[1:] == of[:-1]
        lone = lengths[of] == 1
        codes = np.concatenate(((flat[:-1][inner] << _PAIR_BITS) | flat[1:][inner], (flat[lone] << _PAIR_BITS) | _LONE))
        owners = np.concatenate((of[1:][inner], of[lone]))
        failing = np.unique(owners[~self._judge(codes)])
        self.tested += len(cuts)
        self.failed += len(failing)
        for k in failing.tolist():
            cuts[k] = self.merge(words[k])
        return cuts

    def pieces(self, chunk: bytes) -> list[bytes | int]:
        """The words (as bytes) and special ids of a chunk, normalised as the tokenizer does."""
        import unicodedata

        if chunk.isascii() and b"<|" not in chunk:
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1:] in b".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1:]]
            return [w.encode() for w in self.words.findall(chunk.decode().lower())]
        out: list[bytes | int] = []
        text = chunk.decode("utf-8", "replace")
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                out += [part.encode()] if part.isalpha() else [w.encode() for w in self.words.findall(part)]
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, count of each)."""
        cut, known = [self.pieces(c) for c in chunks], self.known
        new = list(dict.fromkeys(w for c in cut for w in c if isinstance(w, bytes) and w not in known))
        known.update(zip(new, self.encode_words(new) if self.speculate else map(self.merge, new), strict=True))
        flat: list[int] = []
        count = np.zeros(len(cut), np.int64)
        for k, c in enumerate(cut):
            n = len(flat)
            for x in c:
                flat += known[x] if isinstance(x, bytes) else (x,)
            count[k] = len(flat) - n
        return np.array(flat, np.uint32), count

    def encode_block(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, their bounds)."""
        starts, lengths, doc, h = texts.words(lower=False)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(texts.n + 1, np.int64)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MAX_CHUNKS:
            self._clear()
        if len(self.known) > _KNOWN:
            self.known.clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        fresh = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if fresh.any():
            raw = texts.data.tobytes()
            where = first[fresh]
            ids, count = self.encode_chunks([raw[s : s + n] for s, n in zip(starts[where].tolist(), lengths[where].tolist(), strict=True)])
            from_ = len(self.flat) + np.cumsum(count) - count
            self.flat = np.concatenate((self.flat, ids))
            keys = np.concatenate((self.keys, distinct[fresh]))
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.from_ = np.concatenate((self.from_, from_))[order]
            self.count = np.concatenate((self.count, count))[order]
        at = np.searchsorted(self.keys, distinct)
        count, from_ = self.count[at][inverse], self.from_[at][inverse]
        ends = np.cumsum(count)
        place = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(from_ - (ends - count), count)
        bounds = np.concatenate(([0], ends))[np.searchsorted(doc, np.arange(texts.n + 1))]
        return self.flat[place], bounds

    def encode(self, text: str) -> list[int]:
        ids, _ = self.encode_block(Texts(pa.array([text])))
        return ids.tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Vocabulary strings joined by single spaces, special ones too; as UTF-8."""
        strings = self.strings
        return b" ".join([strings[k] for k in ids.tolist()])

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.uint32)).decode()


_codecs: dict[tuple[str, bool], BpeCodec] = {}


def codec(path: str, speculate: bool = True) -> BpeCodec:
    """One per worker. Without speculation every word is merged at once: the same ids, for text whose words mostly fail the check."""
    if (path, speculate) not in _codecs:
        _codecs[path, speculate] = BpeCodec(path, speculate)
    return _codecs[path, speculate]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text of every document. Runs per row: no shuffle.

    Null and empty texts have no tokens and decode to the empty text; repeated rows give repeated results;
    very long texts are encoded whole, pieces of text at a time; no ties arise;
    extra columns are ignored; an empty table gives an empty result. path: the vocabulary file, by default the
    public one of the worker's own installation.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = codec(path or vocabulary())
        for b in blocks(batches):
            ids, at = bpe.encode_block(Texts(column(b, "text")))
            ids = ids.astype("<u4")
            own = [ids[at[k] : at[k + 1]] for k in range(b.num_rows)]
            yield batch_of(schema, column(b, "doc_id"), np.diff(at), [hashlib.sha256(x.tobytes()).hexdigest() for x in own], [hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in own])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    return encode_decode(documents(spark, sf_dir))
