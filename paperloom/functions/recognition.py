"""Column functions around recognisers: reply parsing, transactions, character codec, softmax, NFC and word error rate."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from . import normalise as N

TRANSACTION = "date string, description string, amount string, balance string"


def reply_json(s: Column, schema: str) -> Column:
    """The span from the first brace to the last, parsed; null if there is none or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")), schema)


def transactions(s: Column) -> Column:
    """A JSON list of transactions, typed; entries that aren't objects drop out."""
    objects = F.filter(F.from_json(s, "array<string>"), lambda x: x.startswith("{"))
    rows = F.filter(F.transform(objects, lambda x: F.from_json(x, TRANSACTION)), lambda t: F.coalesce(t.date, t.description, t.amount, t.balance).isNotNull())
    return F.transform(rows, lambda t: F.struct(N.norm_date(t.date).alias("date"), F.lower(F.nullif(t.description, F.lit(""))).alias("description"), N.signed_money(t.amount).alias("amount"), N.signed_money(t.balance).alias("balance")))


def encode_chars(s: Column, charset: str) -> Column:
    """Indices from 1 of the characters in the set; others drop out."""
    return F.filter(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(charset), c)), lambda k: k > 0)


def collapse(ids: Column, charset: str) -> Column:
    """Greedy CTC text: each index that differs from the one before it and isn't the blank 0."""
    kept = F.filter(ids, lambda x, k: (x != 0) & ((k == 0) | (x != F.get(ids, k - 1))))
    return F.array_join(F.transform(kept, lambda x: F.substring(F.lit(charset), x, F.lit(1))), "")


def softmax(x: Column) -> Column:
    """Shifted by the maximum."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC; there is no built-in one."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def label_reason(text: Column) -> Column:
    return F.when(text.isNull(), "malformed_line").when(F.trim(text) == "", "empty_label")


def word_distance(pred: list[str], gold: list[str]) -> int:
    """Word edit distance. Columns of the distance table go through bit vectors as long as the gold text, a word of the other text at a time."""
    start = next((k for k, (p, g) in enumerate(zip(pred, gold)) if p != g), min(len(pred), len(gold)))
    pred, gold = pred[start:], gold[start:]
    end = next((k for k, (p, g) in enumerate(zip(reversed(pred), reversed(gold))) if p != g), min(len(pred), len(gold)))
    pred, gold = pred[: len(pred) - end], gold[: len(gold) - end]
    if not pred or not gold:
        return len(pred) + len(gold)
    where: dict[str, int] = {}
    for k, w in enumerate(gold):
        where[w] = where.get(w, 0) | 1 << k
    every, last, distance = (1 << len(gold)) - 1, 1 << len(gold) - 1, len(gold)
    more, less = every, 0  # where a cell is one more, or one less, than the one above it
    for w in pred:
        same = where.get(w, 0)
        diagonal = (((same & more) + more) ^ more) | same | less
        right_more, right_less = less | (every & ~(diagonal | more)), more & diagonal
        distance += bool(right_more & last) - bool(right_less & last)
        right_more = (right_more << 1 | 1) & every
        right_less = right_less << 1 & every
        more, less = right_less | (every & ~(diagonal | right_more)), right_more & diagonal
    return distance


@F.pandas_udf(DoubleType())
def _wer(pred: pd.Series, gold: pd.Series) -> pd.Series:
    words = lambda s: [w for w in re.split(r"[ \t\n\r\f]+", s or "") if w]
    rate = lambda p, g: word_distance(p, g) / len(g) if g else float(bool(p))
    return pd.Series([rate(words(p), words(g)) for p, g in zip(pred, gold)], dtype="float64")


def wer(pred: str | Column, gold: str | Column) -> Column:
    """Word edit distance over the number of gold words, for texts of any length and vocabulary; without gold words 0 if nothing was predicted, else 1. Nulls are empty."""
    return _wer(pred, gold)


@lru_cache(maxsize=4)
def _steps(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places q that are multiples of a period p from 4 on, for texts of up to size characters: q, p and q + 3 p, in the order of the last."""
    p = np.concatenate([np.full(max((size - 3 * p) // p + 1, 0), p) for p in range(4, size // 5 + 1)])
    first = np.r_[True, p[1:] != p[:-1]]
    q = (np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))) * p
    order = np.argsort(q + 3 * p, kind="stable")
    return q[order], p[order], (q + 3 * p)[order]


def has_repeats(text: str) -> bool:
    """Whether four characters or more of a line stand five times in a row, as the pattern (.{4,})\\1{4,} finds it.

    Such a run has a period p and 5 p characters, so it holds a multiple q of p at which the same four characters stand at q, q + p, q + 2 p and
    q + 3 p. Only periods with such a place are looked at: some n log n steps, where the pattern takes up to the square of a line's length.
    """
    n = len(text)
    if n < 20:
        return False
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.flatnonzero(np.isin(a, (0x0A, 0x0D, 0x85, 0x2028, 0x2029)))
    a[ends] = -1 - ends  # the end of a line equals nothing
    four = ((a[:-3] * 1000003 + a[1:-2]) * 1000003 + a[2:-1]) * 1000003 + a[3:]
    q, p, last = _steps(1 << max(n - 1, 4095).bit_length())
    m = np.searchsorted(last, n - 4, "right")
    q, p = q[:m], p[:m]
    for k in range(3):
        same = four[q + k * p] == four[q + (k + 1) * p]
        q, p = q[same], p[same]
    for period in np.unique(p[p <= n // 5]):
        differ = np.flatnonzero(a[:-period] != a[period:])
        if np.diff(np.r_[-1, differ, n - period]).max() > 4 * period:
            return True
    return False


def repeats(s: Column) -> Column:
    """has_repeats() by row; null where s is null."""

    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else has_repeats(t) for t in texts], dtype=object)

    return F.pandas_udf(find, BooleanType())(s)
