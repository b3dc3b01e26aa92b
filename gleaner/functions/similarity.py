"""Likeness of short words by matching blocks, and what is read by it: bracketed tags.

Two words' longest common stretch is a block; so are the longest ones left of it and right of it, and so on. Their likeness is
twice the letters in blocks by the letters of both. Many pairs are worked out at once: a table says for each two places how
long the words agree up to there, and the stretches that are still open are held in a list, level by level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.config import Settings
from gleaner.functions import fixed as X
from gleaner.functions.text import squeezed

#: Places of tables of pairs that are worked out at once.
TABLE = 1 << 21


def folded(word: str) -> str:
    """As functions.text.norm, for one word."""
    word = word.lower()
    for pair, one in X.NORM_PAIRS:
        word = word.replace(pair, one)
    word = word.translate(str.maketrans(*X.NORM_DIGITS))
    return "".join(c for c in word if "a" <= c <= "z").replace("i", "l")


def _codes(words: list[str], width: int, blank: int) -> np.ndarray:
    """Words as rows of code points, filled up with a value that no letter has."""
    out = np.full((len(words), width), blank, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """The letters in matching blocks of each pair of words. Of equally long blocks the one that begins first in a counts, then in b."""
    pairs, rows, columns = len(a), max(map(len, a), default=0), max(map(len, b), default=0)
    out = np.zeros(pairs, np.int64)
    if not rows or not columns:
        return out
    same = _codes(a, rows, -1)[:, :, None] == _codes(b, columns, -2)[:, None, :]
    agree = same.astype(np.int32)  # how far back both words agree from a place on
    for i in range(1, rows):
        agree[:, i, 1:] = np.where(same[:, i, 1:], agree[:, i - 1, :-1] + 1, 0)
    of, alo, blo = np.arange(pairs), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    ahi, bhi = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    i, j = np.arange(rows)[None, :, None], np.arange(columns)[None, None, :]
    while len(of):
        size = np.minimum(np.minimum(agree[of], i - alo[:, None, None] + 1), j - blo[:, None, None] + 1)
        size[(i >= ahi[:, None, None]) | (j >= bhi[:, None, None]) | (size < 0)] = 0
        flat = size.reshape(len(of), -1)
        best = flat.argmax(1)
        n = flat[np.arange(len(of)), best]
        found = n > 0
        np.add.at(out, of[found], n[found])
        of, alo, ahi, blo, bhi, n = (v[found] for v in (of, alo, ahi, blo, bhi, n))
        ai, bj = best[found] // columns, best[found] % columns
        left, right = (of, alo, ai - n + 1, blo, bj - n + 1), (of, ai + 1, ahi, bj + 1, bhi)
        of, alo, ahi, blo, bhi = (np.concatenate(v) for v in zip(left, right, strict=True))
        open_ = (ahi > alo) & (bhi > blo)
        of, alo, ahi, blo, bhi = (v[open_] for v in (of, alo, ahi, blo, bhi))
    return out


def ratios(words: list[str], others: list[str]) -> np.ndarray:
    """The likeness of each word to the other beside it; two empty words are alike. Pairs of about one size are worked out together."""
    n = np.array([(len(w), len(o)) for w, o in zip(words, others, strict=True)], np.int64).reshape(-1, 2)
    matched, order, at = np.zeros(len(n), np.int64), np.argsort(n.max(1, initial=0), kind="stable"), 0
    while at < len(order):
        part = order[at : at + TABLE // 64]
        while len(part) > 1 and len(part) * np.prod(n[part].max(0)) > TABLE:
            part = part[: len(part) // 2]
        matched[part] = _matched([others[i] for i in part], [words[i] for i in part])
        at += len(part)
    both = n.sum(1)
    return np.where(both > 0, 2.0 * matched / np.maximum(both, 1), 1.0)


def distinct_ratios(words: pd.Series, others: pd.Series) -> np.ndarray:
    """As ratios, worked out once for each distinct pair; NaN where a word is null."""
    known = (words.notna() & others.notna()).to_numpy()
    pairs = list(zip(words[known], others[known], strict=True))
    distinct = list(dict.fromkeys(pairs))
    got = dict(zip(distinct, ratios([p[0] for p in distinct], [p[1] for p in distinct]).tolist(), strict=True))
    out = np.full(len(words), np.nan)
    out[known] = [got[p] for p in pairs]
    return out


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of a word to another; null if one is null."""
    got = distinct_ratios(a, b)
    return pd.Series([None if np.isnan(x) else x for x in got], dtype=object).astype("Float64")


def nearest(words: list[str], among: list[str], cutoff: float) -> list[str | None]:
    """For each word the one among others that is most alike, if that reaches the cutoff; of equals the last in the alphabet."""
    among = sorted(set(among), reverse=True)
    if not among or not words:
        return [None] * len(words)
    got = ratios([w for w in words for _ in among], among * len(words)).reshape(len(words), -1)
    best = got.argmax(1)
    return [among[k] if got[i, k] >= cutoff else None for i, k in enumerate(best)]


_TAG_OF = {folded(t): t for t in X.TAGS}
_CHANNEL_KEYS = [folded(c) for c in X.CHANNELS]


def tags_of(shown: list[str], tag_cutoff: float = Settings.tag_cutoff, channel_cutoff: float = Settings.channel_cutoff) -> list[str | None]:
    """The tags that bracketed words stand for; a word itself if it is an unknown one, None for debris and channels."""
    keys = [folded(s) for s in shown]
    open_ = sorted({k for k in keys if k and k not in _CHANNEL_KEYS and k not in _TAG_OF})
    near = dict(zip(open_, nearest(open_, list(_TAG_OF), tag_cutoff), strict=True))
    # a word that holds all of a shorter tag is another word
    near = {k: None if t is not None and t in k and len(k) >= len(t) + 2 else t for k, t in near.items()}
    rest = [k for k, t in near.items() if t is None]
    channel = {k for k, c in zip(rest, nearest(rest, _CHANNEL_KEYS, channel_cutoff), strict=True) if c is not None}
    out = []
    for word, key in zip(shown, keys, strict=True):
        if not key or key in _CHANNEL_KEYS:
            out.append(None)
        elif (tag := _TAG_OF.get(key) or _TAG_OF.get(near[key])) is not None:
            out.append(tag)
        else:
            out.append(word if key not in channel and all(c == " " or "a" <= c.lower() <= "z" for c in word) else None)
    return out


def tag_of(shown: str, tag_cutoff: float = Settings.tag_cutoff, channel_cutoff: float = Settings.channel_cutoff) -> str | None:
    return tags_of([shown], tag_cutoff, channel_cutoff)[0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolved(shown: pd.Series) -> pd.Series:
    words = sorted({w for x in shown if x is not None for w in x})
    of = dict(zip(words, tags_of(words), strict=True))
    return pd.Series([list(dict.fromkeys(t for t in map(of.get, x) if t is not None)) if x is not None else [] for x in shown])


def bracketed(body: Column) -> Column:
    """All bracketed words of a line, as shown."""
    return F.transform(F.regexp_extract_all(body, F.lit(X.TAG), F.lit(1)), squeezed)


def tags(body: Column) -> Column:
    """The tags of a line in order, each once. Likeness is worked out once for each word of a batch."""
    return _resolved(bracketed(body))
