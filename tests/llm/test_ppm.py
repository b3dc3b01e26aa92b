import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gleaner.llm import ppm

SF = "/root/testdata/sf0.001"


def low(text):
    """A-Z lower-cased, one character after the other."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


CAPITALS = [(900, "The THE the É é Éa ÉA İ ẞ"), (901, "the tHe É Q q\x85Q\u00a0x ſ K"), (902, "ZZZ zzz Zzz")]


class Brute:
    def __init__(self, texts, order, share):
        count = [Counter() for _ in range(order + 1)]
        for t in texts:
            b = b"\xff" * order + t + b"\xff"
            count[order].update(b[i - order : i + 1] for i in range(order, len(b)))
        for k in range(order, 0, -1):
            for g, n in count[k].items():
                count[k - 1][g[1:]] += n
        least = share * sum(count[0].values())
        self.count = [{g: n for g, n in c.items() if n >= least} for c in count]
        self.next = [defaultdict(dict) for _ in count]
        for k, c in enumerate(self.count):
            for g, n in c.items():
                self.next[k][g[:-1]][g[-1]] = n
        self.order = order

    def log10(self, context, byte):
        gone, out = set(), 0.0
        for k in range(self.order, -1, -1):
            of = context[len(context) - k :]
            seen = self.next[k].get(of)
            if not seen:
                continue
            rare = max((self.count[k - 1].get(of, 0) if k else 0) - sum(seen.values()), 0)
            left = {x: n for x, n in seen.items() if x not in gone}
            whole = sum(left.values()) + len(left) + rare
            if byte in left:
                return out + math.log10(left[byte] / whole)
            if len(left) + rare:
                out += math.log10((len(left) + rare) / whole)
            gone |= set(seen)
        return out - math.log10(max(256 - len(gone), 1))

    def score(self, t):
        b = b"\xff" * self.order + t + b"\xff"
        return sum(self.log10(b[i - self.order : i], b[i]) for i in range(self.order, len(b)))


@pytest.mark.parametrize("share", [0.0, 1e-3])
def test_trie_against_brute_force(spark, docs, rows, share):
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(CAPITALS, "doc_id long, text string"))
    texts = [low(r[1]).encode() for r in [*rows, *CAPITALS]]
    brute = Brute(texts, 3, share)
    trie = ppm.trained(docs, 3, share)
    for t in [*texts[:20], b"", "ñandú\x00 zzz".encode(), b"QQQQ"]:
        assert trie.score([t])[0] == pytest.approx(brute.score(t), rel=1e-9)


def test_probabilities_sum_to_one(docs):
    import numpy as np

    trie = ppm.trained(docs, 2, 1e-3)
    for context in (0x6120, 0xFFFF, 0x0102, 0x6E67):
        p = 10 ** trie.log10((np.int64(context) << 8) | np.arange(256))
        assert 0 < p.sum() <= 1 + 1e-9


def base_columns(rows):
    """The columns of the contract by its own words: lower-case A-Z, words, one end, and the smoothed counts."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*(w for w in re.split("[\\x20\\x09-\\x0D]+", low(t)) if w), ""]
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update(tokens(r[1]))
    n, v = count.total(), len(count)
    out = []
    for r in rows:
        w = tokens(r[1])
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((str(r[0]), held(r[0]), len(w), sum(count[x] > 0 for x in w), n, f"{base:.9g}"))
    return sorted(out)


def got_columns(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.9g}") for r in df.collect())


def test_report(spark, docs, rows):
    every = docs.select("doc_id", "text").union(spark.createDataFrame(CAPITALS, "doc_id long, text string"))
    assert got_columns(ppm.report(every)) == base_columns([*rows, *CAPITALS])
    assert all(r.score < 0 for r in ppm.report(docs).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_report_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert any(c.isupper() for c in rows[0][1] or "")
    assert got_columns(ppm.report(docs)) == base_columns(rows)


def test_rare_words_meet_their_counts(docs, monkeypatch):
    before = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in ppm.report(docs).collect())
    monkeypatch.setattr(ppm, "WORD_SHARE", 2.0)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in ppm.report(docs).collect()) == before


def test_empty(spark, none):
    assert ppm.report(none).count() == 0
    one = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-4 * math.log10(256)) for r in ppm.report(one).collect())


@pytest.mark.parametrize("kept", [2_000_000, 300])
def test_rare_grams_count_in_a_large_corpus(spark, rows, monkeypatch, kept):
    monkeypatch.setattr(ppm, "KEPT", kept, raising=False)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    filler = next(i for i in range(1000, 1100) if not held(i))
    some = [(r[0], r[1]) for r in rows[:80]] + [(filler, "a " * 1_500_000)]
    texts = [low(t).encode() for i, t in some if not held(i)]
    brute = Brute(texts, ppm.ORDER, 0.0)
    got = ppm.report(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).collect()
    want = sorted((str(i), round(brute.score(low(t).encode()), 6)) for i, t in some if i != filler)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got if r.doc_id != filler) == want
