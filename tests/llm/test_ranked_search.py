import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import ranked_search

ITEM = "item_id long, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(rows, items, best=10):
    docs = [(r[0], Counter(words(r[1]))) for r in rows]
    count, length = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for doc, c in docs:
            m = 25 + 75 * sum(c.values()) * count // max(length, 1)
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(rows, words):
    rng = random.Random(9)
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    out += [(100, rows[3][1]), (101, rows[60][1].upper()), (102, "same same SAME"), (103, "nowhere-found"), (104, None), (105, ""), (106, "| $ #"), (107, rows[5][1] + " " + rows[5][1])]
    return out + [out[0], (None, rows[9][1])]


def test_against_brute_force(spark, docs, rows, items):
    assert told(ranked_search.ranked(docs, spark.createDataFrame(items, ITEM))) == brute(rows, items)


@pytest.mark.parametrize("shard,held,together", [(7, 1 << 22, 1), (64, 300, 3), (20, 1, 32)])
def test_small_shards_and_single_steps(spark, docs, rows, items, monkeypatch, shard, held, together):
    # the search itself, shard by shard, as a task does it
    monkeypatch.setattr(ranked_search, "TOGETHER", together)
    fair = [r for r in rows if words_of(r)]
    count, length = len(fair), sum(len(words_of(r)) for r in fair)
    vocabulary = sorted({t.encode() for _, text in items for t in words(text)})
    place = {t: i for i, t in enumerate(vocabulary)}
    df = Counter(t for r in fair for t in set(words_of(r)))
    for _, text in items:
        asked = Counter(words(text))
        terms = np.array(sorted(place[t.encode()] for t in asked), np.int64)
        weights = np.array([asked[vocabulary[p].decode()] * math.floor(1000 * math.log((2 * count + 2) / (2 * df[vocabulary[p].decode()] + 1))) for p in terms], np.int64)
        kept = []
        for i in range(0, len(fair), shard):
            part = fair[i : i + shard]
            counts = [Counter(place[t.encode()] for t in words_of(r) if t.encode() in place) for r in part]
            table = pa.table({"doc_id": pa.array([r[0] for r in part], pa.int64()), "n": pa.array([len(words_of(r)) for r in part], pa.int64()), "term": pa.array([sorted(c) for c in counts], pa.list_(pa.int32())), "tf": pa.array([[c[t] for t in sorted(c)] for c in counts], pa.list_(pa.int32()))})
            found = ranked_search.Shard(table, len(vocabulary), count, length)
            kept = sorted(kept + [(-s, found.ids[p].as_py() is None, found.ids[p].as_py() or 0) for s, p in (found.search(terms, weights, -kept[-1][0] if len(kept) == 10 else 0) if len(terms) else [])])[:10]
        assert [(-s, d if not none else None) for s, none, d in kept] == [(s, d) for _, _, d, s in sorted(brute(rows, [(1, text)]), key=lambda x: x[1])]


def words_of(row):
    return words(row[1])


def test_far_fewer_documents_are_scored_than_there_are():
    rng = random.Random(2)
    n = 4096
    counts = [{0: 1, rng.randrange(1, 400): rng.randint(1, 3)} for _ in range(n)]
    counts[1234] = {0: 1, 1: 9, 2: 9, 3: 9}
    table = pa.table({"doc_id": pa.array(range(n)), "n": pa.array([50] * n, pa.int64()), "term": pa.array([sorted(c) for c in counts], pa.list_(pa.int32())), "tf": pa.array([[c[t] for t in sorted(c)] for c in counts], pa.list_(pa.int32()))})
    shard, scored = ranked_search.Shard(table, 400, n, 50 * n), []
    bounds = shard.bounds
    shard.bounds = lambda level, nodes, *more: (scored.append(len(nodes)) if level == 0 else None, bounds(level, nodes, *more))[1]
    got = shard.search(np.array([0, 1, 2, 3]), np.array([10, 6000, 6000, 6000]), 0, 1)
    assert [p for _, p in got] == [1234] and sum(scored) <= n // 4


def test_empty_tables_and_ids_of_text(spark, docs, none, rows):
    items = spark.createDataFrame([(1, rows[3][1])], ITEM)
    assert ranked_search.ranked(none, items).count() == 0
    assert ranked_search.ranked(docs, items.where("false")).count() == 0
    named = spark.createDataFrame([(f"d{i}", "alpha beta") for i in range(12)], "doc_id string, text string")
    got = ranked_search.ranked(named.unionByName(spark.createDataFrame([("x", "gamma")] * 40, named.schema)), spark.createDataFrame([("q", "Alpha")], "item_id string, text string")).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == sorted(f"d{i}" for i in range(12))[:10]
