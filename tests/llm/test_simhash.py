import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from gleaner.llm import simhash_dedup as sd


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(x, budget=4):
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= budget)
    return sd.united(np.arange(len(x)), i, j)


def clustered(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 20, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = centres[rng.integers(0, 20)]
        for b in rng.integers(0, 64, int(rng.integers(0, 9))):
            x ^= np.uint64(1) << np.uint64(b)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_walk():
    x = clustered()
    paths, root = sd.walk(x, None, 0, 0)
    assert (paths == x).all() and (np.searchsorted(x, root) == brute_components(x)).all()


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_some_order_puts_equal_bits_first(m):
    rng = np.random.default_rng(m)
    for _ in range(50):
        gone = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not gone & set(order[:top]) for order, top in sd.orders(m))
        assert all(sorted(order) == list(range(64)) for order, _ in sd.orders(m))


@pytest.mark.parametrize("node", [20_000, 25])
def test_links_join_all_components(spark, node):
    x = clustered()
    df = spark.createDataFrame(pd.DataFrame({"fp": x.view(np.int64)}))
    root = {r.fp: r.root for r in sd.labelled(sd.links(df, node=node)).collect()}
    got = pd.Series([root.get(v, v) for v in x.view(np.int64).tolist()])
    want = pd.Series(brute_components(x))
    assert got.groupby(want).nunique().max() == 1 and want.groupby(got).nunique().max() == 1


def test_report(docs, rows):
    got = {}
    for r in sd.report(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    prints = [(r[0], brute_print(r[1])) for r in rows]
    x = np.unique(np.array([p for _, p in prints], np.uint64))
    label = dict(zip(x.tolist(), brute_components(x).tolist(), strict=True))
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    want = {}
    for i, p in prints:
        want.setdefault(i, set()).add((f"{p:016x}", least.get(label[p])))
    assert got == want


def near_shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_wide_prints_against_brute_force(rows):
    import pyarrow as pa

    column = pa.array([r[1] for r in rows] + ["A b C d e f", "a B c D E F", "x" * 3_000_000, "One two"], pa.string())
    got = sd.as_words(sd.wide_of(column))
    alone = [sd.as_words(sd.wide_of(column.slice(i, 1)))[0] for i in range(len(column))]
    assert (got == np.array(alone)).all() and (got[-4] == got[-3]).all()
    for i in range(0, len(column), 7):
        for j in range(i):
            a, b = near_shingles(column[i].as_py()), near_shingles(column[j].as_py())
            apart = int(np.bitwise_count(got[i] ^ got[j]).sum())
            likeness = len(a & b) / len(a | b) if a | b else 1.0
            assert apart <= sd.REACH if likeness > 0.9 else likeness > 0.3 or apart > 48, (i, j, likeness, apart)


@pytest.mark.parametrize("node", [20_000, 40])
def test_near_copies_are_found_and_others_are_left(spark, words, node, monkeypatch):
    import random

    monkeypatch.setattr(sd, "NODE_MEANT", 8)
    rng = random.Random(4)
    texts = [[rng.choice(words) for _ in range(150)] for _ in range(300)]
    near = [list(texts[i % 60]) for i in range(240)]  # one or two words changed: similarity of 0.87 at least
    for t in near:
        for _ in range(rng.randint(1, 2)):
            t[rng.randrange(150)] = "changed"
    hot = [list(texts[299]) for _ in range(200)]  # a large group
    for t in hot:
        t[rng.randrange(150)] = f"other{rng.random()}"
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *near, *hot])]
    prints = spark.createDataFrame(rows, "doc_id long, text string")
    import pyarrow as pa

    raw = sd.node_of(pa.array([t for _, t in rows]), pa.array(range(len(rows)))).to_pylist()
    root = {bytes(r.fp): bytes(r.root) for r in sd.labelled(sd.near_links(spark.createDataFrame([(x,) for x in dict.fromkeys(raw)], "fp binary"), node)).collect()}
    of = [root.get(x, x) for x in raw]
    assert len({of[i] for i in range(300)}) == 300  # different texts stay apart
    caught = sum(of[300 + i] == of[i % 60] for i in range(240)) + sum(of[540 + i] == of[299] for i in range(200))
    assert caught >= 0.97 * 440
    if node > 1000:
        kept = {r.doc_id for r in sd.survivors(prints).collect()}
        assert set(range(300)) <= kept and len(kept) <= 300 + 0.03 * 440


def test_a_full_node_leaves_out_no_pair(spark, words):
    """One trie, whose node is cut into many: what is linked is what one whole node links."""
    import random

    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(90)]
    for i in range(90):  # pairs, and a group in which others than the nearest link
        for _ in range(1 if i % 3 else 2):
            t = texts[i].split()
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    for i in range(60):
        t = texts[0].split()
        for _ in range(rng.randrange(8)):
            t[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    assert sd.tries_for(len(texts))[0] <= 1
    raw = sd.node_of(pa.array(texts), pa.array(range(len(texts))))
    wide, many = sd.parts_of(raw)[0], len(texts)
    path = np.packbits(np.unpackbits(wide.view(np.uint8), axis=1)[:, sd.tries_for(many)[1][0]], axis=1)
    near = lambda x, most: np.bitwise_count(x[:, None] ^ x[None]).sum(2, dtype=np.int64) <= most
    linked = near(wide, sd.REACH) & near(path, sd.PATH_REACH)
    label = sd.united(np.arange(many), *np.nonzero(linked))
    for node in (12, 100, 20_000):
        root = {bytes(r.fp): bytes(r.root) for r in sd.labelled(sd.near_links(spark.createDataFrame([(x,) for x in raw.to_pylist()], "fp binary"), node)).collect()}
        of = [root.get(x, x) for x in raw.to_pylist()]
        assert len(set(zip(of, label.tolist()))) == len(set(of)) == len(set(label.tolist())), node


@pytest.mark.parametrize("block", [2048, 20])
def test_verified_links_connect_all_that_is_near(spark, words, block):
    """Texts of one group around the threshold, of which many are no near copy of the one that has most pairs."""
    import random

    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(12)
    base = [rng.choice(words) for _ in range(100)]
    texts = [" ".join(base)]
    for _ in range(119):
        t = rng.choice(texts).split()
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = [r.h for r in docs.select("doc_id", sd.text_hash().alias("h")).orderBy("doc_id").collect()]
    raw = sd.node_of(pa.array(texts), pa.array(hashes)).to_pylist()
    pairs = spark.createDataFrame([(raw[i], raw[0], hashes[i], hashes[0]) for i in range(1, len(raw))], "fp binary, root binary, h long, root_h long")
    root = {bytes(r.fp): bytes(r.root) for r in sd.labelled(sd.verified(pairs, docs, block)).collect()}
    wide, sets = sd.parts_of(pa.array(raw))[0], [near_shingles(t) for t in texts]
    u, v = np.nonzero(np.bitwise_count(wide[:, None] ^ wide[None]).sum(2, dtype=np.int64) <= sd.REACH)
    like = np.array([len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(u, v)])
    label = sd.united(np.arange(len(raw)), u[like], v[like])
    of = [root.get(x, x) for x in raw]
    assert len(set(label.tolist())) > 3
    assert len(set(zip(of, label.tolist()))) == len(set(of)) == len(set(label.tolist()))


def test_no_document_goes_without_a_verified_link(spark):
    """Texts around the threshold: each that goes is connected with the one that stays by links of 0.8 or more."""
    import random

    rng, rows = random.Random(11), []
    for g in range(60):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(rng.choice([30, 80, 200]))]
        for k in range(5):
            other = list(base)
            for _ in range(int(len(base) * rng.choice([0.0, 0.01, 0.02, 0.035, 0.05, 0.08]))):
                other[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    rows += [(1000, "twin " * 60 + "one two three four five six"), (1001, "twin " * 60 + "six five four three two one and more"), (1002, None), (1003, " ")]
    kept = {r.doc_id for r in sd.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: near_shingles(t) for i, t in rows}
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    group = {i: i for i, _ in rows}
    for i, _ in rows:
        for j, _ in rows:
            if j < i and like(i, j):
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    gone = {i for i, _ in rows} - kept
    assert all(group[i] in {group[k] for k in kept} for i in gone) and gone
    assert {1000, 1001, 1002} <= kept and 1003 in gone  # repeats weigh in fingerprints, not in sets
    assert len(kept) - len(set(group.values())) <= 0.03 * len(gone)


def test_survivors(spark, docs, rows):
    kept = sd.survivors(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert len(got) == len(set(got))
    prints = [near_shingles(r[1]) for r in rows]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(rows):  # each document is kept or has a near copy that is; those without a near copy are kept
        near = [q for j, q in enumerate(rows) if like(prints[i], prints[j]) >= 0.8]
        assert any((str(q[0]), q[1] or "") in got for q in near), r
        if all(like(prints[i], p) < 0.5 or p is prints[i] for p in prints):
            assert (str(r[0]), r[1] or "") in got, r


def test_survivors_with_clashing_names(spark, docs):
    from pyspark.sql import functions as F

    names = ["__fp", "__id", "__own", "fp", "root", "head", "path", "a.b", "s", "n"]
    wide = docs.select("doc_id", "text", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    for df in (wide, wide.where("doc_id is not null").dropDuplicates(["doc_id"])):
        out = sd.survivors(df)
        assert out.columns == df.columns and out.count()
        for r in out.collect():
            assert all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for n in names)


def test_empty(none):
    assert sd.report(none).count() == 0 and sd.survivors(none).count() == 0
