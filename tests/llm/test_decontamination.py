import random

import pyarrow as pa
import pytest

from gleaner.llm import decontamination as dc


def brute(docs, items, least=0.8):
    out = set()
    for i, t in docs:
        own = dc.shingles(dc.normal_words(t))
        line = b" " + b" ".join(dc.normal_words(t)) + b" "
        for j, u in items:
            w = dc.normal_words(u)
            if not w:
                continue
            s = dc.shingles(w)
            share = len(s & own) / len(s) if len(w) >= dc.SHINGLE else float(b" " + b" ".join(w) + b" " in line)
            if share >= least:
                out.add((i, j, round(share, 9)))
    return out


@pytest.fixture(scope="module")
def case(words):
    rng = random.Random(3)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(j, " ".join(say(n))) for j, n in enumerate([5, 8, 15, 16, 17, 30, 33, 59, 64, 70, 200, 700])] + [(50, "one two three"), (51, None), (52, "")]
    docs = []
    for i in range(40):
        item = items[i % 12][1].split()
        body = say(rng.choice([10, 300, 3000]))
        at = rng.randrange(len(body))
        docs.append((i, " ".join(body[:at] + item + body[at:])))
        lost = [w for k, w in enumerate(item) if k != len(item) // 2]
        docs.append((100 + i, " ".join(body[:at] + lost + body[at:])))
        half = len(item) // 2
        docs.append((200 + i, " ".join(item[:half] + body + item[half:])))
    docs += [(300, "So: ONE, two\nthree!"), (301, None), (302, ""), (303, " ".join(say(20000))), (0, docs[0][1])]
    return docs, items


def test_against_brute_force(spark, case):
    docs, items = case
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in dc.pairs(d, b).collect()}
    assert got == brute(docs, items)
    leaky = {i for i, _, _ in got}
    assert sorted(r.doc_id for r in dc.clean(d, b).collect()) == sorted(i for i, _ in docs if i not in leaky)


def test_blocks_of_items(spark, case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(dc, "ITEM_BYTES", 900)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dc.blocks_of(b))) > 2
    assert {(r.doc_id, r.item_id, r.containment) for r in dc.pairs(d, b).collect()} == brute(docs, items)


@pytest.mark.parametrize("n", [5, 6, 7, 20, 21])
def test_small_items_are_never_missed(words, n):
    rng = random.Random(n)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(n) for _ in range(150)]
    own = dc.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = [" ".join((w if at else []) + say(300) + ([] if at else w) + say(300 * (1 - at))) for w in items for at in (0, 1)]
    leaks = own.leaks(pa.array(texts), 0.8)
    assert all(k // 2 in {i for i, _ in found} for k, found in enumerate(leaks))


def test_scattered_items_are_candidates(words):
    rng = random.Random(9)
    item = [rng.choice(words) for _ in range(60)]
    text = " ".join(w for k in range(0, 60, 12) for w in item[k : k + 12] + [rng.choice(words) for _ in range(400)])
    own = dc.Items([(1, " ".join(item))])
    assert own.leaks(pa.array([text]), 0.5)[0]


def test_clashing_columns_and_empty(spark, docs, none, rows):
    b = spark.createDataFrame([(1, rows[203 - 200 + 68][1])], "item_id long, text string")
    assert dc.clean(docs, b).columns == docs.columns
    assert dc.pairs(none, b).count() == 0 and dc.pairs(docs, b.limit(0)).count() == 0


def test_working_names_of_the_operator_may_be_columns(docs, rows, spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, rows[9][1])], "item_id long, text string")
    wide = docs.select(F.lit("u").alias("__leaks"), "doc_id", "text", F.lit("v").alias("__leaks_"), F.lit("w").alias("a.b"))
    out = dc.clean(wide, items)
    got = out.collect()
    assert out.columns == wide.columns and 9 not in {r.doc_id for r in got}
    assert all((r["__leaks"], r["__leaks_"], r["a.b"]) == ("u", "v", "w") for r in got)
