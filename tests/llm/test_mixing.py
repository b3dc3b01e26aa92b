import numpy as np
import pytest

from gleaner.llm import mixing as m


@pytest.mark.parametrize(
    "sizes, want",
    [
        ({"a": 100, "b": 100, "c": 100}, {"a": 50, "b": 100, "c": 150}),
        ({"a": 1, "b": 299, "c": 0, None: 0}, {"a": 3, "b": 297, "c": 0, None: 0}),
        ({"a": 1000, "b": 10, None: 10}, {"a": 960, "b": 30, None: 30}),
        ({}, {}),
        ({"a": 0}, {"a": 0}),
    ],
)
def test_targets(sizes, want):
    assert m.targets(sizes) == pytest.approx(want)


def test_splitting_tree():
    rng = np.random.default_rng(1)
    for quotas in ([100, 7, 0, 1], [0, 0], [3], [1, 1, 1]):
        have = m.split(np.array(quotas), 8, rng)
        assert (have.sum(0) == quotas).all() and have.sum(1).max() - have.sum(1).min() <= 1 and (have >= 0).all()


def test_splitting_is_unbiased():
    have = np.mean([m.split(np.array([60, 40]), 4, np.random.default_rng(i)) for i in range(400)], axis=0)
    assert np.allclose(have, [[15, 10]] * 4, atol=0.6)


def test_report(docs, rows):
    got = m.report(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, biggest = {}, {}, max(r.size for r in got)
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = m.targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= biggest for s in sizes)
    key = lambda x: sorted(map(str, x))
    assert key(m.report(docs).collect()) == key(got)


@pytest.mark.parametrize("blocks", [5, m.BLOCKS])
def test_draws_against_brute_force(docs, blocks):
    """Draws, source by source: blocks over and over while they fit, then the one left that comes nearest."""
    rows = m.sized(docs, blocks)
    words, taken = {}, {}
    for r in rows.collect():
        words.setdefault(r.source, {}).setdefault(r.block, 0)
        words[r.source][r.block] += r.size
    want = m.targets({s: sum(w.values()) for s, w in words.items()})
    for s, of in words.items():
        left, order = want[s], [(turn, b) for turn in range(m.MOST) for b in sorted(of)]
        while sum(of.values()) and order and of[order[0][1]] <= left:
            left -= of[order[0][1]]
            taken[s, order[0][1], order.pop(0)[0]] = 1
        if sum(of.values()) and order:
            turn, b = min((x for x in order if x[0] == order[0][0]), key=lambda x: abs(of[x[1]] - left))
            if abs(of[b] - left) < left:
                taken[s, b, turn] = 1
    draws, _ = m.plan(rows)
    got = [(r.source, r.block, r["pass"]) for r in draws.collect()]
    assert len(got) == len(set(got)) and set(got) == set(taken)


def test_mix_has_the_draws(docs):
    times = {}
    for r in m.report(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + (r.taken // r.size if r.size else 0)
    out = m.mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        if r.text and r.text.split():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v}


def test_tasks_grow_with_the_words(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 4).alias("shard"), F.xxhash64("id").alias("place"))
    out = m.dealt(rows, 40_000, 4, "shard", "place", part=100, task=1000)
    counts = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.rdd.getNumPartitions() == 41 and sum(counts) == 5000 and max(counts) < 500
    few = m.dealt(rows, 40_000, 4, "shard", "place", part=100)
    assert sorted(r.id for r in few.collect()) == list(range(5000))


def test_empty(none):
    assert m.report(none).count() == 0 and m.mix(none).count() == 0


def test_mix_leaves_the_columns_of_its_input_alone(spark, docs):
    from pyspark.sql import functions as F

    names = ["__block", "__place", "__shard", "__s", "__b", "__pass", "block", "target", "a.b"]
    wide = docs.select("doc_id", "text", "source", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    out = m.mix(wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert got and all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for r in got for n in names)


def test_whole_texts_move_once_unless_draws_are_too_many(spark, docs, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = m.mix(docs)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")[0]
        want = sorted(map(str, few.collect()))
        monkeypatch.setattr(m, "SENT", 0)
        many = m.mix(docs)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")[0]
        assert sorted(map(str, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
