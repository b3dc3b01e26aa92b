import difflib
import random

import pytest

from gleaner.config import Settings
from gleaner.functions.similarity import folded
from gleaner.operators import names

COUNTS = "clip_id string, name string, n long, first long"


def cut(full: str, tail: str) -> bool:
    at = full.lower().rfind(tail.lower())
    return full[at].islower() if at > 0 else tail[:1].islower()


def fold(counts, cfg):
    """One clip's names taken one after the other, by the rules."""
    counts = sorted(counts, key=lambda c: (-c[1], c[2], c[0]))
    fair = [c for c in counts if c[1] >= cfg.anchor_min] or counts[:1]
    kept = []
    for name, n, _ in fair:
        key = folded(name)
        much = any(difflib.SequenceMatcher(None, folded(k), key).ratio() >= cfg.anchor_fold for k, _ in kept)
        piece = any(m >= n * cfg.fragment_ratio and (folded(k).startswith(key) or folded(k).endswith(key) and cut(k, name)) for k, m in kept)
        if not much and not piece:
            kept.append((name, n))
    of = {folded(a): a for a in (cfg.roster or [k for k, _ in kept])}
    out = {}
    for name, _, _ in counts:
        near = [(difflib.SequenceMatcher(None, k, folded(name)).ratio(), k) for k in of]
        best = max((x for x in near if x[0] >= cfg.name_cutoff), default=None)
        out[name] = of.get(folded(name)) or (of[best[1]] if best else None)
    return kept, out


def made_up(seed: int, clips: int, size: int):
    """Names and misreadings of them: letters swapped, ends lost, fronts lost, capitals within."""
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abelmorstrni") for _ in range(n))
    rows = []
    for c in range(clips):
        true = [say(rng.randint(3, 7)).capitalize() + (say(rng.randint(3, 6)).capitalize() if rng.random() < 0.4 else "") for _ in range(size)]
        read = {}
        for name in true:
            read[name] = rng.choice([1, 2, 3, 5, 20, 60])
            for _ in range(rng.randint(0, 4)):
                i, kind = rng.randrange(len(name)), rng.random()
                other = name[:i] + rng.choice("abcloO01mxz") + name[i + 1 :] if kind < 0.5 else name[: 3 + i] if kind < 0.7 else name[-3 - i :]
                read[other] = rng.choice([1, 1, 2, 3, 4, 12])
        read = {k: n for k, n in read.items() if folded(k)}
        order = list(range(len(read)))
        rng.shuffle(order)
        rows += [(f"c{c}", k, n, order[i] if rng.random() < 0.9 else 7) for i, (k, n) in enumerate(read.items())]
    return rows


@pytest.mark.parametrize("cfg", [Settings(), Settings(name_cutoff=0.7, anchor_fold=0.75, fragment_ratio=2), Settings(anchor_min=100), Settings(roster=("Ramble", "Stone", "Rarnble", "Elmo"))])
def test_as_the_sequential_fold(spark, cfg):
    rows = made_up(len(cfg.roster) + cfg.anchor_min, 6, 25)
    got = {}
    for r in names.name_map(spark.createDataFrame(rows, COUNTS), cfg).collect():
        got.setdefault(r["clip_id"], {})[r["reading"]] = r["canonical"]
    want = {c: fold([(k, n, f) for clip, k, n, f in rows if clip == c], cfg)[1] for c in {r[0] for r in rows}}
    assert got == want


def test_anchors_of_a_clip_of_many_players(spark):
    from gleaner.functions import text
    from pyspark.sql import functions as F

    rows = [("c", k, n, i) for i, (_, k, n, _) in enumerate(made_up(5, 1, 400))]
    rows = list({r[1]: r for r in rows}.values())
    found = names.anchors(spark.createDataFrame(rows, COUNTS).withColumn("key", text.norm(F.col("name"))))
    assert {r["canonical"] for r in found.collect()} == {k for k, _ in fold([r[1:] for r in rows], Settings())[0]}


def test_no_pair_that_is_alike_is_missed(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcl") for _ in range(rng.randint(1, 9))) for _ in range(250)})
    df = spark.createDataFrame([("c", w) for w in words], "clip_id string, word string")
    for cutoff in (0.55, 0.8, 0.86, 1.0):
        got = {(r["word"], r["other"]): r["ratio"] for r in names.alike(df, df.withColumnRenamed("word", "other"), cutoff).collect()}
        every = {(a, b): difflib.SequenceMatcher(None, b, a).ratio() for a in words for b in words}
        assert got == {p: x for p, x in every.items() if x >= cutoff}


def test_a_long_chain_is_settled_in_rounds(spark):
    nodes = spark.createDataFrame([("c", f"n{i}") for i in range(7)] + [("d", "x")], "clip_id string, name string")
    edges = spark.createDataFrame([("c", f"n{i + 1}", f"n{i}") for i in range(6)], "clip_id string, name string, by string")
    assert {r["name"] for r in names.first_independent(nodes, edges).collect()} == {"n0", "n2", "n4", "n6", "x"}


def test_no_names(spark):
    assert names.name_map(spark.createDataFrame([], COUNTS)).count() == 0
