import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions import similarity


def matched(a: str, b: str) -> int:
    """The definition: the longest block, of equals the one first in a and then in b, and what is left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
    n, i, j = best[0], -best[1], -best[2]
    return n + matched(a[:i], b[:j]) + matched(a[i + n :], b[j + n :]) if n else 0


def likeness(word: str, other: str) -> float:
    both = len(word) + len(other)
    return 2.0 * matched(other, word) / both if both else 1.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcé漢", max_size=12), st.text("abcé漢", max_size=12)), max_size=20))
def test_by_the_definition(pairs):
    assert similarity.ratios([p[0] for p in pairs], [p[1] for p in pairs]).tolist() == [likeness(*p) for p in pairs]


def test_many_pairs_of_unlike_sizes_and_against_another_library():
    rng = random.Random(3)
    say = lambda most: "".join(rng.choice("abcdel") for _ in range(rng.randint(0, most)))
    pairs = [(say(25), say(25)) for _ in range(3000)] + [(say(190), say(150)) for _ in range(20)] + [("", ""), ("a", ""), ("x" * 150, "x" * 150)]
    assert similarity.ratios([p[0] for p in pairs], [p[1] for p in pairs]).tolist() == [difflib.SequenceMatcher(None, b, a).ratio() for a, b in pairs]


def test_nearest_is_the_last_in_the_alphabet_of_equals():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcl") for _ in range(rng.randint(1, 8))) for _ in range(300)})
    among, asked = words[::7], words[::3]
    for cutoff in (0.3, 0.55, 0.86):
        assert similarity.nearest(asked, among, cutoff) == [next(iter(difflib.get_close_matches(w, among, 1, cutoff)), None) for w in asked]
    assert similarity.nearest([], among, 0.5) == [] and similarity.nearest(["a"], [], 0.5) == [None]


@pytest.mark.parametrize(
    ("shown", "tag"),
    [("Pany", "Parry"), ("Arrnor Pierced", "Armor Pierced"), ("Eeft Limb", "Left Limb"), ("Overhead", "Overhead"), ("Party", None), ("Combkt", None), ("..", None), ("Zqxj", "Zqxj"), ("Zq4j", None), ("Head", "Head")],
)
def test_tags(shown, tag):
    assert similarity.tags_of([shown]) == [tag]
    assert similarity.tags_of([shown, *X.TAGS, shown])[1:-1] == list(X.TAGS)


def test_columns(spark):
    rows = [("Parry", "Pany"), ("a", None), (None, "b"), ("", ""), ("Parry", "Pany"), ("Head", "Overhead")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(similarity.ratio("a", "b")).collect()]
    assert got == [None if a is None or b is None else likeness(a, b) for a, b in rows]
    body = spark.createDataFrame([("for 5 [Pany][Head] [Head]",), ("none",), (None,)], "s string").select(similarity.tags(F.col("s"))).collect()
    assert [r[0] for r in body] == [["Parry", "Head"], [], []]
