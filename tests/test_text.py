import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions import similarity, text
from gleaner.operators import lines

AMOUNTS = [
    ("for 4S[Torso]", 45), ("for 1'8[Torso]", 18), ("for 225Arms]", 22), ("for 34Vorso]", 34), ("for 641 Torso]", 64), ("for 48 Torso]", 48),
    ("for 120041.5;", None), ("forz33", 33), ("forQ3", 3), ("forZf", 2), ("for S6", 56), ("for O[Torso]", 0), ("hit youfor 26", 26), ("for 40l", 401),
    ("for 551", 551), ("for818", 818), ("for 22Legs]", None), ("for 30Impale]", 301), ("nothing", None), ("", None), ("for 5", 5),
]

LINES = [
    ("[20:17:17] You hit Bigilo for 45[Torso]", (73037.0, "hit", "out", "You", "Bigilo", 45, None, ["Torso"])),
    ("Youhit Soowonfor 61[Torso]", (None, "hit", "out", "You", "Soowon", 61, None, ["Torso"])),
    ("Your Corrupt hit Bigilo for 12", (None, "hit", "out", "You", "Bigilo", 12, "Corrupt", [])),
    ("Karyna's Lesser Heal heals you for 24", (None, "heal", "in", "Karyna", "You", 24, "Lesser Heal", [])),
    ("Lesser Heal heals you for 24", (None, "heal", "in", "Unknown", "You", 24, "Lesser Heal", [])),
    ("Ith's arrow hit you for 19", (None, "hit", "in", "Ith", "You", 19, "arrow", [])),
    ("ALADIM:s Outburst hit you for 9", (None, "hit", "in", "ALADIM", "You", 9, "Outburst", [])),
    ("CTOUKhits you for 24[Torso]", (None, "hit", "in", "CTOUK", "You", 24, None, ["Torso"])),
    ("Terror Bird deeply bites you for 31[Torso]", (None, "hit", "in", "TerrorBird", "You", 31, None, ["Torso"])),
    ("Soowon hit you for 6", (None, "hit", "in", "So", "You", 6, "owon", [])),
    ("99:99:99 You hit Bob for 5[Head]", (None, "hit", "out", "You", "Bob", 5, None, ["Head"])),
    ("You heal Bob for 11", (None, "heal", "out", "You", "Bob", 11, None, [])),
    ("your Lesser Heal heals Bob for 12", (None, "heal", "out", "You", "Bob", 12, "Lesser Heal", [])),
    ("You see a tree", None),
]


def test_amounts(spark):
    df = spark.createDataFrame(AMOUNTS, "body string, want int")
    assert [r for r in df.withColumn("got", text.amount(F.col("body"))).collect() if r.got != r.want] == []


def test_grammar(spark):
    df = spark.createDataFrame([("c", i, 10.0, 0, 0, raw) for i, (raw, _) in enumerate(LINES)], schema.OCR_LINES)
    got = {r.raw: r for r in lines.parsed(df).collect()}
    for raw, want in LINES:
        if want is None:
            assert raw not in got
        else:
            r = got[raw]
            assert (r.wall_s, r.kind, r.dir, r.who, r.target, r.amount, r.ability, list(r.flags)) == want
            assert r.t == (r.wall_s if r.exact else 10.0) and r.fighter == (r.who if r.dir == "in" else r.target)


@pytest.mark.parametrize(
    "shown, tag",
    [("Pany", "Parry"), ("Par1.y", "Parry"), ("Arrnor Pierced", "Armor Pierced"), ("Eeft Limb", "Left Limb"), ("Overhead", "Overhead"), ("Underhew", "Underhew"), ("Combkt", None), ("party", None), ("Zqx.w", None)],
)
def test_tags(shown, tag):
    assert similarity.tag_of(shown) == tag


def test_first_distinct_line(spark):
    rows = [("c", 1, 0.0, 0, 0, "a  b"), ("c", 1, 0.0, 0, 1, "a b "), ("c", 1, 0.0, 1, 0, "a b"), ("c", 2, 0.5, 0, 0, "a b"), ("c", 1, 0.0, 1, 1, "x")]
    got = lines.first_distinct(spark.createDataFrame(rows, schema.OCR_LINES)).collect()
    assert sorted((r.frame_no, r["pass"], r.line_no, r.raw) for r in got) == [(1, 0, 0, "a  b"), (1, 1, 1, "x"), (2, 0, 0, "a b")]


def test_names(spark):
    df = spark.createDataFrame([("Ith'sarrow",), ("Ith'shat",), ("A(b) c-d",), (None,), ("sword",), ("arrows",), ("Helper",), ("Brd",), ("Qiade",)], "n string")
    got = {r.n: r for r in df.select("n", text.tidy_name(F.col("n")).alias("tidy"), text.is_weapon(F.col("n")).alias("w"), text.is_junk(F.col("n")).alias("j"), text.norm(F.col("n")).alias("norm")).collect()}
    assert (got["Ith'sarrow"].tidy, got["Ith'shat"].tidy, got["A(b) c-d"].tidy, got[None].tidy) == ("Ith", "Ith'shat", "Abc-d", "")
    assert not got["sword"].w and got["arrows"].w and got["Helper"].j and got["Brd"].j and got[None].j
    assert got["Qiade"].norm == "qlade" == similarity.folded("Qlade")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="rnclvwy05821ABi'- xyz", max_size=12))
def test_folding_again_changes_only_new_pairs(word):
    once = similarity.folded(word)
    assert set(once) <= set("abcdefghjklmnopqrstuvwxyz")
    assert similarity.folded(once) == once or any(p in once for p in ("rn", "cl", "vv", "vy"))


def test_one_glyph_off_is_the_restricted_distance(spark):
    def off(a, b):
        if len(a) == len(b):
            return len(a) >= 2 and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    n = [str(x) for x in (*range(30), *range(95, 130), 551, 55, 818, 18, 999)]
    df = spark.createDataFrame([(a, b, off(a, b)) for a in n for b in n], "a string, b string, want boolean")
    assert df.where(text.one_glyph_off(F.col("a"), F.col("b")) != F.col("want")).count() == 0
