import pytest
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.config import Settings
from gleaner.operators import clock, names, prune, runs, settle, statistics


def reading(seq, ft=None, t=None, amount=5, fighter="Ith", exact=False, flags=(), dir="in", kind="hit", raw=None, pass_=0, clip="c", wall=None):
    who, target = (fighter, "You") if dir == "in" else ("You", fighter)
    return (clip, seq, pass_, ft, wall, float(ft if t is None else t), exact, kind, dir, who, target, fighter, amount, None, list(flags), raw or f"raw{seq}")


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.READING)


def folded(spark, rows, cfg=Settings()):
    return sorted(runs.events(frame(spark, rows), cfg).collect(), key=lambda r: (r.t, r.amount))


def test_a_gap_of_just_the_span_does_not_break(spark):
    got = folded(spark, [reading(0, 0.0), reading(1, 12.0), reading(2, 24.5)])
    assert [(e.t, e.seen, e.span, e.last) for e in got] == [(0.0, 2, 12.0, 12.0), (24.5, 1, 0.0, 24.5)]


@pytest.mark.parametrize("gap, n", [(20.0, 1), (24.0, 1), (24.5, 2)])
def test_a_run_adrift_rejoins(spark, gap, n):
    got = folded(spark, [reading(0, 5.0, t=5.0, exact=True), reading(1, 5.0 + gap)])
    assert len(got) == n


def test_a_common_second_rejoins_over_any_gap(spark):
    assert len(folded(spark, [reading(0, 5.0, t=5.0, exact=True), reading(1, 305.0, t=5.2, exact=True)])) == 1
    assert len(folded(spark, [reading(0, 5.0, t=5.0, exact=True), reading(1, 305.0, t=305.0, exact=True)])) == 2


@pytest.mark.parametrize("double, n", [(3.0, 2), (1.5, 1)])
def test_copies_witness_a_line(spark, double, n):
    rows = [reading(0, 0.0), reading(1, double, raw="a"), reading(2, double, raw="b")]
    got = folded(spark, rows)
    assert [e.t for e in got] == [0.0, 3.0][:n] and sum(e.seen for e in got) == 3


def test_copies_of_two_passes_are_one(spark):
    assert len(folded(spark, [reading(0, 3.0, pass_=0), reading(1, 3.0, pass_=1), reading(2, 0.0)])) == 1


def test_half_even_seconds(spark):
    cfg = Settings()
    two = folded(spark, [reading(0, 1.5, t=1.5, exact=True), reading(1, 2.5, t=2.5, exact=True)], cfg)
    assert len(two) == 1
    assert len(folded(spark, [reading(0, 2.5, t=2.5, exact=True), reading(1, 3.5, t=3.5, exact=True)], cfg)) == 2
    apart = [reading(0, 1.5, t=1.5, exact=True, wall=100.0), reading(1, 2.5, t=2.5, exact=True, wall=101.0)]
    assert len(folded(spark, apart, Settings(exact_second_key=True))) == 2


def test_timed_lines_take_the_nearest_readings(spark):
    rows = [reading(0, 0.0, t=0.0, exact=True), reading(1, 1.0, t=6.0, exact=True), reading(2, 1.0), reading(3, 2.0), reading(4, 5.0)]
    got = folded(spark, rows)
    assert [(e.t, e.seen) for e in got] == [(0.0, 3), (6.0, 2)]


def test_known_tags_win(spark):
    rows = [reading(i, float(i) / 2, flags=["Left Pierced"]) for i in range(12)] + [reading(20 + i, 6.0 + i, flags=["Left Limb", "Armor Pierced"], raw="x") for i in range(3)]
    assert list(folded(spark, rows)[0].flags) == ["Left Limb", "Armor Pierced"]


def test_ties_go_to_the_first_met(spark):
    rows = [reading(0, 1.0, flags=["Head"]), reading(1, 0.5, flags=["Torso"]), reading(2, 2.0, flags=["Head"]), reading(3, 2.5, flags=["Torso"])]
    assert list(folded(spark, rows)[0].flags) == ["Torso"]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(551, 1, 0), (55, 5, 1)], {55: 6}),
        ([(551, 1, 0), (55, 1, 1)], {551: 1, 55: 1}),
        ([(401, 3, 0), (40, 37, 1)], {40: 40}),
        ([(401, 3, 0), (40, 6, 1)], {401: 3, 40: 6}),
        ([(5, 1, 0), (7, 20, 1)], {5: 1, 7: 20}),
        ([(551, 1, 0), (55, 5, 13)], {551: 1, 55: 5}),
    ],
)
@pytest.mark.parametrize("how", ["fold", "join"])
def test_settling(spark, rows, want, how):
    made, seq = [], 0
    for amount, n, at in rows:
        for _ in range(n):
            made.append(reading(seq, float(at), amount=amount))
            seq += 1
    df = frame(spark, made)
    out = settle.settled(df) if how == "fold" else settle.settled_by_join(df)
    assert {r.amount: r["count"] for r in out.groupBy("amount").count().collect()} == want


def test_unknown_is_settled_among_all(spark):
    rows = [reading(0, 1.0, amount=191, fighter="Unknown")] + [reading(i, 2.0, amount=19, dir="out") for i in range(1, 4)]
    assert {r.amount for r in settle.settled(frame(spark, rows)).collect()} == {19}


def events(spark, rows):
    df = frame(spark, [reading(i, t, amount=a, fighter=f, exact=True, flags=g, t=t) for i, (t, a, f, g, _, _, _) in enumerate(rows)])
    more = spark.createDataFrame([(i, s, float(sp), float(la)) for i, (*_, s, sp, la) in enumerate(rows)], "seq long, seen long, span double, last double")
    return df.join(more, "seq").select(*df.columns, "seen", "span", "last")


def test_nameless_copies(spark):
    df = events(spark, [(30.0, 19, "Unknown", [], 1, 0, 0), (42.0, 19, "Ith", [], 1, 0, 0), (60.0, 7, "Unknown", [], 1, 0, 0), (72.1, 7, "Ith", [], 1, 0, 0)])
    assert sorted(r.t for r in prune.without_nameless_copies(df).collect()) == [42.0, 60.0, 72.1]


def test_twins(spark):
    df = events(spark, [(1.0, 21, "Ith", ["Torso"], 17, 0, 0), (1.0, 24, "Ith", ["Torso"], 4, 0, 0), (2.0, 21, "Ith", [], 8, 0, 0), (2.0, 24, "Ith", [], 4, 0, 0)])
    assert sorted((r.t, r.amount) for r in prune.without_twins(df).collect()) == [(1.0, 21), (2.0, 21), (2.0, 24)]


def test_upper_median_and_floor(spark):
    for values, middle, floor in [([1, 2, 3, 4], 3, 1), ([23], 23, 2), ([7], 7, 1), ([2], 2, 1), ([40, 60], 60, 2)]:
        df = spark.createDataFrame([("c", v) for v in values], "k string, seen long")
        r = statistics.noise_floor(df, ("k",), "seen").first()
        assert (r.typical, r.floor) == (middle, floor)


def test_noise(spark):
    rows = [(float(i), 10 + i, "Ith", [], 30, 8, float(i)) for i in range(5)] + [(6.0, 50, "Ith", [], 1, 2, 6.0), (7.0, 51, "Ith", [], 1, 1, 7.0)]
    last = spark.createDataFrame([("c", 99.0)], "clip_id string, ends double")
    assert sorted(r.amount for r in prune.without_noise(events(spark, rows), last).collect()) == [10, 11, 12, 13, 14, 50]


def test_clip_range(spark):
    df = events(spark, [(15.0, 1, "Ith", [], 1, 0, 0), (15.1, 2, "Ith", [], 1, 0, 0), (-0.1, 3, "Ith", [], 1, 0, 0)])
    clips = spark.createDataFrame([("c", "p", 1, 1, 10.0)], schema.CLIPS)
    assert [r.amount for r in prune.in_clip(df, clips).collect()] == [1]


def test_clock_through_midnight(spark):
    wall = [86398.0, 1.0, 2.0, 3.0]
    rows = [reading(i, ft, t=w, exact=True, amount=i) for i, (w, ft) in enumerate(zip(wall, [0.0, 3.0, 4.0, 5.0], strict=True))] + [reading(9, 4.0)]
    got = {r.seq: r.t for r in clock.aligned(frame(spark, rows)).collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 4.0, 3: 5.0, 9: 4.0}


def test_two_recordings(spark):
    rows = [reading(i, float(i), t=1000.0 + i, exact=True, amount=i) for i in range(5)] + [reading(10 + i, 10.0 + i, t=3000.0 + i, exact=True, amount=i) for i in range(4)]
    rows += [reading(30, 6.0, t=1040.0, exact=True, amount=77)]
    got = {r.seq: r.t for r in clock.aligned(frame(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [0, 1, 2, 3, 4] and [got[10 + i] for i in range(4)] == [10, 11, 12, 13] and got[30] == 40.0


def test_nearest_centre_ties_go_low(spark):
    df = spark.createDataFrame([(5.0, [0.0, 10.0]), (5.1, [0.0, 10.0])], "v double, c array<double>")
    assert [r[0] for r in df.select(statistics.nearest_of(F.col("v"), F.col("c"))).collect()] == [0.0, 10.0]


@pytest.mark.parametrize(
    "counts, want",
    [
        ({"Qlade": 20, "Qiade": 4}, {"Qlade": "Qlade", "Qiade": "Qlade"}),
        ({"CLAUDEMASTER": 30, "CLAUDEMASrER": 10}, {"CLAUDEMASTER": "CLAUDEMASTER", "CLAUDEMASrER": "CLAUDEMASTER"}),
        ({"Troglodooty": 65, "dooty": 3}, {"Troglodooty": "Troglodooty", "dooty": "Troglodooty"}),
        ({"AkYabanBloodletter": 50, "Bloodletter": 5}, {"AkYabanBloodletter": "AkYabanBloodletter", "Bloodletter": "Bloodletter"}),
        ({"FatherofBones": 50, "Father": 5}, {"FatherofBones": "FatherofBones", "Father": "FatherofBones"}),
        ({"Unknown": 2, "Soowon": 10}, {"Unknown": None, "Soowon": "Soowon"}),
        ({"Ith": 1}, {"Ith": "Ith"}),
    ],
)
def test_name_map(spark, counts, want):
    rows = [reading(i * 1000 + k, 1.0, fighter=n) for i, (n, c) in enumerate(counts.items()) for k in range(c)]
    got = {r.reading: r.canonical for r in names.name_map(names.frequencies(frame(spark, rows))).collect()}
    assert got == want


def test_roster(spark):
    rows = [reading(0, 1.0, fighter="Bigil0"), reading(1, 1.0, fighter="Zzaxy")]
    got = {r.seq: r.fighter for r in names.canonical(frame(spark, rows), Settings(roster=("Bigilo",))).collect()}
    assert got == {0: "Bigilo", 1: None}
