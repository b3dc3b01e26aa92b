"""How much of a table travels: steps pass on the rows that they need, and as many as the input has in parts that don't grow."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.config import Settings
from gleaner.operators import prune, runs, settle
from gleaner.plans import likeness, reconstruct, report

COMPANY = "clip_id string, seq long, t double, kind string, dir string, fighter string, amount int, flags array<string>"


def company(spark):
    """A clip of 300 readings of amounts that are like no other, and one with a number that yields to its neighbour."""
    rows = [("plain", i, float(i), "hit", "in", "Ith", 1000 * (1 + i % 3), []) for i in range(300)]
    return spark.createDataFrame([*rows, ("odd", 0, 1.0, "hit", "in", "Ith", 41, []), ("odd", 1, 1.0, "hit", "in", "Ith", 47, []), ("odd", 2, 2.0, "hit", "in", "Ith", 47, [])], COMPANY)


def counted(monkeypatch, module):
    """Rows of each table that a module writes between stages."""
    written, staged = [], module.staged

    def told(df):
        out = staged(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(module, "staged", told)
    return written


def test_settling_passes_on_what_may_change_alone(spark, monkeypatch):
    written = counted(monkeypatch, settle)
    got = {(r.clip_id, r.seq): r.amount for r in settle.settled(company(spark)).collect()}
    assert got[("odd", 0)] == 47 and sum(v == 47 for v in got.values()) == 3 and len(got) == 303
    assert max(written) <= 5


def test_the_band_join_meets_what_may_change_alone(spark, monkeypatch):
    written = counted(monkeypatch, settle)
    got = settle.settled_by_join(company(spark))
    assert got.where("clip_id = 'odd'").select("amount").distinct().collect() == [(47,)] and got.count() == 303
    assert max(written) <= 5


def test_the_band_join_is_dealt_out_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(settle, "TASK_ROWS", 10)
    assert {r.amount for r in settle.settled_by_join(company(spark)).where("clip_id = 'odd'").collect()} == {47}
    parts = []
    repartition = type(company(spark)).repartition
    monkeypatch.setattr(type(company(spark)), "repartition", lambda self, n, *cols: parts.append(n) or repartition(self, n, *cols))
    settle.settled_by_join(company(spark))
    assert parts == [31]


def test_signs_and_repeated_orders_in_the_band_join(spark):
    rows = [("c", 0, 1.0, 5, []), ("c", 0, 1.0, 900, []), ("c", 1, 1.0, -5, []), ("c", 2, 1.0, -5, [])]
    df = spark.createDataFrame(rows, "k string, seq long, t double, amount int, flags array<string>")
    assert sorted(r.amount for r in settle.settled_by_join(df, company=["k"]).collect()) == [-5, -5, -5, -5]


def lone(spark):
    """Readings that stand alone: timed or not, without a time of their frame or of the clip, without a direction, with tags."""
    rows = []
    for i in range(64):
        ft = None if i % 5 == 0 else 100.0 * i + 0.25
        t = None if i % 7 == 0 and ft is not None else 100.0 * i + 0.75
        way = (None, "in", "out")[i % 3]
        rows.append((f"c{i % 4}", i, i % 2, ft, 5.0 if i % 6 == 0 else None, t, i % 4 == 0, "hit", way, "Ith", "You", "Ith", i, None, ["Torso", "odd"][: i % 3], f"raw{i}"))
    return spark.createDataFrame(rows, schema.READING)


@pytest.mark.parametrize("cfg", [Settings(), Settings(exact_second_key=True)])
def test_stretches_of_one_reading_are_events_as_merged(spark, cfg):
    df = runs.rejoined(runs.stretches(lone(spark), cfg), runs.HIT, 24.0)
    assert df.where("not alone").isEmpty()
    got, want = runs.single(df), runs.merged(df, cfg)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_stretches_of_several_readings_are_summed_up(spark, monkeypatch):
    met, nearest = [], runs.nearest_line

    def told(readings, *rest):
        met.append(readings.count())
        return nearest(readings, *rest)

    monkeypatch.setattr(runs, "nearest_line", told)
    several = lone(spark).where("seq = 1").withColumn("seq", F.explode(F.array(F.lit(201), F.lit(202)).cast("array<long>"))).withColumn("amount", F.lit(777))
    assert runs.events(lone(spark).unionByName(several)).count() == 64 + 1
    assert met == [2]


def broken(spark, seed):
    """Readings of runs that show seconds of runs before them, or none, with breaks on both sides of the horizon."""
    rng, rows = random.Random(seed), []
    for fighter in ("Ith", "Karyna", "Zork", "Zork2"):
        at = 0.0
        for i in range(120):
            at += rng.choice([1.0, 13.0, 20.0, 24.0, 25.0, 60.0])
            t = float(rng.choice([at, at - 20, at - 70, 5.0])) if fighter != "Zork2" else at
            rows.append(("c", len(rows), i % 2, at, None, t, rng.random() < (0.5 if fighter != "Zork" else 0.1), "hit", None if i % 9 else "in", "You", "Ith", fighter, 7, None, [], ""))
    return spark.createDataFrame(rows, schema.READING)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_told_without_a_scan_are_as_scanned(spark, seed):
    df = runs.stretches(broken(spark, seed))
    want = {r.seq: (r.stretch, r.alone) for r in runs.rejoined(df, runs.HIT, 24.0).collect()}
    told = runs.apart(df).collect()
    known = {r.seq: (r.stretch, r.alone) for r in told if r.stretch is not None}
    assert len(told) == 480 and 50 < len(known) < 430 and known == {k: want[k] for k in known}
    rest = runs.rejoined(runs.apart(df).where("stretch is null").drop("stretch", "alone"), runs.HIT, 24.0).collect()
    assert known | {r.seq: (r.stretch, r.alone) for r in rest} == want
    assert len({r.key for r in told}) == len({(r.dir, r.fighter, r.run) for r in told})


def test_only_runs_that_may_be_joined_are_scanned(spark, monkeypatch):
    met, rejoined = [], runs.rejoined

    def told(df, *rest):
        met.append(df.count())
        return rejoined(df, *rest)

    monkeypatch.setattr(runs, "rejoined", told)
    linked = [("c", 900 + i, 0, at, None, 5.0, True, "hit", "in", "Ith", "You", "Ith", 777, None, [], "") for i, at in enumerate((5.0, 50.0, 51.0))]
    assert runs.events(lone(spark).unionByName(spark.createDataFrame(linked, schema.READING))).count() == 64 + 1
    assert met == [3]


def test_copies_are_not_dealt_out_one_by_one(spark):
    most = 2**31 - 1
    frames = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 2), ("a", 9.0, most), ("a", 10.0, most), ("b", 4.0, 1)], "key string, at double, n long")
    known = spark.createDataFrame([("b", 4.0)], "key string, at double")
    assert sorted(map(tuple, runs.copies(frames, known, "key").collect())) == [("a", 1.0), ("a", 9.0)]


def test_the_summary_of_judged_events_is_that_of_the_events_left_out(spark):
    rows = [(f"c{i % 3}", float(i), ("in", "out")[i % 2], "hit", f"f{i % 5}", i, float(i), 1 + i % 4 * 4, i % 7 / 2, i % 8 == 0) for i in range(60)]
    events = spark.createDataFrame([*rows, *rows[:9]], "clip_id string, t double, dir string, kind string, fighter string, amount int, last double, seen long, span double, exact boolean")
    log = spark.createDataFrame([(f"c{i % 4}", i // 8, i * 1.0) for i in range(80)], "clip_id string, frame_no int, ft double")
    ends = log.groupBy("clip_id").agg(F.max("ft").alias("ends"))
    kept = prune.without_noise(events, ends)
    want = report.summary(log, log, events, kept).join(report.dropped(events, kept), "clip_id", "left")
    lines = log.groupBy("clip_id").agg(F.count_distinct("frame_no").alias("frames"), F.count("*").alias("lines"), F.count("*").alias("readings"))
    got = report.judged_summary(lines, prune.judged(events, ends))
    assert 0 < kept.count() < 69 and got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_parts_meet_before_their_words_are_dealt_out(spark, tmp_path):
    rows = [(0, "large ring", "Brand#7", "LARGE"), (1, "hot iron bolt", "Brand#16", "SMALL"), (2, None, "Brand#1", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    df = likeness.likeness_pairs(spark, str(tmp_path))
    assert [(r.p_partkey, r["at"], r.word, r.other) for r in df.orderBy("p_partkey", "at").collect()] == [
        (1, 0, "hot", "large"), (1, 1, "iron", "ring"), (1, 2, "bolt", "Brand#7"), (1, 3, "Brand#16", "LARGE"), (2, 0, "Brand#1", "hot"),
    ]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_settled_readings_are_not_stored_before_the_runs(spark, monkeypatch):
    written = counted(monkeypatch, reconstruct)
    lines = [("c", i, i / 2, 0, 0, f"[10:00:0{i // 2}] You hit Bigilo for 5{i % 2}") for i in range(8)]
    ocr = spark.createDataFrame(lines, schema.OCR_LINES)
    clips = spark.createDataFrame([("c", 60.0)], "clip_id string, duration double")
    assert reconstruct.events(ocr, clips).count() > 0
    assert len(written) == 5
