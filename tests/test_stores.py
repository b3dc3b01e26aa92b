"""Stages, sinks and sources: what is written, replaced, removed and told."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lines, settle
from gleaner.plans import report
from gleaner.sources import readers, sinks, staging


def test_a_run_leaves_nothing(spark):
    with staging.run(spark) as folder:
        df = staging.staged(spark.range(5))
        where = folder.removeprefix("file://")
        assert df.count() == 5 and len(os.listdir(where)) == 1
    assert not os.path.exists(where)
    staging.staged(spark.range(3))
    top = f"{staging.shared_folder(spark)}/gleaner-{spark.sparkContext.applicationId}".removeprefix("file://")
    assert os.listdir(top)


def test_settings_stay(spark):
    before = {r[0]: r[1] for r in spark.sql("set").collect()}
    rows = [("c", i, float(i), "hit", "in", "Ith", 12 if i % 3 else 112, []) for i in range(9)]
    settle.settled(spark.createDataFrame(rows, "clip_id string, seq long, t double, kind string, dir string, fighter string, amount int, flags array<string>")).collect()
    assert {r[0]: r[1] for r in spark.sql("set").collect()} == before


@pytest.mark.parametrize("parts", [1, 64])
def test_clips_written_again_are_replaced_and_others_kept(spark, tmp_path, parts):
    path = f"file://{tmp_path}/events"
    rows = [(f"c{i % 20}", float(i), "in", "hit", i, i) for i in range(200)] + [(None, 1.0, "in", "hit", 1, 1)]
    df = spark.createDataFrame(rows, "clip_id string, t double, dir string, kind string, amount int, seq long")
    sinks.write_events(df, path, parts)
    sinks.write_events(df.where("clip_id in ('c3', 'c4')").withColumn("amount", F.lit(-1)).where("t < 50"), path, parts)
    got = spark.read.parquet(path)
    want = {(c, t, -1 if c in ("c3", "c4") else a) for c, t, _, _, a, _ in rows if c not in ("c3", "c4") or t < 50}
    assert {(r.clip_id, r.t, r.amount) for r in got.collect()} == want and got.count() == len(want)
    assert len([d for d in os.listdir(f"{tmp_path}/events") if d.startswith("part=")]) <= parts


def test_saved_pages(spark, tmp_path):
    (tmp_path / "a b.html").write_text("<p>\none\n</p>")
    (tmp_path / "c.txt").write_text("no page")
    assert [(r.name, r.html) for r in readers.pages(spark, f"file://{tmp_path}").collect()] == [("a b", "<p>\none\n</p>")]


def test_fights_are_listed_newest_first(spark):
    events = "array<struct<kind:string,dir:string,amount:int>>"
    fights = spark.createDataFrame([("old", 1, []), ("new", 3, []), ("mid", 2, [])], f"name string, s int, events {events}").withColumn("modified", F.timestamp_seconds("s")).withColumn("duration", F.lit(5.0))
    assert [r[0] for r in report.saved_history(fights).collect()] == ["new", "mid", "old"]


def test_frames_are_read_by_planned_slices(spark):
    asked = spark.sparkContext.accumulator(0)

    def opened(path, start, frames, fps, crop):
        asked.add(frames)
        for i in range(frames):
            if start + i / fps < 25.0:
                yield f"{path} {start + i / fps} {crop}".encode()

    clips = spark.createDataFrame([("c", "x.mp4", 25.0), ("d", "y.mp4", 3.0)], "clip_id string, path string, duration double")
    got = readers.sampled_frames(clips, opened, 2.0, (0, 1, 2, 3))
    rows = sorted(got.collect(), key=lambda r: (r.clip_id, r.frame_no))
    assert [(r.frame_no, r.ft) for r in rows if r.clip_id == "c"] == [(i + 1, i / 2) for i in range(50)]
    assert [bytes(r.content) for r in rows if r.clip_id == "d"] == [f"y.mp4 {i / 2} (0, 1, 2, 3)".encode() for i in range(6)]
    assert asked.value == 56


def test_what_became_of_lines_adds_up(spark):
    rows = [("c", 1, 0.0, 0, 0, "[10:00:00] You hit Bob for 5"), ("c", 1, 0.0, 1, 0, "[10:00:00]  You hit Bob for 5"), ("c", 1, 0.0, 0, 1, None), ("c", 2, None, 0, 0, "You hit Bob for 5"), ("c", 2, None, 0, 1, "[10:00:01 "), ("c", 3, 1.0, 0, 0, "[99:00:00 "), ("c", 3, 1.0, 0, 1, "hit for SSSSS"), ("c", 3, 1.0, 0, 2, "he waves for 5"), ("c", 3, 1.0, 0, 3, "tree")]
    df = spark.createDataFrame(rows, "clip_id string, frame_no int, ft double, pass int, line_no int, raw string")
    got = {r.reason: r["lines"] for r in lines.losses(df).collect()}
    assert got == {"read": 1, "repeated": 1, "no text": 1, "no time": 1, "empty": 2, "unreadable amount": 1, "no shape": 1, "no amount": 1}
    assert lines.parsed(lines.first_distinct(df)).count() == 1


def test_many_slices_are_few_tasks(spark):
    """Tasks grow in what they read one after the other, not in number with the slices; a slice's frames go on a bounded number at once."""
    clips = spark.range(400).selectExpr("cast(id as string) clip_id", "'x' path", "40.0D + if(id = 7, 20000.0D, 0.0D) duration")
    got = readers.sampled_frames(clips, lambda path, start, frames, fps, crop: (b"" for _ in range(frames)), 2.0)
    assert got.rdd.getNumPartitions() <= 4
    n = {r.clip_id: (r.n, r.d, r.last) for r in got.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_distinct("frame_no").alias("d"), F.max("ft").alias("last")).collect()}
    assert n == {str(i): (80, 80, 39.5) if i != 7 else (40080, 40080, 20039.5) for i in range(400)}
