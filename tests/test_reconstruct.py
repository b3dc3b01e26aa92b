import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.config import Settings
from gleaner.plans import reconstruct, report
from gleaner.sources import readers, sinks
from gleaner.streaming import ingest

FOES = ["Bigilo", "Soowon", "Karyna", "Troglodooty"]


def clip(clip_id, seed, hits=20, fps=2):
    """True events, and lines of them as seen: most readings right, some without a timestamp, some with a glyph wrong."""
    rng = random.Random(seed)
    truth, lines, start = [], [], 20 * 3600
    for k in range(hits):
        t, foe, n, incoming = 5 + 7 * k + rng.randint(0, 3), rng.choice(FOES), rng.randint(10, 60), rng.random() < 0.5
        truth.append((clip_id, "in" if incoming else "out", foe, n))
        body = f"{foe} hits you for {n}[Torso]" if incoming else f"You hit {foe} for {n}[Torso]"
        wall = start + t
        stamp = f"[{wall // 3600:02}:{wall // 60 % 60:02}:{wall % 60:02}] "
        for i in range(2 * fps * 4):
            frame = t * fps + i
            said = body
            if i and rng.random() < 0.1:
                said = said.replace("o", "0", 1)
            if i and rng.random() < 0.05:
                said = said.replace(f"for {n}[", f"for {n}1")
            lines.append((clip_id, frame + 1, frame / fps, 0, k, (stamp if i == 0 or rng.random() < 0.7 else "") + said))
    return truth, lines


@pytest.fixture(scope="module")
def case(spark):
    truth, rows = [], []
    for i in range(3):
        a, b = clip(f"c{i}", i)
        truth += a
        rows += b
    lines = spark.createDataFrame(rows, schema.OCR_LINES)
    clips = spark.createDataFrame([(f"c{i}", f"/clips/c{i}.mp4", 1920, 1080, 170.0) for i in range(3)], schema.CLIPS)
    return truth, lines, clips


def test_round_trip(case):
    truth, lines, clips = case
    got = sorted((r.clip_id, r.dir, r.fighter, r.amount) for r in reconstruct.events(lines, clips).collect())
    assert got == sorted(truth)


def test_order_of_rows_does_not_matter(case):
    truth, lines, clips = case
    key = lambda df: sorted(map(str, df.collect()))
    assert key(reconstruct.events(lines.orderBy(F.rand(3)), clips)) == key(reconstruct.events(lines, clips))


def test_saved_and_read_again(spark, case, tmp_path):
    truth, lines, clips = case
    events = reconstruct.events(lines, clips).cache()
    env = report.envelopes(events, clips, lines)
    rows = sinks.envelope_json(env).collect()
    (tmp_path / "reports").mkdir()
    for r in rows:
        (tmp_path / "reports" / f"{r.name} a.json").write_text(r.json)
        (tmp_path / "reports" / f"{r.name} a.html").write_text("<body></body>")
    (tmp_path / "reports" / "alone.json").write_text(rows[0].json)
    (tmp_path / "reports" / "bad.json").write_text("{")
    (tmp_path / "reports" / "bad.html").write_text("")
    saved = report.saved_history(readers.fights(spark, f"file://{tmp_path}/reports")).collect()
    want = {r.clip_id: (r.net, r.events) for r in report.history(events).collect()}
    assert {r.name[:2]: (r.net, r.events) for r in saved} == want and all(r.length == "2:50" for r in saved)
    one = json.loads(rows[0].json)
    assert [e["t"] for e in one["events"]] == sorted(e["t"] for e in one["events"]) and one["players"] == sorted(one["players"])
    hidden = report.envelopes(events, clips, lines, Settings(no_path=True)).first()
    assert hidden.source_path is None and hidden.source.endswith(".mp4")


def test_page(spark):
    df = spark.createDataFrame([("<body>x</body></body>", '{"a":"</script>"}'), ("none", "{}")], "t string, j string")
    got = [r[0] for r in df.select(sinks.page(F.col("t"), F.col("j"))).collect()]
    assert got == ['<body>x<script>\nwindow.__BAKED__ = {"a":"<\\/script>"};\n</script>\n</body></body>', "none"]


def test_tagged_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("lost\n##FILE f000001.png\none\n\n two \n##FILE f000004.png\r\nthree\n")
    got = readers.tagged_lines(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    assert [(r.clip_id, r.frame_no, r.ft, r.raw) for r in got] == [("a b", 1, 0.0, "one"), ("a b", 1, 0.0, "two"), ("a b", 4, 1.5, "three")]


def test_frames_by_any_reader(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "f000003.png").write_bytes(b"b 2 1|a 1 5|c 1 2")
    (tmp_path / "c1" / "f000004.png").write_bytes(b"broken")

    def reader(data):
        return [(float(y), float(x), t) for t, y, x in (p.split() for p in data.decode().split("|"))]

    got = readers.read_frames(readers.frames(spark, f"file://{tmp_path}"), reader).collect()
    assert [(r.clip_id, r.frame_no, r.ft, r.line_no, r.raw) for r in got] == [("c1", 3, 1.0, 0, "c"), ("c1", 3, 1.0, 1, "a"), ("c1", 3, 1.0, 2, "b")]


def test_boxes(spark):
    rows = [("c", "1 2 3 4\tYou hit Bob for 5"), ("c", "##FILE f.png"), ("c", "1 2 3\tYou hit Bob for 5"), ("c", "a 2 3 4\tYou hit Bob for 5"), ("c", "1 2 3 4\tno"), ("c", "1 2 3 4 You hit")]
    got = readers.boxes(spark.createDataFrame(rows, "clip_id string, line string")).collect()
    assert [(r.x, r.y, r.w, r.h, r.text) for r in got] == [(1, 2, 3, 4, "You hit Bob for 5")]


def test_stream_of_lines(spark, case, tmp_path):
    truth, lines, clips = case
    src, out = f"file://{tmp_path}/in", []
    lines.where("clip_id = 'c0'").write.parquet(f"{src}/1")
    spark.createDataFrame([("c0", None, None, None, None, None)], schema.OCR_LINES).write.parquet(f"{src}/2")
    stream = spark.readStream.schema(schema.OCR_LINES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(src)
    q = ingest.reconstruct_closed(stream, clips, f"file://{tmp_path}/store", f"file://{tmp_path}/check", lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.clip_id, r.dir, r.fighter, r.amount) for r in out) == sorted(x for x in truth if x[0] == "c0")


def test_empty(spark, case):
    _, lines, clips = case
    assert reconstruct.events(lines.limit(0), clips).count() == 0
