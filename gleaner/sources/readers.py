"""Sources: frames, lines and boxes of text, saved fights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions.text import frame_time, is_combat_line, stem

#: Segments of a clip, and the shortest clip that is cut.
SEGMENT_SECONDS, MOST_SEGMENTS, LEAST_SECONDS = 10, 4, 20
TAG_LINE = "##FILE"
#: Slices that a task reads one after the other, where there are more of them than tasks.
SLICES = 4096
#: Images that a reader's task holds at once; frames, and bytes of them, that go on together.
IMAGES, TOGETHER, TOGETHER_BYTES = 64, 4096, 1 << 22


def segments(clips: DataFrame, fps: float = 2.0, *more: str) -> DataFrame:
    """The time segments in which a clip is read: clip_id, segment, first_frame, frames, and more of the clip's columns; numbers go
    on across segments."""
    n = F.when(F.col("duration") >= LEAST_SECONDS, F.least(F.greatest(F.floor(F.col("duration") / SEGMENT_SECONDS), F.lit(1)), F.lit(MOST_SEGMENTS))).otherwise(F.lit(1)).cast("int")
    df = clips.withColumn("__n", n).withColumn("frames", F.ceil(F.col("duration") * fps / F.col("__n")).cast("int"))
    df = df.select("clip_id", "frames", *more, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("segment"))
    return df.select("clip_id", "segment", (F.col("segment") * F.col("frames") + 1).alias("first_frame"), "frames", (F.col("segment") * F.col("frames") / F.lit(float(fps))).alias("start"), *more)


def frames(spark: SparkSession, path: str, fps: float = 2.0) -> DataFrame:
    """Frame images of folders named by clip: clip_id, frame_no, ft, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    no = F.regexp_extract(name, r"(\d+)", 1).try_cast("int")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("clip_id"), no.alias("frame_no"), frame_time(name, fps).alias("ft"), "content")


def read_frames_told(images: DataFrame, reader: Callable[[bytes], list[tuple[float, float, str]]], pass_: int = 0) -> DataFrame:
    """Lines of frames by any reader of images that gives (top, left, text), and column fault: a frame that it fails on is a row
    without text that says why, one without lines has none.

    Lines are numbered from the top, those at one height from the left.
    """

    names = ["clip_id", "frame_no", "ft", "pass", "line_no", "raw", "fault"]
    types = pa.schema([(n, t) for n, t in zip(names, (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES):
                rows = []
                for clip, no, ft, content in zip(*(c.to_pylist() for c in batch.slice(at, IMAGES).columns), strict=True):
                    try:
                        rows += [(clip, no, ft, pass_, i, line, None) for i, (_, _, line) in enumerate(sorted(reader(content)))]
                    except Exception as e:  # a reader may fail in any way, and the clip goes on
                        rows.append((clip, no, ft, pass_, 0, None, f"{type(e).__name__}: {e}"))
                yield _batch(rows, types)

    return images.select("clip_id", F.col("frame_no").cast("int"), F.col("ft").cast("double"), "content").mapInArrow(run, schema.OCR_LINES + ", fault string")


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)


def read_frames(images: DataFrame, reader: Callable[[bytes], list[tuple[float, float, str]]], pass_: int = 0) -> DataFrame:
    """Lines of frames by any reader, without the faults."""
    return read_frames_told(images, reader, pass_).where("fault is null").drop("fault")


def sampled_frames(clips: DataFrame, opened: Callable, fps: float = 2.0, crop: tuple[int, int, int, int] | None = None, path: str = "path") -> DataFrame:
    """Frames of clips, read slice by slice: clip_id, frame_no, ft, content.

    The planned slices (segments) are rows that are dealt out, a few to a task where there are very many, and opened(path, start, frames, fps, crop) gives the
    images of just the frames that are asked for; so a clip is read by several tasks, each of which reads its own stretch of it,
    and neither other frames nor what lies outside of the crop is read. A slice's last frames may be missing where the clip ends.
    """
    planned = segments(clips.withColumn("__path", F.col(path)), fps, "__path").select(F.col("clip_id").cast("string"), "__path", "first_frame", "frames", "start")
    slices, parts = planned.count(), int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = planned.repartition(max(1, min(slices, max(parts, slices // SLICES))), "clip_id", "first_frame")

    types = pa.schema([("clip_id", pa.string()), ("frame_no", pa.int32()), ("ft", pa.float64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        rows, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES):
                for clip, where, first, frames_, start in zip(*(c.to_pylist() for c in batch.slice(at, IMAGES).columns), strict=True):
                    for i, image in enumerate(opened(where, float(start), int(frames_), fps, crop)):
                        rows.append((clip, int(first) + i, (int(first) + i - 1) / fps, image))
                        size += len(image or b"")
                        if len(rows) >= TOGETHER or size >= TOGETHER_BYTES:
                            yield _batch(rows, types)
                            rows, size = [], 0
        if rows:
            yield _batch(rows, types)

    return each.mapInArrow(run, "clip_id string, frame_no int, ft double, content binary")


def tagged_lines(spark: SparkSession, path: str, fps: float = 2.0, pass_: int = 0) -> DataFrame:
    """Lines of files in which a line with a frame's name stands before the frame's own; blank lines are dropped."""
    whole = spark.read.text(path, wholetext=True).select(stem(F.url_decode(F.col("_metadata.file_name"))).alias("clip_id"), F.col("value"))
    parts = whole.select("clip_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return from_tagged(parts, fps, pass_)


def from_tagged(parts: DataFrame, fps: float = 2.0, pass_: int = 0, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """(by, pos, line) with frame names between lines to ocr_lines: a line's frame is the last one named before it."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.startswith("line", F.lit(TAG_LINE)), F.trim(F.substr("line", F.lit(len(TAG_LINE) + 1))))
    df = parts.withColumn("__frame", F.last(named, ignorenulls=True).over(w))
    df = df.where(~F.startswith("line", F.lit(TAG_LINE)) & (F.trim("line") != "") & F.col("__frame").isNotNull())
    no = F.regexp_extract("__frame", r"(\d+)", 1).try_cast("int")
    return df.select(*by, no.alias("frame_no"), frame_time(F.col("__frame"), fps).alias("ft"), F.lit(pass_).alias("pass"), F.col("pos").alias("line_no"), F.trim("line").alias("raw"))


def boxes(lines: DataFrame, line: str = "line", by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Boxes of combat lines from records "x y w h<TAB>text"; other records and broken ones are dropped."""
    parts = F.split(F.col(line), "\t", 2)
    at = F.split(F.trim(F.get(parts, F.lit(0))), r"\s+")
    text: Column = F.get(parts, F.lit(1))
    number = [F.get(at, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate("xywh")]
    sound = ~F.startswith(F.col(line), F.lit(TAG_LINE)) & text.isNotNull() & is_combat_line(text) & (F.size(at) == 4)
    return lines.where(sound).select(*by, *number, text.alias("text")).where("x is not null and y is not null and w is not null and h is not null")


def fights(spark: SparkSession, path: str) -> DataFrame:
    """Saved envelopes of a folder that have their page beside them; files that don't parse are left out.

    name is the file's stem, modified its time.
    """
    name = F.url_decode(F.col("_metadata.file_name"))
    raw = spark.read.schema(schema.ENVELOPE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    saved = raw.select("*", stem(name).alias("name"), F.col("_metadata.file_modification_time").alias("modified"))
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path).select(stem(F.regexp_extract("path", "([^/]+)$", 1)).alias("name"))
    return saved.where("_corrupt_record is null and events is not null").drop("_corrupt_record").join(pages, "name", "left_semi")


def hits_of(fights_: DataFrame) -> DataFrame:
    """Each fight's hits, as a report shows them."""
    return fights_.select("name", F.coalesce("duration", F.lit(0.0)).alias("duration"), F.filter("events", lambda e: F.coalesce(e["kind"], F.lit("hit")) == "hit").alias("events"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved report pages: name and html."""
    return spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True).select(stem(F.url_decode(F.col("_metadata.file_name"))).alias("name"), F.col("value").alias("html"))
