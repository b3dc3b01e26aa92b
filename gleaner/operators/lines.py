"""From text lines to readings: frame-level distinct lines, parsing, and probes of whether a log is in view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import similarity, text
from gleaner.functions.columns import computed
from gleaner.functions.grammar import shape, told


def first_distinct(lines: DataFrame, by: tuple[str, ...] = ("clip_id", "frame_no"), order: tuple[str, ...] = ("pass", "line_no"), line: str = "raw") -> DataFrame:
    """Of lines of a group that differ in blanks alone, the first.

    The lines are dealt out by group, in as many parts as the session sets: they are few bytes and much work to parse, so
    parts must not be put together again for being small.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(parts, *by)
    w = Window.partitionBy(*by, text.squeezed(F.col(line))).orderBy(*order)
    return lines.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def told_bodies(bodies: DataFrame) -> DataFrame:
    """What bodies of lines tell (column body): number, shape of the grammar, names and tags; reason says why one tells nothing."""
    df = computed(bodies, __found=text.amount_found(F.col("body")))
    df = computed(df, amount=text.amount_in(F.col("__found")), __shape=F.when(F.col("__found").isNotNull(), shape(F.col("body"))))
    df = told(df, "body", "__shape").withColumn("flags", similarity.tags(F.when(F.col("__shape").isNotNull() & F.col("amount").isNotNull(), F.col("body"))))
    why = F.when(F.col("body") == "", "empty").when(F.col("__found").isNull(), "no amount").when(F.col("amount").isNull(), "unreadable amount").when(F.col("__shape").isNull(), "no shape")
    return df.withColumn("reason", why)


def read(lines: DataFrame) -> DataFrame:
    """Every line with what it tells, and the reason why it is no reading (null if it is one).

    A line is in view for seconds and is read again from frame to frame, so each distinct body is parsed once and joined back;
    bodies are dealt out in as many parts as the session sets, as they are few bytes and much work. A stream's lines are parsed
    as they come.
    """
    df = computed(lines, wall_s=text.clock_seconds(F.col("raw")), body=text.without_channels(text.after_clock(F.col("raw"))))
    if lines.isStreaming:
        df = told_bodies(df)
    else:
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bodies = df.where("coalesce(wall_s, ft) is not null").select("body").distinct()
        df = df.join(told_bodies(bodies.repartition(parts, "body")), "body", "left")
    return df.withColumn("reason", F.when(F.col("raw").isNull(), "no text").when(F.coalesce("wall_s", "ft").isNull(), "no time").otherwise(F.col("reason")))


def parsed(lines: DataFrame) -> DataFrame:
    """Readings of the lines that have a time, a number and a shape of the grammar; seq is the order of reading."""
    df = read(lines).where("reason is null")
    df = df.withColumn("t", F.coalesce("wall_s", F.col("ft"))).withColumn("exact", F.col("wall_s").isNotNull())
    seq = F.col("frame_no").cast("long") * 10_000_000 + F.col("pass") * 1_000_000 + F.col("line_no")
    return df.select("clip_id", seq.alias("seq"), "pass", "ft", "wall_s", "t", "exact", "kind", "dir", "who", "target", "fighter", "amount", "ability", "flags", "raw")


def losses(lines: DataFrame, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """(by, reason, lines): how many distinct lines of frames became readings (reason "read"), or why not; repeats of a frame's
    line count as "repeated", so the numbers of a clip add up to all its lines."""
    first = first_distinct(lines)
    told_ = read(first).groupBy(*by, F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.count("*").alias("lines"))
    every = lines.groupBy(*by).agg(F.count("*").alias("n")).join(first.groupBy(*by).agg(F.count("*").alias("__m")), list(by))
    return told_.unionByName(every.where("n > __m").select(*by, F.lit("repeated").alias("reason"), (F.col("n") - F.col("__m")).alias("lines")))


def log_visible(lines: DataFrame, need: int = 3) -> DataFrame:
    """For each clip, whether its lines have the shape of combat often enough."""
    return lines.groupBy("clip_id").agg((F.count_if(text.is_combat_line(F.col("raw"))) >= need).alias("visible"))


def sample_times(clips: DataFrame, samples: int = 4) -> DataFrame:
    """The times at which a clip is looked into: evenly spread, a second apart at least."""
    step = F.greatest(F.col("duration") / (samples + 1), F.lit(1.0))
    return clips.select("clip_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.round(step * i, 2))).alias("nth", "at"))


def log_visible_at(lines: DataFrame, clips: DataFrame, samples: int = 4, need: int = 3) -> DataFrame:
    """For each clip, whether the frames looked into, the first at or after each sample's time, show combat lines enough."""
    times = sample_times(clips, samples).join(lines.select("clip_id", "frame_no", "ft").distinct(), "clip_id").where("ft >= at")
    frames = times.groupBy("clip_id", "nth").agg(F.min_by("frame_no", F.struct("ft", "frame_no")).alias("frame_no")).select("clip_id", "frame_no").distinct()
    shown = log_visible(lines.join(frames, ["clip_id", "frame_no"], "left_semi"), need)
    return clips.select("clip_id").join(shown, "clip_id", "left").withColumn("visible", F.coalesce("visible", F.lit(False)))


def line_frequency(lines: DataFrame, line: str = "raw") -> DataFrame:
    """How often each distinct line stands, blanks at its ends aside."""
    said = F.trim(F.col(line)).alias("line")
    return lines.select(said).groupBy("line").agg(F.count("*").alias("n"))


def readings_of(readings: DataFrame, name: str) -> DataFrame:
    """All readings of a name's fragment in the order of their frames."""
    both = F.lower(F.concat(F.coalesce("who", F.lit("")), F.coalesce("target", F.lit(""))))
    return readings.where(both.contains(name.lower())).orderBy("clip_id", "ft", "seq")
