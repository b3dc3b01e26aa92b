"""What is told of events: totals, players, lanes, envelopes, the history of fights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import text

#: The lanes under a clip, and what stands in each.
LANES = (("counter", "Counter reduced", "Counter Reduced", "in"), ("parried", "Parry received", "Parry", "in"), ("gotparried", "Parry given", "Parry", "out"))


def kind() -> Column:
    return F.coalesce("kind", F.lit("hit"))


def _sum(of: Column, amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(of, F.col(amount))), F.lit(0)).cast("long")


def totals(events: DataFrame, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Damage, healing and magic out and in, with the healers and spells."""
    hit, heal, out, in_ = kind() == "hit", kind() == "heal", F.col("dir") == "out", F.col("dir") == "in"
    magic = hit & F.col("ability").isNotNull() & (F.col("ability") != "") & ~text.is_weapon(F.col("ability"))
    names = lambda of, c: F.sort_array(F.collect_set(F.when(of, F.col(c))))
    return events.groupBy(*by).agg(
        _sum(hit & out).alias("damage_out"), _sum(hit & in_).alias("damage_in"), _sum(heal & out).alias("healing_out"), _sum(heal & in_).alias("healing_in"),
        _sum(magic & out).alias("magic_out"), _sum(magic & in_).alias("magic_in"), names(heal & in_ & (F.col("who") != "Unknown"), "who").alias("healers"), names(magic, "ability").alias("spells"),
    )


def players(events: DataFrame, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    both = events.select(*by, F.explode(F.array("who", "target")).alias("name")).where("name is not null and name not in ('You', 'Unknown')")
    return both.groupBy(*by).agg(F.sort_array(F.collect_set("name")).alias("players"))


def history(events: DataFrame, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Per fight: hits' damage out and in, their difference, and all events."""
    hit = kind() == "hit"
    df = events.groupBy(*by).agg(_sum(hit & (F.col("dir") == "out")).alias("out"), _sum(hit & (F.col("dir") == "in")).alias("in"), F.count("*").alias("events"))
    return df.withColumn("net", F.col("out") - F.col("in"))


def summary(ocr_lines: DataFrame, readings: DataFrame, folded: DataFrame, kept: DataFrame) -> DataFrame:
    """How a clip's lines became events: frames with lines, lines, readings, events before and after noise was left out."""
    lines = ocr_lines.groupBy("clip_id").agg(F.count_distinct("frame_no").alias("frames"), F.count("*").alias("lines"))
    count = lambda df, name: df.groupBy("clip_id").agg(F.count("*").alias(name))
    df = lines.join(count(readings, "readings"), "clip_id", "left").join(count(folded, "folded"), "clip_id", "left").join(count(kept, "kept"), "clip_id", "left")
    df = df.na.fill(0, ["readings", "folded", "kept"])
    return df.withColumn("dropped", F.col("folded") - F.col("kept"))


def judged_summary(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """summary() and dropped() from each clip's sums of lines and from events that say whether they are real; these are a table."""
    n = judged.groupBy("clip_id").agg(F.count("*").alias("folded"), F.count_if("real").alias("kept"))
    df = lines.join(n, "clip_id", "left").na.fill(0, ["folded", "kept"]).withColumn("dropped", F.col("folded") - F.col("kept"))
    return df.join(first_told(judged.where("not real")), "clip_id", "left")


def dropped(folded: DataFrame, kept: DataFrame, most: int = 6) -> DataFrame:
    """The first few events of each clip that were left out as noise, as fighter:amount in order of time."""
    told = ["clip_id", "t", "dir", "kind", "fighter", "amount", "last", "seen", "span", "exact"]
    return first_told(folded.select(*told).exceptAll(kept.select(*told)), most)


def first_told(gone: DataFrame, most: int = 6) -> DataFrame:
    """The first few of each clip's events, as fighter:amount in order of time."""
    nth = F.row_number().over(Window.partitionBy("clip_id").orderBy("t", "dir", "kind", "fighter", "amount", "last"))
    first = gone.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("nth", F.concat_ws(":", "fighter", F.col("amount").cast("string")).alias("said")))).alias("x"))
    return first.select("clip_id", F.transform("x", lambda x: x["said"]).alias("first_dropped"))


def selected(events: DataFrame, first: float | None = None, last: float | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Events of a stretch of the clip, without some fighters."""
    who = F.when(F.col("dir") == "in", F.col("who")).otherwise(F.col("target"))
    df = events if first is None else events.where(F.col("t") >= first)
    df = df if last is None else df.where(F.col("t") <= last)
    return df.where(~F.coalesce(who, F.lit("")).isin(*without)) if without else df


def defence(events: DataFrame, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Of hits each way, those parried and those countered, and their shares in percent."""
    hits = events.where(kind() == "hit")
    df = hits.groupBy(*by, "dir").agg(F.count("*").alias("hits"), F.count_if(F.array_contains("flags", "Parry")).alias("parried"), F.count_if(F.array_contains("flags", "Counter Reduced")).alias("countered"))
    share = lambda n: F.round(F.col(n) * 100 / F.col("hits"), 2)
    return df.withColumn("parried_pct", share("parried")).withColumn("countered_pct", share("countered"))


def saved_history(fights: DataFrame) -> DataFrame:
    """History rows of saved envelopes (with name and modified), the newest first."""
    one = lambda d: F.aggregate(F.filter("events", lambda e: (F.coalesce(e["kind"], F.lit("hit")) == "hit") & (e["dir"] == d)), F.lit(0).cast("long"), lambda s, e: s + e["amount"])
    df = fights.withColumn("net", one("out") - one("in"))
    return df.select("name", F.date_format("modified", "dd MMM, HH:mm").alias("when"), text.minutes(F.coalesce("duration", F.lit(0.0))).alias("length"), F.size("events").alias("events"), "net", "modified").orderBy(F.desc("modified")).drop("modified")


def lanes(events: DataFrame, clips: DataFrame) -> DataFrame:
    """Marks of each lane: where on the clip, in percent, and who. The scale ends with the clip or its last hit."""
    hits = events.where(kind() == "hit")
    span = hits.groupBy("clip_id").agg(F.max("t").alias("__t")).join(clips.select("clip_id", "duration"), "clip_id", "left")
    span = span.select("clip_id", F.greatest(F.coalesce("duration", F.lit(0.0)), "__t", F.lit(1.0)).alias("span"))
    tests = F.array(*[F.when(F.array_contains("flags", tag) & (F.col("dir") == d), F.lit(lane)) for lane, _, tag, d in LANES])
    marks = hits.select("clip_id", "t", "dir", "who", "target", F.explode(F.array_compact(tests)).alias("lane")).join(span, "clip_id")
    who = F.when(F.col("dir") == "in", F.col("who")).otherwise(F.col("target"))
    return marks.select("clip_id", "lane", "t", text.position_percent(F.col("t"), F.col("span")).alias("pct"), text.minutes(F.col("t")).alias("at"), text.seek_time(F.col("t")).alias("seek"), who.alias("who"))


def lane_counts(events: DataFrame) -> DataFrame:
    hits = events.where(kind() == "hit")
    return hits.groupBy("clip_id").agg(*[F.count_if(F.array_contains("flags", tag) & (F.col("dir") == d)).alias(lane) for lane, _, tag, d in LANES])


def envelopes(events: DataFrame, clips: DataFrame, ocr_lines: DataFrame, cfg: Settings = Settings(), ocr: str = "given") -> DataFrame:
    """One row for each clip with its events in order of time, as saved."""
    item = F.struct("t", "dir", "seq", F.struct("t", "ft", "exact", "kind", "dir", "who", "target", "amount", "ability", "flags", "raw", "pass", "seen", "span", "last").alias("e"))
    listed = events.groupBy("clip_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["e"]).alias("events"))
    n = ocr_lines.groupBy("clip_id").agg(F.count_distinct("frame_no").alias("frames"), F.count("*").alias("ocr_lines"))
    df = clips.join(n, "clip_id", "left").join(players(events), "clip_id", "left").join(listed, "clip_id", "left")
    path = F.lit(None).cast("string") if cfg.no_path else F.col("path")
    return df.select(
        "clip_id", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("source"), path.alias("source_path"), text.tenths(F.col("duration")).alias("duration"), F.lit(cfg.fps).alias("fps_sampled"), F.lit(ocr).alias("ocr"),
        F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("ocr_lines", F.lit(0)).alias("ocr_lines"),
        F.coalesce("players", F.array().cast("array<string>")).alias("players"), F.col("events"),
    )
