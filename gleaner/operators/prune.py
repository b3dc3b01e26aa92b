"""Events that are others misread: nameless copies, twins of one second, and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions.text import one_glyph_off
from gleaner.operators.statistics import noise_floor, upper_median


def without_nameless_copies(events: DataFrame, visible: float = 12.0) -> DataFrame:
    """Drops nameless incoming events beside which a named one of the same amount stands within the span of a line."""
    named = events.where("dir = 'in' and who <> 'Unknown'").select(
        F.col("clip_id").alias("__clip"), F.col("amount").alias("__amount"), F.col("t").alias("__t"), F.explode(F.array(*[F.floor(F.col("t") / visible) + i for i in (-1, 0, 1)])).alias("__cell"),
    )
    same = (F.col("clip_id") == F.col("__clip")) & (F.col("amount") == F.col("__amount")) & (F.floor(F.col("t") / visible) == F.col("__cell")) & (F.abs(F.col("t") - F.col("__t")) <= visible)
    nameless = (F.col("dir") == "in") & (F.col("who") == "Unknown")
    rest = events.where(~nameless | nameless.isNull())
    return rest.unionByName(events.where(nameless).join(named, same, "left_anti"))


def without_twins(events: DataFrame, by: tuple[str, ...] = ("clip_id", "kind", "dir", "fighter", "t", "flags"), seen: str = "seen", amount: str = "amount", order: str = "seq") -> DataFrame:
    """Of timed events alike in all but the amount, drops those a glyph off the most seen one and seen less than half as often."""
    w = Window.partitionBy("exact", *by).orderBy(F.desc(seen), order)
    best = F.first(F.struct(F.col(seen).alias("s"), F.col(amount).alias("a"))).over(w)
    df = events.withColumn("__best", best)
    twin = F.col("exact") & (F.col(seen) * 2 < F.col("__best.s")) & one_glyph_off(F.col(amount).cast("string"), F.col("__best.a").cast("string"))
    return df.where(~twin).drop("__best")


def in_clip(events: DataFrame, clips: DataFrame, tail: float = 5.0) -> DataFrame:
    """Events within the clip and a few seconds after it."""
    ends = clips.select("clip_id", F.greatest("duration", F.lit(1.0)).alias("__ends"))
    return events.join(ends, "clip_id").where((F.col("t") >= 0) & (F.col("t") <= F.col("__ends") + tail)).drop("__ends")


def judged(events: DataFrame, last_frame: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Events with real: read often enough for their clip, or timed and either long in view or still there at the end.

    last_frame has clip_id and ends, the time of the clip's last frame.
    """
    floor = noise_floor(events, ("clip_id",), "seen", cfg.seen_cap, cfg.seen_share, cfg.min_seen)
    df = events.join(floor.join(last_frame, "clip_id", "left"), "clip_id")
    spans = events.select("clip_id", "seen", "span").join(floor, "clip_id").where("seen >= floor").groupBy("clip_id").agg((upper_median("span") * cfg.seen_share).alias("lasted"))
    df = df.join(spans, "clip_id", "left")
    long_there = (F.coalesce("lasted", F.lit(0.0)) > 0) & (F.col("span") >= F.col("lasted"))
    still_there = (F.col("last") >= F.coalesce("ends", F.lit(0.0))) & (F.col("seen") >= 2)
    real = (F.col("seen") >= F.col("floor")) | (F.col("exact") & (long_there | still_there))
    return df.select(*events.columns, F.coalesce(real, F.lit(False)).alias("real"))


def without_noise(events: DataFrame, last_frame: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Events that are real, as judged() has it."""
    return judged(events, last_frame, cfg).where("real").drop("real")
