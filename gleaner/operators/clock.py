"""Clocks: wall-clock times moved onto the clip's own time, by the recording that each line belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions.text import day_shift, tenths
from gleaner.operators.statistics import islands, nearest_of, upper_median
from gleaner.sources.staging import staged

KEY = ["clip_id", "t", "dir", "amount", "fighter"]


def first_sightings(readings: DataFrame) -> DataFrame:
    """The earliest frame time of each timed line."""
    return readings.where("exact and ft is not null").groupBy(*KEY).agg(F.min("ft").alias("first_ft"))


def offsets(first: DataFrame) -> DataFrame:
    """(KEY, day, off): what each line says the wall clock was at the clip's start, moved onto the middle line's day."""
    df = first.withColumn("raw_off", F.col("t") - F.col("first_ft"))
    middle = df.groupBy("clip_id").agg(upper_median("raw_off").alias("__middle"))
    df = df.join(middle, "clip_id").withColumn("day", day_shift(F.col("raw_off"), F.col("__middle")))
    return df.withColumn("off", F.col("raw_off") + F.col("day") * 86400.0).select(*KEY, "day", "off")


def centres(off: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(clip_id, centres): the middle offset of each recording, in order; of the largest group where none is large enough."""
    groups = islands(off, ("clip_id",), "off", cfg.apart, name="grp")
    sized = groups.groupBy("clip_id", "grp").agg(F.count("*").alias("n"), upper_median("off").alias("centre"))
    clip = Window.partitionBy("clip_id")
    total = F.sum("n").over(clip)
    sized = sized.withColumn("real", F.col("n") >= F.greatest(F.lit(cfg.least_lines), F.floor(total * cfg.share)))
    sized = sized.withColumn("any", F.max(F.col("real")).over(clip)).withColumn("rank", F.row_number().over(clip.orderBy(F.desc("n"), "grp")))
    kept = sized.where("real or (not any and rank = 1)")
    return kept.groupBy("clip_id").agg(F.sort_array(F.collect_list("centre")).alias("centres"))


def aligned(readings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Readings with timed ones at clip time; clips without a timed line stay as they are."""
    off = staged(offsets(first_sightings(readings)))
    mid = staged(centres(off, cfg))
    shift = off.join(mid, "clip_id").select(*KEY, "day", nearest_of(F.col("off"), F.col("centres")).alias("centre"))
    of = shift.select(F.col("clip_id").alias("__clip"), F.col("t").alias("__t"), F.col("dir").alias("__dir"), F.col("amount").alias("__amount"), F.col("fighter").alias("__f"), "day", "centre")
    same = (F.col("clip_id") == F.col("__clip")) & (F.col("t") == F.col("__t")) & (F.col("dir") == F.col("__dir")) & (F.col("amount") == F.col("__amount")) & F.col("fighter").eqNullSafe(F.col("__f"))
    fallback = mid.select("clip_id", F.element_at("centres", (F.size("centres") / 2).cast("int") + 1).alias("__back"))
    df = readings.join(of, same & F.col("exact"), "left").join(fallback, "clip_id", "left")
    centre, day = F.coalesce("centre", "__back"), F.when(F.col("centre").isNotNull(), F.col("day")).otherwise(0)
    moved = F.when(F.col("exact") & centre.isNotNull(), tenths(F.col("t") + day * 86400.0 - centre)).otherwise(F.col("t"))
    return df.withColumn("t", moved).select(*readings.columns)
