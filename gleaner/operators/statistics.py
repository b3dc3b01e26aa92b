"""Order statistics and segmentation that several stages use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(value: str) -> Column:
    """The middle value, of an even number of values the upper of both."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def islands(df: DataFrame, by: tuple[str, ...], at: str, gap: float, order: tuple[str, ...] = (), name: str = "island") -> DataFrame:
    """Numbers the runs of rows of a group: a new one begins where the next value is more than gap away."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    before = F.lag(at).over(w)
    broken = F.when(F.col(at) - before > gap, 1).otherwise(0)
    return df.withColumn("__b", broken).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def nearest_of(value: Column, centres: Column) -> Column:
    """The value of an array that is nearest; of two as near the smaller."""
    return F.array_min(F.transform(centres, lambda c: F.struct(F.abs(c - value).alias("far"), c.alias("c"))))["c"]


def noise_floor(df: DataFrame, by: tuple[str, ...], seen: str, cap: int = 2, share: float = 0.25, min_seen: int = 0) -> DataFrame:
    """For each group the number of readings below which an event may be noise: a share of what is typical, up to a cap."""
    typical = upper_median(seen)
    floor = F.lit(min_seen) if min_seen else F.least(F.greatest(F.lit(1), F.floor(typical * share)), F.lit(cap))
    return df.groupBy(*by).agg(typical.cast("long").alias("typical"), floor.cast("long").alias("floor"))


def majority(df: DataFrame, by: tuple[str, ...], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one met first."""
    tally = df.groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("votes"), "__first")
    return tally.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth", "__first")


def line_pitch(boxes: DataFrame, by: tuple[str, ...], top: str, default: Column) -> DataFrame:
    """The usual distance of neighbouring lines, of those over 6 and under 120."""
    w = Window.partitionBy(*by).orderBy(top)
    gaps = boxes.withColumn("__gap", F.col(top) - F.lag(top).over(w))
    fair = F.when((F.col("__gap") > 6) & (F.col("__gap") < 120), F.col("__gap"))
    pitch = gaps.withColumn("__fair", fair).where("__fair is not null").groupBy(*by).agg(upper_median("__fair").alias("pitch"))
    return boxes.select(*by).distinct().join(pitch, list(by), "left").withColumn("pitch", F.coalesce("pitch", default))


def log_column(boxes: DataFrame, clips: DataFrame) -> DataFrame:
    """The crop of each clip's log from boxes of its combat lines: those near the common left edge, with room around.

    A clip with fewer than four boxes, or fewer than four near the edge, has none.
    """
    common = boxes.groupBy("clip_id").agg(upper_median("x").alias("common"), F.count("*").alias("n")).where("n >= 4")
    near = boxes.join(common, "clip_id").join(clips.select("clip_id", "width", "height"), "clip_id")
    near = near.where(F.abs(F.col("x") - F.col("common")) <= F.greatest(F.lit(240.0), F.col("width") * 0.12))
    pitch = line_pitch(near, ("clip_id", "height"), "y", F.greatest(F.lit(14), F.floor(F.col("height") * 0.017)).cast("int"))
    agg = near.groupBy("clip_id", "width", "height").agg(
        F.count("*").alias("n"), F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"),
    )
    df = agg.where("n >= 4").join(pitch.drop("height"), "clip_id")
    df = df.withColumn("cx", F.greatest(F.lit(0), F.col("left") - 16)).withColumn("cy", F.greatest(F.lit(0), F.col("top") - 3 * F.col("pitch")))
    width = F.least(F.col("width") - F.col("cx"), F.greatest(F.col("right") - F.col("cx") + 220, F.col("width") * 0.52))
    return df.select("clip_id", "cx", "cy", F.floor(width).cast("int").alias("cw"), (F.least("height", F.col("bottom") + F.col("pitch")) - F.col("cy")).alias("ch"), "pitch")
