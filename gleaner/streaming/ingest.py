"""Text lines as a stream. An addition: reconstruction itself is of whole clips.

Lines are parsed as they come and kept by clip; a clip is reconstructed once it is closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.config import Settings
from gleaner.operators import lines
from gleaner.plans import reconstruct

#: Parts of the store by clip.
PARTS = 256


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """ocr_lines that arrive as Parquet files."""
    return spark.readStream.schema(schema.OCR_LINES).parquet(path)


def distinct_stream(stream: DataFrame, seen_at: str, late: str = "10 minutes") -> DataFrame:
    """A frame's lines without repeats, remembered for as long as late lines may come."""
    keyed = stream.withColumn("__line", F.trim(F.regexp_replace("raw", r"\s+", " "))).withWatermark(seen_at, late)
    return keyed.dropDuplicatesWithinWatermark(["clip_id", "frame_no", "__line"]).drop("__line")


def store_readings(stream: DataFrame, path: str, checkpoint: str):
    """Writes readings of the lines as they come; each file of lines is read once."""
    return lines.parsed(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("clip_id").outputMode("append")


def reconstruct_closed(stream: DataFrame, clips: DataFrame, store: str, checkpoint: str, sink: Callable[[DataFrame, int], None], cfg: Settings = Settings()):
    """Keeps lines by clip under store, and hands the events of clips of which an end marker (raw is null) came to sink.

    A batch that runs again replaces its own files, so lines are kept once. The store is parted by a hash of the clip, so
    closing a clip reads its own part alone.
    """
    part = F.pmod(F.xxhash64("clip_id"), F.lit(PARTS)).cast("int")

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.where("raw is not null").withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{store}/epoch={epoch}")
        closed = batch.where("raw is null").select("clip_id").distinct()
        parts = [r[0] for r in closed.select(part.alias("part")).distinct().collect()]  # PARTS at most
        if not parts:
            return
        kept = spark.read.schema(f"{schema.OCR_LINES}, epoch long, part int").parquet(store).where(F.col("part").isin(parts)).drop("epoch", "part")
        sink(reconstruct.events(kept.join(closed, "clip_id", "left_semi"), clips, cfg), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
