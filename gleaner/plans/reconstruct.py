"""The whole reconstruction: text lines of all clips to their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.operators import clock, lines, names, prune, runs, settle
from gleaner.sources.staging import staged


def readings(ocr_lines: DataFrame) -> DataFrame:
    """Readings of the distinct lines of each frame."""
    return lines.parsed(lines.first_distinct(ocr_lines))


def events(ocr_lines: DataFrame, clips: DataFrame, cfg: Settings = Settings(), frames: DataFrame | None = None) -> DataFrame:
    """Events of each clip. frames (clip_id, ft) are the frames taken; without it, those that have a line.

    Each stage but the runs uses the one before it several times, so these are tables. All but the band join and the last frames work
    within a clip or a part of one, so many clips spread over a cluster.
    """
    found = staged(readings(ocr_lines))
    found = staged(names.canonical(found, cfg))
    found = settle.settled(staged(clock.aligned(found, cfg)), cfg)
    out = staged(runs.events(found, cfg))
    out = prune.in_clip(prune.without_twins(prune.without_nameless_copies(out, cfg.visible)), clips, cfg.tail)
    last = (frames if frames is not None else ocr_lines).groupBy("clip_id").agg(F.max("ft").alias("ends"))
    return prune.without_noise(staged(out), last, cfg)
