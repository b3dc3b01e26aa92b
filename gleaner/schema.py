"""Schemas of the tables, all explicit."""

from __future__ import annotations

OCR_LINES = "clip_id string, frame_no int, ft double, pass int, line_no int, raw string"
CLIPS = "clip_id string, path string, width int, height int, duration double"
READING = (
    "clip_id string, seq long, pass int, ft double, wall_s double, t double, exact boolean, kind string, dir string, "
    "who string, target string, fighter string, amount int, ability string, flags array<string>, raw string"
)
EVENT = READING + ", seen long, span double, last double"
ENVELOPE = (
    "source string, source_path string, duration double, fps_sampled double, ocr string, frames long, ocr_lines long, players array<string>, "
    "events array<struct<t: double, ft: double, exact: boolean, kind: string, dir: string, who: string, target: string, amount: int, "
    "ability: string, flags: array<string>, raw: string, pass: int, seen: long, span: double, last: double>>"
)
