"""Settings of a reconstruction. The defaults are fixed values, which results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    fps: float = 2.0
    #: Seconds without a reading that end a run; reach of settling and of the anonymous anti-join.
    visible: float = 12.0
    #: Shares of likeness for names, for folding anchors, for tags and for channel words.
    name_cutoff: float = 0.55
    anchor_fold: float = 0.86
    tag_cutoff: float = 0.66
    channel_cutoff: float = 0.70
    anchor_min: int = 3
    fragment_ratio: int = 5
    #: Clock groups: seconds apart, share of all lines and least number of lines.
    apart: float = 30.0
    share: float = 0.10
    least_lines: int = 3
    copy_apart: float = 2.0
    seen_cap: int = 2
    seen_share: float = 0.25
    tail: float = 5.0
    min_seen: int = 0
    roster: tuple[str, ...] = field(default=())
    #: Judges times by whole wall-clock seconds instead of rounded clip seconds.
    exact_second_key: bool = False
    no_path: bool = False
