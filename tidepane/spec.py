"""Parameters of a sliding-window query."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from datetime import timedelta

# Milliseconds per accepted duration unit.
UNIT_MS = {
    "ms": 1, "millisecond": 1, "milliseconds": 1,
    "s": 1000, "sec": 1000, "second": 1000, "seconds": 1000,
    "m": 60_000, "min": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
    "d": 86_400_000, "day": 86_400_000, "days": 86_400_000,
}

Duration = int | str | timedelta


def duration_ms(value: Duration) -> int:
    """``'32 seconds'``, ``'1 hour 30 min'``, ``timedelta`` or plain milliseconds -> milliseconds."""
    if isinstance(value, bool):
        raise TypeError("a duration cannot be a boolean")
    if isinstance(value, int):
        return value
    if isinstance(value, timedelta):
        return value // timedelta(milliseconds=1)
    text = value.strip().lower()
    parts = re.findall(r"(\d+)\s*([a-z]+)", text)
    if not parts or re.sub(r"(\d+)\s*([a-z]+)", "", text).strip():
        raise ValueError(f"cannot read duration {value!r}")
    try:
        return sum(int(count) * UNIT_MS[unit] for count, unit in parts)
    except KeyError as unit:
        raise ValueError(f"unknown unit {unit} in duration {value!r}") from None


@dataclass(frozen=True)
class WindowSpec:
    """Window size, slide and allowed lateness, all in milliseconds.

    ``origin`` is where slide 0 starts: ``'epoch'`` (1970-01-01 UTC), ``'first'`` (event time of
    each key's first arrival) or explicit epoch milliseconds. ``flush`` closes the slide that is
    still open at the end of the input. ``emit_empty`` also reports windows without any row.
    """

    window_ms: int
    slide_ms: int
    lateness_ms: int = 0
    origin: str | int = "epoch"
    flush: bool = False
    emit_empty: bool = False

    def __post_init__(self) -> None:
        if self.window_ms <= 0:
            raise ValueError("window must be positive")
        if not 0 < self.slide_ms <= self.window_ms:
            raise ValueError("slide must be positive and not larger than the window")
        if self.lateness_ms < 0:
            raise ValueError("lateness must not be negative")
        if isinstance(self.origin, str) and self.origin not in ("epoch", "first"):
            raise ValueError("origin must be 'epoch', 'first' or epoch milliseconds")

    @classmethod
    def of(cls, window: Duration, slide: Duration, lateness: Duration = 0, **options) -> WindowSpec:
        return cls(duration_ms(window), duration_ms(slide), duration_ms(lateness), **options)

    def with_options(self, **options) -> WindowSpec:
        return replace(self, **options)

    @property
    def pane_ms(self) -> int:
        """Width of a pane: every window is a whole number of panes, also when S does not divide W."""
        return math.gcd(self.window_ms, self.slide_ms)

    @property
    def slides_per_window(self) -> int:
        return -(-self.window_ms // self.slide_ms)

    @property
    def retained_slides(self) -> int:
        """How many past windows a late row can still reach: a revision has ``e - w <= p``."""
        return -(-self.lateness_ms // self.slide_ms)

    @property
    def origin_from_data(self) -> bool:
        return self.origin == "first"
