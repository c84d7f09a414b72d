"""Bracket ranges: [-1h], [-7d..-1d], [@d], [-1h][@h] and timestamps, as bounds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from ..lang.ast import Range

SNAPS = ("s", "m", "h", "d", "w")


def snapped(t: datetime, unit: str) -> datetime:
    if unit not in SNAPS:
        raise ValueError(f"a time is snapped to one of {', '.join(SNAPS)}, not {unit}")
    t = t.replace(microsecond=0)
    if unit == "s":
        return t
    t = t.replace(second=0)
    if unit == "m":
        return t
    t = t.replace(minute=0)
    if unit == "h":
        return t
    t = t.replace(hour=0)
    return t if unit == "d" else t - timedelta(days=t.weekday())


def instant(bound, now: datetime) -> datetime:
    kind, value = bound
    if kind == "shift":
        return now + timedelta(microseconds=value)
    if kind == "snap":
        return snapped(now, value)
    t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def bounds(ranges: list[Range], now: datetime) -> tuple[datetime | None, datetime | None]:
    """Low (inclusive) and high (exclusive) bound of the ranges one after the other; a lone snap after a shift snaps it."""
    low = high = None
    for i, r in enumerate(ranges):
        if i and r.high is None and r.low[0] == "snap" and low is not None:
            low = snapped(low, r.low[1])
            continue
        low = instant(r.low, now)
        high = instant(r.high, now) if r.high is not None else now if r.low[0] != "at" else None
    return low, high
