"""Spans of time, absolute or relative to a moment."""

from __future__ import annotations

from datetime import datetime, timedelta

#: Seconds of a unit: a month has 31 days and a year 356, fixed values that stored queries rely on.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 31 * 86400, "year": 356 * 86400}
EARLIEST = datetime(1970, 1, 1)


def delta(value: int, unit: str) -> timedelta:
    """So many units; plural names are understood."""
    name = unit.lower().removesuffix("s")
    if name not in UNITS:
        raise ValueError(f"no such unit of time: {unit}")
    return timedelta(seconds=value * UNITS[name])


def moment(at: datetime | tuple[int, str] | None, now: datetime, default: datetime) -> datetime:
    """A time as it is, (number, unit) as so long from now (before it, if negative), None as the default."""
    if at is None:
        return default
    return at if isinstance(at, datetime) else now + delta(*at)


def span(since: datetime | tuple[int, str] | None, till: datetime | tuple[int, str] | None, now: datetime) -> tuple[datetime, datetime]:
    """The bounds of a span; without a beginning since 1970, without an end until now."""
    low, high = moment(since, now, EARLIEST), moment(till, now, now)
    if low > high:
        raise ValueError(f"the span ends before it begins: {low} > {high}")
    return low, high


def parse_delta(text: str) -> timedelta:
    """``-5m``, ``2 hours``, ``1d``: a number and a unit or its first letter (mo for months)."""
    text = text.strip().lower()
    digits = len(text) - len(text.lstrip("+-0123456789"))
    number, unit = int(text[:digits]), text[digits:].strip()
    short = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "y": "year"}
    return delta(number, short.get(unit, unit))
