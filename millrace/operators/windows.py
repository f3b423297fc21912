"""Time windows in milliseconds, UTC, from a clock that the caller gives."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from millrace.functions.dates import parse_date
from millrace.functions.values import DAY_MS

FOREVER = float("inf")
# Presets that reach back from now, in days; the dashboard's ranges.
_LAST = {"last_7_days": 7, "last_30_days": 30, "last_90_days": 90, "last_365_days": 365}
RANGES = ("today", "yesterday", "7d", "30d", "90d", "all")


@dataclass(frozen=True)
class Range:
    """A dashboard range. ``rolling`` is its length if it moves with the clock; ``all`` is the run itself."""

    key: str
    start: float
    end: float
    rolling: int | None = None
    all: bool = False


def ms(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def moment(text: str) -> int | None:
    """Milliseconds of a typed-in date or time, or an epoch number."""
    s = text.strip()
    if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", s):
        n = float(s)
        return int(n if n >= 1e11 else n * 1000) if n >= 1e9 else None
    found = parse_date(s)
    return None if found is None else ms(datetime.fromisoformat(found).replace(tzinfo=UTC))


def window(config: dict, now: datetime) -> tuple[float, float]:
    """First and last millisecond of a Date range's settings."""
    at, mode = ms(now), config.get("mode", "preset")
    if mode == "between":
        start, end = moment(str(config.get("from") or "")), moment(str(config.get("to") or ""))
        if end is not None and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", str(config["to"]).strip()):
            end += DAY_MS - 1
        return start or 0, FOREVER if end is None else end
    if mode == "rolling":
        return at - int(config.get("days", 30)) * DAY_MS, at
    day = datetime(now.year, now.month, now.day, tzinfo=UTC)
    week, month = day - timedelta(days=day.weekday()), day.replace(day=1)
    preset = config.get("preset", "last_30_days")
    if preset in _LAST:
        return at - _LAST[preset] * DAY_MS, at
    back = {"yesterday": (day - timedelta(days=1), day), "last_week": (week - timedelta(days=7), week), "last_month": ((month - timedelta(days=1)).replace(day=1), month)}
    if preset in back:
        return ms(back[preset][0]), ms(back[preset][1]) - 1
    start = {"today": day, "this_week": week, "this_month": month}.get(preset)
    return (0 if start is None else ms(start)), at


def dashboard_range(key: str, now: datetime) -> Range:
    """today, yesterday, 7d, 30d, 90d or all; anything else is 7d."""
    at, day = ms(now), ms(datetime(now.year, now.month, now.day, tzinfo=UTC))
    if key == "today":
        return Range(key, day, at)
    if key == "yesterday":
        return Range(key, day - DAY_MS, day - 1)
    if key == "all":
        return Range(key, 0, at, all=True)
    days = {"7d": 7, "30d": 30, "90d": 90}.get(key, 7)
    return Range(key, at - days * DAY_MS, at, rolling=days * DAY_MS)


def slides(config: dict) -> bool:
    """The window moves with the clock, so its numbers change without new data."""
    return config.get("mode", "preset") in ("preset", "rolling")
