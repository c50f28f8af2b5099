"""Date arguments of readers."""

from __future__ import annotations

import datetime as dt


def window(start: str = "", end: str = "") -> tuple[dt.datetime | None, dt.datetime | None]:
    """[start, end) in UTC of YYYY-MM-DD arguments whose end day is included; empty is unbounded, a bad date raises ValueError."""
    at = lambda x: dt.datetime.strptime(x, "%Y-%m-%d").replace(tzinfo=dt.UTC) if x else None
    last = at(end)
    return at(start), last + dt.timedelta(days=1) if last else None
