"""Arguments of the queries: ranges, dates, modes and limits."""

from __future__ import annotations

from datetime import datetime, timezone


def search_mode(mode: str) -> str:
    found = mode.strip().lower() or "and"
    if found not in ("and", "or"):
        raise ValueError(f"invalid search mode {mode!r} (want and|or)")
    return found


def page_range(page: int | None = None, context: int = 0, start: int | None = None, end: int | None = None) -> tuple[int, int] | None:
    """(first, last) page indexes, inclusive, from a page with context or a start and end; None for all pages."""
    if context < 0:
        raise ValueError("context must be zero or more")
    if page is not None:
        if start is not None or end is not None:
            raise ValueError("give a page or a start and end, not both")
        if page < 0:
            raise ValueError("page must be zero or more")
        return max(page - context, 0), page + context
    if context:
        raise ValueError("context needs a page")
    if start is None and end is None:
        return None
    if start is None or end is None or start < 0 or end < start:
        raise ValueError("start and end must both be given, start no greater than end")
    return start, end


def time_bound(text: str | None) -> datetime | None:
    """RFC 3339, or a day for its midnight in UTC; blank is no bound."""
    text = (text or "").strip()
    if not text:
        return None
    try:
        if len(text) == 10:
            return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
        found = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"invalid time {text!r} (want RFC 3339 or YYYY-MM-DD)") from None
    if found.tzinfo is None:
        raise ValueError(f"invalid time {text!r} (want RFC 3339 or YYYY-MM-DD)")
    return found


def window(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be zero or more")


def concurrency(n: int) -> int:
    if n < 1:
        raise ValueError("concurrency must be one or more")
    return n
