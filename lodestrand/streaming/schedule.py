"""When something is due (F18, F19, M19); times are epoch milliseconds, None means never."""

from __future__ import annotations

import random
from collections.abc import Callable

DAY = 24 * 60 * 60 * 1000


def fresh(synced_at: int | None, count: int, now: int, same_rules: bool = True, age: int = DAY) -> bool:
    """Whether a cached table may still be used: not empty, made under the same rules, younger than ``age``."""
    return bool(count) and same_rules and synced_at is not None and 0 <= now - synced_at < age


def scan_reason(forced: bool, now: int, completed_at: int | None, through: int | None, interval: int = DAY) -> str | None:
    """Why a full scan is due: manual, scheduled, gap (the change log is behind) or None."""
    if forced:
        return "manual"
    if completed_at is None or now - completed_at >= interval:
        return "scheduled"
    return "gap" if through is not None and now - through >= interval else None


def next_due(succeeded_at: int, interval: int = 5 * 60 * 1000, jitter: int = 60 * 1000, draw: Callable[[], float] = random.random) -> int:
    """When the next run is due; a failed run does not move it."""
    return succeeded_at + interval + int(draw() * jitter)
