"""Allocations that meet a live region."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lifetrace.plans import ranges


def births_meeting_live(allocations: DataFrame, pair_limit: int = ranges.PAIR_LIMIT) -> DataFrame:
    """Creators whose span intersects one that is live when they are born.

    The allocation a resize ends is dead by then, so it does not count.
    """
    return ranges.births_in_live(allocations, pair_limit)
