"""Join helpers that keep broadcasts bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written

# rows of a calendar, weather or season table that every executor may hold
BROADCAST_ROWS = 1_000_000


def broadcast_up_to(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the caller's proven bound on rows allows it.

    Beyond the limit the frame goes in unhinted: Spark then measures the side
    at run time and shuffles both sides if it is large.
    """
    return F.broadcast(df) if rows <= limit else df


def measured(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a side that should be small, count it, and broadcast it only if it is.

    A larger one joins by shuffle. Planning alone would guess the size of an
    aggregate, and a wrong guess shuffles all counts.
    """
    stored = written(df, name)
    return broadcast_up_to(stored, stored.count(), limit)


def days_between(start, end) -> int:
    return (end - start).days + 1
