"""Joining a value per trace onto many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrace.session import staged

BROADCAST_ROWS = 100_000


def per_trace(values: DataFrame, name: str = "per-trace") -> DataFrame:
    """``values`` (one row per trace) ready to be joined on ``trace_id``.

    Written first, so its size is known: up to BROADCAST_ROWS rows it is sent
    to every task and the long side stays where it is - a trace holding most
    of the rows would otherwise meet in one place. Beyond that the join
    shuffles, and no single trace is that large a part any more.
    """
    table = staged(values, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
