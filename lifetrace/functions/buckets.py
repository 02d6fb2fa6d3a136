"""Power-of-two buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lifetrace.functions.u64 import MAX_U64

LABELS = [f"{1 << i}..{min(1 << (i + 1), MAX_U64)}" for i in range(64)]


def bucket(value: Column) -> Column:
    """``"lo..hi"`` with lo the highest power of two not above the value.

    Counted in binary digits, not with a floating logarithm.
    """
    digits = F.length(F.conv(value.cast("string"), 10, 2))
    return F.when(value == 0, "0").when(
        value > 0, F.element_at(F.array(*[F.lit(x) for x in LABELS]), digits)
    )
