"""Unsigned 64-bit values and exact byte sums.

A column is BIGINT where every value is known to be below 2^62 (the compact
form, chosen by a check when a trace is built) and DECIMAL(20,0) otherwise.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = "decimal(20,0)"
WIDE = "decimal(38,0)"
MAX_U64 = 18446744073709551615
COMPACT_LIMIT = 1 << 62


def is_compact(df: DataFrame, name: str = "addr") -> bool:
    return isinstance(df.schema[name].dataType, T.LongType)


def byte_sum(col: Column | str) -> Column:
    """Exact sum of byte counts; never overflows, 0 for no rows."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(col.cast(U64)), F.lit(0).cast(WIDE)).cast(WIDE)


def saturating_end(addr: Column, span: Column, compact: bool) -> Column:
    if compact:
        return addr + span
    return F.least(addr.cast(WIDE) + span.cast(WIDE), F.lit(Decimal(MAX_U64)).cast(WIDE)).cast(U64)


def div_pow2(col: Column, bits: int, compact: bool) -> Column:
    """col div 2^bits as BIGINT (bits >= 2 when not compact)."""
    if compact:
        return F.shiftright(col, bits)
    return F.call_function("div", col, F.lit(Decimal(1 << bits)).cast(U64)).cast("bigint")


def int_div(col: Column, by: Column | int) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("div", col, by)


def to_hex(col: Column, compact: bool) -> Column:
    """Lower-case 0x text of an address."""
    if compact:
        return F.concat(F.lit("0x"), F.lower(F.hex(col)))
    return F.concat(F.lit("0x"), F.lower(F.conv(col.cast("string"), 10, 16)))


def fits_compact(df: DataFrame, names: list[str]) -> bool:
    """True when every value of the columns is below 2^62 (one small job)."""
    tops = df.agg(*[F.max(n).alias(n) for n in names]).first()
    return all(v is None or int(v) < COMPACT_LIMIT for v in tops)
