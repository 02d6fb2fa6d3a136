"""Comparisons between integers and doubles that never round.

Spark compares a DECIMAL with a DOUBLE as doubles, which makes neighbours
above 2^53 equal. Here the bound is moved to the integer side instead.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
_OPS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
FLIPPED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def integer(value: int) -> Column:
    """An exact integer literal: BIGINT where it fits, so filters push down."""
    if -(1 << 63) <= value < (1 << 63):
        return F.lit(value).cast("bigint")
    return F.lit(Decimal(value)).cast(WIDE)


def _constant(col: Column, truth: bool) -> Column:
    """``truth`` where the column is known, missing where it is not."""
    return F.when(col.isNotNull(), F.lit(truth))


def int_with_float(col: Column, op: str, bound: float) -> Column:
    """Integer column against a float literal."""
    if math.isnan(bound):
        return F.lit(None).cast("boolean")
    if math.isinf(bound):
        below = bound > 0
        return _constant(col, {"<": below, "<=": below, ">": not below, ">=": not below, "==": False, "!=": True}[op])
    low, high = math.floor(Fraction(bound)), math.ceil(Fraction(bound))
    if op in ("==", "!="):
        if low != high:
            return _constant(col, op == "!=")
        return _OPS[op](col, integer(low))
    return _OPS[op](col, integer(high if op in ("<", ">=") else low))


def float_with_int(col: Column, op: str, bound: int) -> Column:
    """Double column against an integer literal."""
    col = F.when(~F.isnan(col), col)
    try:
        near = float(bound)
    except OverflowError:
        return int_compare_constant(col, op, bound > 0)
    if Fraction(near) == bound:
        return _OPS[op](col, F.lit(near))
    if op in ("==", "!="):
        return _constant(col, op == "!=")
    below = near if near < bound else math.nextafter(near, -math.inf)
    above = near if near > bound else math.nextafter(near, math.inf)
    if op in ("<", "<="):
        return col <= F.lit(below)
    return col >= F.lit(above)


def int_compare_constant(col: Column, op: str, bound_is_huge: bool) -> Column:
    less = bound_is_huge
    return _constant(col, {"<": less, "<=": less, ">": not less, ">=": not less, "==": False, "!=": True}[op])


def int_with_double(x: Column, op: str, d: Column) -> Column:
    """Integer column against a double column."""
    step = float(1 << 50)
    limit = float(1 << 100)
    x = x.cast(WIDE)
    floor = d - F.pmod(d, F.lit(1.0))
    high = F.floor(floor / step)
    low = (floor - high.cast("double") * step).cast("bigint")
    whole = high.cast(WIDE) * F.lit(Decimal(1 << 50)).cast("decimal(17,0)") + low
    below = whole.cast(WIDE)
    fraction = floor != d
    above = F.when(fraction, below + 1).otherwise(below)
    inner = {
        "==": (x == below) & ~fraction,
        "!=": (x != below) | fraction,
        "<": x < above,
        "<=": x <= below,
        ">": x > below,
        ">=": x >= above,
    }[op]
    huge = F.abs(d) >= limit
    outside = {
        "==": F.lit(False), "!=": F.lit(True), "<": d > 0, "<=": d > 0, ">": d < 0, ">=": d < 0,
    }[op]
    return F.when(x.isNull() | d.isNull() | F.isnan(d), None).when(huge, outside).otherwise(inner)


def compare(a: Column, op: str, b: Column) -> Column:
    return _OPS[op](a, b)
