"""Predicates over allocations as ordinary columns.

    from lifetrace.functions.predicates import alloc, malloc, free
    trace.allocations.filter((alloc.size >= KiB(4)) & ~alloc.freed).show()

Every comparison that touches a missing value is false, and ``~`` turns that
false into true. Under ``filter`` a NULL is as good as false, so comparisons
stay bare there and reach the Parquet scan; only ``~`` and ``column()`` settle
them to two values.
"""

from __future__ import annotations

import math
from fractions import Fraction
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.functions import exact
from lifetrace.plans.small import BROADCAST_ROWS
from lifetrace.operators import fields as custom
from lifetrace.session import staged



class Test:
    """A predicate; use ``column()`` (or pass it to ``where``)."""

    __test__ = False  # not a pytest class

    def __init__(self, raw: Column):
        self.raw = raw

    def __and__(self, other: "Test") -> "Test":
        return Test(self.raw & _test(other).raw)

    def __or__(self, other: "Test") -> "Test":
        return Test(self.raw | _test(other).raw)

    def __invert__(self) -> "Test":
        return Test(~self.column())

    def column(self) -> Column:
        """The predicate as a value: true or false, never null."""
        return F.coalesce(self.raw, F.lit(False))


class Value:
    """A typed operand: int, float, number (exact pair), string, bool, set."""

    def __init__(self, kind: str, col: Column, double: Column | None = None):
        self.kind, self.col, self.double = kind, col, double

    # comparisons -----------------------------------------------------------
    def _compare(self, op: str, other) -> Test:
        if self.kind == "set":
            if op not in ("==", "!="):
                raise TypeError("sets compare with == and != only")
            return self.same_set(other) if op == "==" else ~self.same_set(other)
        if isinstance(other, Value):
            return Test(_compare_values(self, op, other))
        return Test(_compare_literal(self, op, other))

    def __eq__(self, other):  # noqa: D105
        return self._compare("==", other)

    def __ne__(self, other):
        return self._compare("!=", other)

    def __lt__(self, other):
        return self._compare("<", other)

    def __le__(self, other):
        return self._compare("<=", other)

    def __gt__(self, other):
        return self._compare(">", other)

    def __ge__(self, other):
        return self._compare(">=", other)

    __hash__ = None

    def between(self, low, high) -> Test:
        """``low <= x < high``, a half-open range."""
        return (self >= low) & (self < high)

    def isin(self, items) -> Test:
        """Membership; integers and floats may be mixed and stay exact."""
        items = list(items)
        if not items:
            return Test(F.lit(False))
        if self.kind == "string" or (
            self.kind == "int" and all(isinstance(i, int) for i in items)
        ):
            values = [F.lit(i) if isinstance(i, str) else exact.integer(i) for i in items]
            return Test(self.col.isin(*values))
        out = self == items[0]
        for item in items[1:]:
            out = out | (self == item)
        return out

    def is_none(self) -> Test:
        return Test(~self._present())

    def is_not_none(self) -> Test:
        return Test(self._present())

    def _present(self) -> Column:
        present = self.col.isNotNull()
        return present if self.double is None else present | self.double.isNotNull()

    # strings -----------------------------------------------------------------
    def contains(self, text: str) -> Test:
        return Test(self._text().contains(text))

    def startswith(self, text: str) -> Test:
        return Test(self._text().startswith(text))

    def endswith(self, text: str) -> Test:
        return Test(self._text().endswith(text))

    def _text(self) -> Column:
        _must(self.kind, ("string",), "a search in text")
        return self.col

    # arithmetic: integers stay integers, overflow is missing -------------------
    def __add__(self, other):
        return _arith("try_add", self, other)

    def __radd__(self, other):
        return _arith("try_add", _value(other), self)

    def __sub__(self, other):
        return _arith("try_subtract", self, other)

    def __rsub__(self, other):
        return _arith("try_subtract", _value(other), self)

    def __neg__(self):
        return _arith("try_subtract", Value("int", exact.integer(0)), self)

    def __abs__(self):
        if self.kind == "float":
            return Value("float", F.abs(self.col))
        if self.kind == "number":
            return Value("number", F.abs(self.col), F.abs(self.double))
        return Value("int", F.abs(self.col.cast(exact.WIDE)))

    # sets ------------------------------------------------------------------
    def has(self, item: str) -> Test:
        """Membership in a set of strings."""
        return Test(F.array_contains(self.col, item))

    def same_set(self, items) -> Test:
        """Exact equality, order aside."""
        want = sorted(set(items))
        literal = F.array(*[F.lit(i) for i in want]).cast("array<string>")
        return Test(F.array_sort(F.array_distinct(self.col)) == literal)

    def length(self) -> "Value":
        return Value("int", F.size(self.col).cast("bigint"))


class Span:
    """A half-open address range."""

    def __init__(self, low: Value, high: Value):
        self.low, self.high = low, high

    def overlaps(self, low: int, high: int) -> Test:
        return (self.low < high) & (self.high > low)


class Flag(Test):
    """A boolean field: a predicate that may also be compared or missing."""

    def __init__(self, raw: Column):
        super().__init__(raw)

    def __eq__(self, other):
        return Test(self.raw == self._flag(other))

    def __ne__(self, other):
        return Test(self.raw != self._flag(other))

    @staticmethod
    def _flag(other) -> Column:
        if not isinstance(other, (bool, Flag)):
            raise TypeError(f"a comparison with a bool needs bool, not {other!r}")
        return other.raw if isinstance(other, Flag) else F.lit(other)

    __hash__ = None

    def is_none(self) -> Test:
        return Test(self.raw.isNull())

    def is_not_none(self) -> Test:
        return Test(self.raw.isNotNull())


def _test(p) -> Test:
    return p if isinstance(p, Test) else Test(p)


def _value(x) -> Value:
    if isinstance(x, Value):
        return x
    if isinstance(x, int):
        return Value("int", exact.integer(x))
    return Value("float", F.lit(float(x)))


def _finite(col: Column) -> Column:
    bad = F.isnan(col) | (F.abs(col) == F.lit(math.inf))
    return F.when(~bad, col)


def _must(kind: str, wanted: tuple[str, ...], what: str) -> None:
    if kind not in wanted:
        raise TypeError(f"{what} needs {' or '.join(wanted)}, not {kind}")


_NUMBERS = ("int", "float", "number")


def _compare_literal(v: Value, op: str, item) -> Column:
    kind = "string" if isinstance(item, str) else "bool" if isinstance(item, bool) else "number"
    _must(kind, ("string",) if v.kind == "string" else ("number",), f"a comparison with a {v.kind}")
    if v.kind == "string":
        return exact.compare(v.col, op, F.lit(item))
    if v.kind == "int":
        if isinstance(item, int):
            return exact.compare(v.col, op, exact.integer(item))
        return exact.int_with_float(v.col, op, item)
    if v.kind == "float":
        if isinstance(item, int):
            return exact.float_with_int(v.col, op, item)
        return exact.compare(F.when(~F.isnan(v.col), v.col), op, F.lit(item))
    integer = _compare_literal(Value("int", v.col), op, item)
    double = _compare_literal(Value("float", v.double), op, item)
    return F.coalesce(integer, double)


def _compare_values(a: Value, op: str, b: Value) -> Column:
    _must(b.kind, ("string",) if a.kind == "string" else _NUMBERS, f"a comparison with a {a.kind}")
    if "number" in (a.kind, b.kind):
        parts = []
        for x in _parts(a):
            for y in _parts(b):
                parts.append(_compare_values(x, op, y))
        return F.coalesce(*parts)
    if a.kind == "int" and b.kind == "float":
        return exact.int_with_double(a.col, op, b.col)
    if a.kind == "float" and b.kind == "int":
        return exact.int_with_double(b.col, exact.FLIPPED[op], a.col)
    return exact.compare(a.col, op, b.col)


def _parts(v: Value) -> list[Value]:
    if v.kind != "number":
        return [v]
    return [Value("int", v.col), Value("float", v.double)]


def _arith(name: str, a, b) -> Value:
    a, b = _value(a), _value(b)
    for v in (a, b):
        _must(v.kind, _NUMBERS, "arithmetic")
    if a.kind == "int" and b.kind == "int":
        return Value("int", getattr(F, name)(a.col.cast(exact.WIDE), b.col.cast(exact.WIDE)))
    double = lambda v: (
        F.coalesce(v.col.cast("double"), v.double) if v.kind == "number" else v.col.cast("double")
    )
    sign = 1 if name == "try_add" else -1
    wide = _finite(double(a) + sign * double(b))
    if "number" not in (a.kind, b.kind) or "float" in (a.kind, b.kind):
        return Value("float", wide)
    both = getattr(F, name)(a.col.cast(exact.WIDE), b.col.cast(exact.WIDE))
    mixed = F.when(a.col.isNull() | b.col.isNull(), wide)
    return Value("number", both, mixed)


class Varied:
    """A field that has different types in different traces.

    A comparison reads it as what it is compared with; in traces where it has another
    type it is missing. A type that it has in no trace is an error.
    """

    def __init__(self, name: str, readings: dict):
        self._name, self._readings = name, readings

    def _as(self, *kinds: str):
        for kind in kinds:
            if kind in self._readings:
                return self._readings[kind]
        raise TypeError(f"field {self._name!r} is {' or '.join(sorted(self._readings))}, not {kinds[0]}")

    def _like(self, other):
        if isinstance(other, bool):
            return self._as("bool")
        if isinstance(other, str) or isinstance(other, Value) and other.kind == "string":
            return self._as("string")
        return self._as("int", "float")

    def __eq__(self, other):
        return self._like(other) == other

    def __ne__(self, other):
        return self._like(other) != other

    def __lt__(self, other):
        return self._like(other) < other

    def __le__(self, other):
        return self._like(other) <= other

    def __gt__(self, other):
        return self._like(other) > other

    def __ge__(self, other):
        return self._like(other) >= other

    __hash__ = None

    def between(self, low, high) -> Test:
        return (self >= low) & (self < high)

    def isin(self, items) -> Test:
        out = Test(F.lit(False))
        for item in items:
            out = out | (self == item)
        return out

    def contains(self, text: str) -> Test:
        return self._as("string").contains(text)

    def startswith(self, text: str) -> Test:
        return self._as("string").startswith(text)

    def endswith(self, text: str) -> Test:
        return self._as("string").endswith(text)

    def __add__(self, other):
        return self._as("int", "float") + other

    def __sub__(self, other):
        return self._as("int", "float") - other

    def __abs__(self):
        return abs(self._as("int", "float"))

    def is_not_none(self) -> Test:
        out = Test(F.lit(False))
        for reading in self._readings.values():
            out = out | reading.is_not_none()
        return out

    def is_none(self) -> Test:
        return ~self.is_not_none()


#: Fields looked up so far; a catalog is a written table and does not change.
_LOOKED_UP: WeakKeyDictionary = WeakKeyDictionary()


def _kinds(catalog: DataFrame, name: str) -> tuple[set[str], bool]:
    """The types of a field over all traces, int and float taken together, and whether
    it has integers beyond 64 bits."""
    known = _LOOKED_UP.setdefault(catalog, {})
    if name not in known:
        known[name] = _look_up(catalog, name)
    return known[name]


def _look_up(catalog: DataFrame, name: str) -> tuple[set[str], bool]:
    seen = catalog.filter(F.col("name") == name).groupBy("type").agg(
        F.max("wide").alias("wide"), F.min("trace_id").alias("trace_id")
    ).collect()
    if not seen:
        raise LookupError(f"no trace has a field {name!r}")
    for row in seen:
        if row["type"] is None:
            raise TypeError(f"field {name!r} has no single type to filter on in trace {row['trace_id']!r}")
    kinds = {row["type"] for row in seen}
    return kinds - {"int"} if "float" in kinds else kinds, any(row["wide"] for row in seen)


class _Namespace:
    def __init__(self, ints: dict, strings: dict, custom: str | None = None, catalog: DataFrame | None = None):
        self._ints, self._strings, self._custom, self._catalog = ints, strings, custom, catalog

    def __getattr__(self, name: str):
        if name in self._ints:
            return Value("int", F.col(self._ints[name]))
        if name in self._strings:
            return Value("string", F.col(self._strings[name]))
        raise AttributeError(name)

    def of(self, trace) -> "_Namespace":
        """The same fields, with the types of custom ones looked up in the catalog."""
        return _Namespace(self._ints, self._strings, self._custom, trace.fields)

    def field(self, name: str, kind: str | None = None):
        """A custom field, read as int, float, string or bool.

        With a catalog (``of``) the type is looked up here, when the predicate is
        built: a field that no trace has, one without a single type and a wrong
        ``kind`` are errors. Where types differ between traces see ``Varied``.
        """
        if self._catalog is None:
            if kind is None:
                raise TypeError(f"give a kind for {name!r}, or look it up: malloc.of(trace).field({name!r})")
            return self._read(name, kind)
        kinds, wide = _kinds(self._catalog, name)
        if kind is not None and kind not in kinds and not (kind == "int" and "float" in kinds):
            raise TypeError(f"field {name!r} is {' or '.join(sorted(kinds))}, not {kind}")
        if kind is not None:
            return self._read(name, kind, len(kinds) == 1 and kind in kinds, wide)
        readings = {k: self._read(name, k, len(kinds) == 1, wide) for k in kinds}
        return Varied(name, readings) if len(readings) > 1 else next(iter(readings.values()))

    def _read(self, name: str, kind: str, uniform: bool = False, wide: bool = True):
        first, double = custom.typed(name, kind, self._custom, uniform, wide)
        if kind == "bool":
            return Flag(first)
        if kind == "float":
            return Value("number", first, double)
        return Value(kind, first)


class _Alloc(_Namespace):
    @property
    def freed(self) -> Flag:
        return Flag(F.col("freed"))

    @property
    def tags(self) -> Value:
        """Needs ``annotate.with_tags`` on the frame."""
        return Value("set", F.col("tags"))

    @property
    def span(self) -> Span:
        return Span(self.address, self.end)


alloc = _Alloc(
    {"id": "id", "address": "addr", "end": "end_span", "size": "size", "usable": "usable",
     "lifetime": "lifetime"},
    {},
)
malloc = _Namespace(
    {"seq": "creator", "time": "birth_t", "thread": "thr"},
    {"site": "site", "stack": "stack"},
    "custom",
)
free = _Namespace({"seq": "death", "time": "death_t"}, {}, "death_custom")


def where(allocations: DataFrame, test: Test) -> DataFrame:
    """the allocations for which the predicate is true."""
    return allocations.filter(_test(test).raw)


# Literals ----------------------------------------------------------------------

# Nanoseconds per time unit.
NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def KiB(n):  # noqa: N802
    return _scaled(n, 1024)


def MiB(n):  # noqa: N802
    return _scaled(n, 1024**2)


def GiB(n):  # noqa: N802
    return _scaled(n, 1024**3)


def duration(n, unit: str, trace_unit: str):
    """A time literal in the trace's own unit; exact where it divides."""
    if trace_unit not in NANOS:
        raise ValueError(f"no length of time in {trace_unit!r}: give a plain number")
    return _scaled(n, Fraction(NANOS[unit], NANOS[trace_unit]))


def _scaled(n, factor):
    if isinstance(n, int):
        value = Fraction(n) * factor
        return int(value) if value.denominator == 1 else float(value)
    value = float(n) * float(factor)
    if not math.isfinite(value):
        raise ValueError(f"{n} is too large for a float")
    return value


# References ----------------------------------------------------------------------


class Single(Exception):
    """A reference that names no allocation, or several."""


def _referred(allocations: DataFrame, found: DataFrame, what: str) -> tuple[DataFrame, "_Namespace"]:
    n = sum(c.startswith("_ref") and c.endswith("_creator") for c in allocations.columns)
    ints = {
        "seq": "creator", "time": "birth_t", "id": "id", "address": "addr", "end": "end_span", "size": "size",
        "usable": "usable", "lifetime": "lifetime", "thread": "thr",
    }
    name = lambda c: f"_ref{n}_{c}"
    taken = [c for c in (*ints.values(), "site") if c in allocations.columns]
    # written once: what the reference gives is checked and joined from there
    values = staged(found.select("trace_id", *[F.col(c).alias(name(c)) for c in taken]), "reference")
    per = values.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not per[0]:
        raise Single(f"{what}: no such allocation")
    if per[0] > 1:
        raise Single(f"{what}: ambiguous")
    if per[1] <= BROADCAST_ROWS:
        values = F.broadcast(values)
    known = {k: name(c) for k, c in ints.items() if c in taken}
    return allocations.join(values, "trace_id", "left"), _Namespace(known, {"site": name("site")})


def with_named(allocations: DataFrame, notes: DataFrame, name: str) -> tuple[DataFrame, "_Namespace"]:
    """F20 for many traces: each allocation beside the one of its trace with this name.

    Gives the frame to filter and the reference to use in the predicate. In a
    trace without that name the reference is missing; two in one are an error.
    """
    keyed = notes.filter(F.col("name") == name).select("trace_id", "creator")
    found = allocations.join(keyed, ["trace_id", "creator"], "left_semi")
    return _referred(allocations, found, f"named {name!r}")


def with_allocation(allocations: DataFrame, stream_id: int) -> tuple[DataFrame, "_Namespace"]:
    """F21 for many traces: each allocation beside the one of its trace with this id."""
    found = allocations.filter(F.col("id") == exact.integer(stream_id))
    return _referred(allocations, found, f"allocation {stream_id}")
