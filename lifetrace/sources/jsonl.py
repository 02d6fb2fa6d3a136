"""Traces as JSON Lines files.

One object per line, in stream order; blank lines and lines starting with #
are skipped; unknown keys are kept. A line that cannot be read is kept as a
malformed record, never an error.
"""

from __future__ import annotations

import json
from decimal import Decimal
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrace.functions.u64 import MAX_U64, U64, WIDE, fits_compact
from lifetrace.operators.lifecycle import RECORD_COLUMNS, build
from lifetrace.plans.prefix import number_rows
from lifetrace.session import staged
from lifetrace.trace import Trace

# The keys of the format, by how their values are read.
UNSIGNED = ("id", "old_id", "size", "old_size", "usable", "t", "row_bytes")
SIGNED = ("seq", "thr", "v")
ADDRESSES = ("addr", "old_addr", "arena_base")
TEXTS = ("op", "site", "unit", "title")
LOOSE = ("stack", "meta")
KNOWN = UNSIGNED + SIGNED + ADDRESSES + TEXTS + LOOSE

_PARTS = ["_path", "_start"]


def read_lines(
    spark: SparkSession, location: str | list[str], trace_pattern: str | None = None
) -> DataFrame:
    """Lines with the place they hold in their file.

    A file is split over tasks; (path, split start, row id) is the line order.
    ``trace_pattern`` is a regular expression whose first group in the path is
    the trace id; without it every file is a trace.
    """
    text = spark.read.option("lineSep", "\n").text(location)
    file_path = F.col("_metadata.file_path")
    trace_id = file_path if trace_pattern is None else F.regexp_extract(file_path, trace_pattern, 1)
    lines = text.select(
        trace_id.alias("trace_id"),
        file_path.alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.btrim("value", F.lit(" \t\r")).alias("line"),
    ).filter("line <> '' and not startswith(line, '#')")
    # Numbered after the filter, so the ids of a split have no holes.
    return lines.withColumn("_row", F.monotonically_increasing_id())


# The known keys of a line, taken out of its VARIANT in one step.
_TAKEN = "struct<" + ",".join(f"{k}:variant" for k in KNOWN) + ">"


def _kind(key: str) -> Column:
    return F.col(f"_k_{key}")


def _get(key: str, kind: str) -> Column:
    return F.try_variant_get(F.col(f"_f.{key}"), "$", kind)


_INTEGER = r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$"


def _whole_double(d: Column) -> Column:
    """A double cut to an integer, exact beyond 2^63 too."""
    step = float(1 << 32)
    high = F.floor(F.abs(d) / step)
    low = F.floor(F.abs(d) - high.cast("double") * step)
    whole = high.cast(WIDE) * F.lit(Decimal(1 << 32)).cast("decimal(10,0)") + low.cast("bigint")
    return F.when(d < 0, -whole).otherwise(whole).cast(WIDE)


def _number(key: str, low: int, high: int) -> Column:
    """A number cut toward zero and clamped; null when the key is absent."""
    lo, hi = (F.lit(Decimal(x)).cast(WIDE) for x in (low, high))
    exact = F.when(_kind(key).rlike(_INTEGER), _get(key, WIDE))
    double = _get(key, "double")
    rough = (
        F.when(double >= float(1 << 64), hi)
        .when(double <= -float(1 << 64), lo)
        .otherwise(_whole_double(double))
    )
    value = F.when(_kind(key).rlike(_INTEGER), exact).otherwise(rough)
    return F.when(_kind(key).isNotNull(), F.greatest(F.least(value, hi), lo))


def _wrapped_digits(text: Column, wrap: Column) -> Column:
    """A decimal of any length modulo 2^64, eighteen digits at a time."""
    pieces = F.ceil(F.length(text) / 18).cast("int")
    padded = F.lpad(text, pieces * 18, F.lit("0"))
    step = F.lit(Decimal(10**18)).cast("decimal(19,0)")
    return F.aggregate(
        F.sequence(F.lit(0), pieces - 1),
        F.lit(Decimal(0)).cast(WIDE),
        lambda done, i: (
            (done.cast(U64) * step + F.substr(padded, i * 18 + 1, F.lit(18)).cast(WIDE)) % wrap
        ).cast(WIDE),
    )


def address(text: Column) -> Column:
    """0x hex, bare decimal or bare hex text as an unsigned number."""
    hexed = lambda s: F.conv(s, 16, 10).cast(U64)
    wrap = F.lit(Decimal(1 << 64)).cast(WIDE)
    return (
        F.when(text.rlike("^0[xX][0-9a-fA-F]{1,16}$"), hexed(F.substring(text, 3, 16)))
        .when(text.rlike("^[0-9]{1,38}$"), (text.cast(WIDE) % wrap).cast(U64))
        .when(text.rlike("^[0-9]{39,}$"), _wrapped_digits(text, wrap).cast(U64))
        .when(text.rlike("^[0-9a-fA-F]{1,16}$"), hexed(text))
    )


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r"^\{\"x\":(.*)\}$", "$1")


def _extras() -> Column:
    """The unknown keys, in order, as the body of a JSON object.

    Numbers and nested values keep their text; strings are quoted again.
    """
    entries = F.filter(F.map_entries("_text"), lambda e: ~e["key"].isin(*KNOWN))

    def one(e: Column) -> Column:
        value = F.element_at("_typed", e["key"])
        text = (
            F.when(e["value"].isNull(), "null")
            .when(F.schema_of_variant(value) == "STRING", F.to_json(value))
            .otherwise(e["value"])
        )
        return F.concat(_quoted(e["key"]), F.lit(":"), text)

    body = F.concat_ws(",", F.transform(entries, one))
    return F.when(F.size(entries) > 0, body)


def decode(lines: DataFrame, column: str = "line") -> DataFrame:
    """One typed row per line; ``op`` is null where a line is malformed."""
    parsed = lines.withColumn("_v", F.try_parse_json(column)).withColumn(
        "_f", F.expr(f"try_cast(_v as {_TAKEN})")
    )
    parsed = parsed.withColumns({f"_k_{k}": F.schema_of_variant(f"_f.{k}") for k in KNOWN})
    kinds = {k: _kind(k) for k in KNOWN}
    number = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    fine = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    for k in UNSIGNED + SIGNED:
        fine = fine & (kinds[k].isNull() | kinds[k].rlike(number))
    for k in ADDRESSES + ("site", "unit", "title"):
        fine = fine & (kinds[k].isNull() | (kinds[k] == "STRING"))
    op = _get("op", "string")
    fine = fine & F.coalesce((kinds["op"] == "STRING") & (F.octet_length(op) == 1), F.lit(False))

    frames = F.transform(
        F.filter(
            _get("stack", "array<variant>"),
            lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)),
        ),
        lambda x: x.cast("string"),
    )
    stack = F.when(kinds["stack"].startswith("ARRAY"), F.array_join(frames, "\n"))
    checked = parsed.withColumns(
        {
            "_fine": fine,
            "_text": F.from_json(column, "map<string,string>"),
            "_typed": F.expr("try_cast(_v as map<string,variant>)"),
        }
    )
    ok = lambda c: F.when(F.col("_fine"), c)
    top = 1 << 63
    columns = {
        "op": ok(op),
        **{k: ok(_number(k, 0, MAX_U64)).cast(U64) for k in UNSIGNED},
        **{k: ok(_number(k, 1 - top, top - 1)).cast("bigint") for k in SIGNED},
        **{k: ok(address(_get(k, "string"))) for k in ADDRESSES},
        **{k: ok(_get(k, "string")) for k in ("site", "unit", "title")},
        "stack": ok(stack),
        "meta": ok(F.to_json(_get("meta", "variant"))),
        "extras": ok(_extras()),
    }
    return checked.select(
        *lines.columns, F.col("_v").isNotNull().alias("_read"), *[c.alias(n) for n, c in columns.items()]
    )


_SCAN = json.JSONDecoder()


def _tidy(line: str) -> str | None:
    """A line with repeated keys or text behind the object, made plain JSON.

    Of a repeated key of the format the last counts, of a custom key the first.
    """
    kept: dict[str, str] = {}
    try:
        i = line.index("{") + 1
        while True:
            while line[i].isspace():
                i += 1
            if line[i] != '"':
                return None
            key, i = scanstring(line, i + 1)
            i = line.index(":", i) + 1
            while line[i].isspace():
                i += 1
            _, end = _SCAN.raw_decode(line, i)
            if key in KNOWN or key not in kept:
                kept[key] = line[i:end]
            i = end
            while line[i].isspace():
                i += 1
            if line[i] == "}":
                break
            if line[i] != ",":
                return None
            i += 1
    except (ValueError, IndexError):
        return None
    return "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in kept.items()) + "}"


def tidied(lines: DataFrame, column: str = "line") -> DataFrame:
    """Second reading of lines Spark's JSON reader refused."""

    @F.pandas_udf("string")
    def tidy(texts: pd.Series) -> pd.Series:
        return texts.map(_tidy)

    return lines.withColumn(column, F.coalesce(tidy(F.col(column)), F.col(column)))


def headers(decoded: DataFrame, all_ids: DataFrame) -> DataFrame:
    """S3: one row per trace; a later header overrides what it gives."""
    h = decoded.filter("op = 'H'")
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ord")))
    found = h.groupBy("trace_id").agg(
        F.lit(True).alias("has_header"),
        F.max_by(F.coalesce("v", F.lit(1)), "ord").alias("version"),
        *[last(n).alias(n) for n in ("unit", "title", "row_bytes", "arena_base", "meta")],
    )
    zero = F.lit(0).cast(U64)
    return all_ids.join(found, "trace_id", "left").select(
        "trace_id",
        F.coalesce("has_header", F.lit(False)).alias("has_header"),
        F.coalesce("version", F.lit(1)).cast("bigint").alias("version"),
        F.coalesce("unit", F.lit("ns")).alias("unit"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("row_bytes", zero).alias("row_bytes"),
        F.coalesce("arena_base", zero).alias("arena_base"),
        F.coalesce("meta", F.lit("")).alias("meta"),
    )


def load_decoded(
    spark: SparkSession, location: str | list[str], trace_pattern: str | None = None
) -> DataFrame:
    """Decoded lines with their dense place ``ord`` in each trace."""
    rows = decoded_once(read_lines(spark, location, trace_pattern))
    return number_rows(rows, ["trace_id"], _PARTS, "_row", "ord")


def decoded_once(lines: DataFrame) -> DataFrame:
    """``decode`` as every reader uses it, batch or stream: written once.

    The few lines the JSON reader refused are read again by ``tidied``; only
    they pass through Python.
    """
    first = staged(decode(lines), "decoded")
    refused = first.filter("not _read and startswith(line, '{')")
    if not refused.isEmpty():
        again = decode(tidied(refused.select(*lines.columns)))
        kept = first.filter("_read or not startswith(line, '{')")
        first = staged(kept.unionByName(again), "decoded")
    return first.drop("_read")


def to_records(decoded: DataFrame) -> DataFrame:
    """Decoded lines as the records ``lifecycle`` resolves."""
    header = F.col("op") == "H"
    body = lambda name: F.when(~F.coalesce(header, F.lit(False)), F.col(name))
    columns = {n: body(n) for n in RECORD_COLUMNS if n in decoded.columns}
    columns["trace_id"], columns["ord"], columns["op"] = F.col("trace_id"), F.col("ord"), F.col("op")
    columns["id"] = F.when(header, F.coalesce("v", F.lit(1)).cast(U64)).otherwise(F.col("id"))
    columns["kid"] = F.when(F.col("op") == "F", F.col("id")).when(F.col("op") == "R", F.col("old_id"))
    columns["dseq"] = body("seq")
    return decoded.select(*[columns[n].alias(n) for n in RECORD_COLUMNS])


_NUMBERS = ["id", "kid", "addr", "size", "usable", "t", "old_addr", "old_size"]


def load(
    spark: SparkSession,
    location: str | list[str],
    trace_pattern: str | None = None,
    path: str | None = None,
    compact: bool | None = None,
) -> Trace:
    """Read, resolve and store the traces of a location (a file, folder, glob).

    ``compact`` None checks whether every number is below 2^62 and then keeps
    them as BIGINT, the faster form; True or False decides without looking.
    """
    decoded = load_decoded(spark, location, trace_pattern)
    records = to_records(decoded)
    if compact is None:
        compact = fits_compact(records, _NUMBERS)
    if compact:
        records = records.withColumns({n: F.col(n).cast("bigint") for n in _NUMBERS})
    ids = decoded.select("trace_id").distinct()
    return build(records, headers(decoded, ids), path)


def content_ids(spark: SparkSession, location: str) -> DataFrame:
    """(path, sha256 id) of trace files; for files under 2 GB."""
    files = spark.read.format("binaryFile").load(location)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("trace_id"))


def lines_of(records: DataFrame) -> DataFrame:
    """Records as JSON text, one line each: (trace_id, ord, line)."""
    hexed = lambda c: F.when(
        F.col(c).isNotNull(), F.concat(F.lit("0x"), F.lower(F.conv(F.col(c).cast("string"), 10, 16)))
    )
    free = F.col("op") == "F"
    core = F.to_json(
        F.struct(
            "op", F.when(free, F.col("kid")).otherwise(F.col("id")).alias("id"),
            F.when(F.col("op") == "R", F.col("kid")).alias("old_id"),
            hexed("addr").alias("addr"), "size", "usable", hexed("old_addr").alias("old_addr"),
            "old_size", "t", F.col("dseq").alias("seq"), "thr", "site",
            F.split("stack", "\n").alias("stack"), "title",
        )
    )
    body = F.expr("substring(core, 2, length(core) - 2)")
    return records.withColumn("core", core).select(
        "trace_id", "ord",
        F.concat(F.lit("{"), F.concat_ws(",", body, "extras"), F.lit("}")).alias("line"),
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (trace_id, ord, line) in order, a folder per trace."""
    (
        lines.repartitionByRange("trace_id", "ord")
        .sortWithinPartitions("trace_id", "ord")
        .select("trace_id", "line")
        .write.partitionBy("trace_id")
        .text(path)
    )
