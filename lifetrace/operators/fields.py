"""The custom fields of records.

``extras`` is the body of a JSON object, as written. Tables keep it parsed as well,
as VARIANT columns (``custom``, ``death_custom``) that Spark shreds into typed Parquet
columns, so a predicate over a field reads that field only, and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes a field is seen holding, as bits.
NULL, BOOL, INT, STRING, OTHER, FLOAT = 1, 2, 4, 8, 16, 32
WIDE = 64  # beside INT: an integer beyond 64 bits was seen

_BIG_INTEGER = r"^DECIMAL\((19|[23]\d),0\)$"


def as_object(extras: str | Column = "extras") -> Column:
    body = F.col(extras) if isinstance(extras, str) else extras
    return F.concat(F.lit("{"), body, F.lit("}"))


def path(name: str) -> str:
    """JSON path of a top-level key, whatever characters it has."""
    quoted = name.replace("'", "\\'")
    return f"$['{quoted}']"


def parsed(extras: str | Column = "extras") -> Column:
    """The VARIANT that tables keep beside the text; null where there is none."""
    return F.try_parse_json(as_object(extras))


def shape_bit(value: Column) -> Column:
    """The bit of a value's shape; a number written with a fraction is a float."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", NULL)
        .when(kind == "BOOLEAN", BOOL)
        .when(kind == "STRING", STRING)
        .when(kind.rlike("^(OBJECT|ARRAY)"), OTHER)
        .when(kind == "BIGINT", INT)
        .when(kind.rlike(_BIG_INTEGER), INT | WIDE)
        .otherwise(FLOAT)
    )


def field_values(events: DataFrame, extras: str = "extras") -> DataFrame:
    """One row per (event, field): ``name``, ``raw`` JSON text, ``shape`` bits.

    Two readings of the text, as written and typed, are put side by side before the
    rows are multiplied, so that a row carries its own entry only.
    """
    texts = F.map_entries(F.from_json(as_object(extras), "map<string,string>"))
    values = F.map_entries(F.from_json(as_object(extras), "map<string,variant>"))
    both = F.transform(
        F.arrays_zip(texts.alias("t"), values.alias("v")),
        lambda e: F.struct(e["t"]["key"].alias("name"), e["t"]["value"].alias("_text"), e["v"]["value"].alias("_value")),
    )
    split = events.filter(F.col(extras).isNotNull()).select("*", F.inline(both))
    # a null is no typed entry
    shape = F.when(F.col("_text").isNull(), NULL).otherwise(shape_bit(F.col("_value")))
    return (
        split.withColumn("shape", shape)
        .withColumn(
            "raw",
            F.when(F.col("_text").isNull(), "null")
            .when(F.col("shape") == STRING, F.to_json("_value"))
            .otherwise(F.col("_text")),
        )
        .drop("_text", "_value")
    )


def catalog_of(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """F27 out of stored tables: fields are listed from the stored values, not from text."""
    cols = ["trace_id", "ord", "custom"]
    dropped = rejects.filter("reason = 'no-addr'").select(*cols)
    rows = events.select(*cols).unionByName(dropped).filter(F.col("custom").isNotNull())
    entries = rows.sparkSession.tvf.variant_explode(F.col("custom").outer())
    values = rows.lateralJoin(entries).select(
        "trace_id", "ord", F.col("key").alias("name"), shape_bit(F.col("value")).alias("shape")
    )
    seen = values.groupBy("trace_id", "name").agg(
        F.bit_or("shape").alias("shapes"),
        F.count(F.lit(1)).alias("events"),
        F.min("ord").alias("first_ord"),
    )
    has = lambda bits: F.col("shapes").bitwiseAND(F.lit(bits)) != 0
    scalars = F.col("shapes").bitwiseAND(F.lit(BOOL | INT | STRING | FLOAT))
    kind = (
        F.when(has(OTHER), None)
        .when(scalars == INT, "int")
        .when(scalars.isin(FLOAT, INT | FLOAT), "float")
        .when(scalars == STRING, "string")
        .when(scalars == BOOL, "bool")
    )
    return seen.select(
        "trace_id", "name", kind.alias("type"), has(NULL).alias("optional"), "events", "first_ord",
        has(WIDE).alias("wide"),
    )


def catalog(trace) -> DataFrame:
    """per field its type, whether it may be null, and its events.

    Records dropped for want of an address count too. Integers and floats are
    one numeric type; a field seen holding an object or two types has none.
    """
    return catalog_of(trace.events, trace.rejects).drop("wide")


def typed(
    name: str, kind: str, column: str | Column = "custom", uniform: bool = False, wide: bool = True
) -> tuple[Column, Column | None]:
    """A field's value as a column, read from the stored VARIANT.

    A value of another type is missing; where the catalog says that there is none
    (``uniform``) the type need not be looked at and the read alone reaches the scan.
    ``wide`` tells whether integers may need more than 64 bits. ``float`` gives a pair:
    the exact integer where one was written, else the double, so integers in a float
    field still compare exactly.
    """
    column = F.col(column) if isinstance(column, str) else column
    read = lambda t: F.try_variant_get(column, path(name), t)
    shape = F.schema_of_variant(read("variant"))
    of = lambda test, value: value if uniform else F.when(test, value)
    if kind == "bool":
        return of(shape == "BOOLEAN", read("boolean")), None
    if kind == "string":
        return of(shape == "STRING", read("string")), None
    whole = (shape == "BIGINT") | shape.rlike(_BIG_INTEGER)
    if kind == "int":
        return of(whole, read("decimal(38,0)" if wide else "bigint")), None
    number = shape.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    return F.when(whole, read("decimal(38,0)")), F.when(number & ~whole, read("double"))
