"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every contract that counts words by white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text() -> Column:
    """The text of a row; a null text is an empty one."""
    return F.coalesce(F.col("text"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used several times, or inside a lambda, would be computed again at
    each use; as the only element of an array it is bound to a variable.
    """
    return F.transform(F.array(value), body)[0]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names near the wanted ones that ``df`` does not use yet."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow string column, without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of ``column``.

    A single longer text is a piece of its own; nothing is cut.
    """
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)
