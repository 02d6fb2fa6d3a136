"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments. Two fingerprints that differ in at most two
bits differ in at most one bit of the first segment, or agree in the second. So
the index holds every fingerprint under both segments, and a query enumerates the
Hamming ball of radius 1 in the first segment (33 values) and of radius 0 in the
second, fetches the entries found there and verifies the complete distance.

Crowded index entries (a segment value that many fingerprints share) would make
pairs without end. Fingerprints that meet one are linked another, exact way: two
of them are within two bits of each other exactly if the balls of radius 1 around
the complete fingerprints have a point in common; a point is in at most 65 balls,
and all that meet at a point are linked to the least of them.

Texts enter as one row per distinct fingerprint, so copies are never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.llm.common import as_bytes, free_names, slices
from lifetrace.llm.graph import components
from lifetrace.session import staged

SHINGLE = 3
SEED = 42
SEGMENT_BITS = 32
#: Entries of an index value from which on the other exact way is taken.
CROWDED = 32
_CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text: 3-word shingles, XXH64 (seed 42), majority per bit.

    A text without words has fingerprint 0; one with fewer than three words has
    its whole sequence as the only shingle.
    """
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        part = words[lo : min(lo + _CHUNK, n) + SHINGLE - 1]
        hashes = np.array(
            [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(part, part[1:], part[2:])],
            dtype=">u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the text column replaced by ``fp`` (bigint, the 64 bits)."""
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept, F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches):
        for batch in slices(batches, text, 32 << 20):
            values = [fingerprint(t or b"") for t in as_bytes(batch.column(text))]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), fp], [*kept, "fp"])

    return rows.select(*kept, text).mapInArrow(run, schema)


def _segments(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, SEGMENT_BITS), fp.bitwiseAND((1 << SEGMENT_BITS) - 1)


def _ball(value: Column, bits: int) -> Column:
    """The value and its neighbours at one bit."""
    masks = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(bits))]
    return F.transform(F.lit(masks), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is within two bits; ``prints`` has distinct ``fp``.

    Crowded neighbourhoods come as stars instead of all pairs, with the same
    connected components.
    """
    first, second = _segments(F.col("fp"))

    def keyed(ball: Column) -> DataFrame:
        cells = F.concat(
            F.transform(ball, lambda v: F.struct(F.lit(0).alias("seg"), v.alias("val"))),
            F.array(F.struct(F.lit(1).alias("seg"), second.alias("val"))),
        )
        return prints.select("fp", F.inline(cells))

    index, probes = keyed(F.array(first)), keyed(_ball(first, SEGMENT_BITS))
    crowded = staged(
        index.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED)
        .select("seg", "val"),
        "crowded",
    )
    some_crowded = not crowded.isEmpty()
    sparse = index.join(crowded, ["seg", "val"], "left_anti") if some_crowded else index
    found = (
        probes.withColumnRenamed("fp", "a")
        .join(sparse.withColumnRenamed("fp", "b"), ["seg", "val"])
        .filter("a < b AND bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    if not some_crowded:
        return found
    # the ball holds the value itself, so every member of a crowded entry is here too
    dense = probes.join(crowded, ["seg", "val"], "left_semi").select("fp").distinct()
    points = dense.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("point"))
    stars = (
        points.select("fp", F.min("fp").over(Window.partitionBy("point")).alias("least"))
        .filter("least < fp")
        .select(F.col("least").alias("a"), F.col("fp").alias("b"))
    )
    return found.union(stars)


def grouped(signed: DataFrame, lowest: Column) -> DataFrame:
    """(fp, lowest) per distinct fingerprint; ``lowest`` over its whole component.

    ``signed`` is a written table with ``fp``; ``lowest`` is an expression over its
    columns whose least value names the component.
    """
    per_print = staged(signed.groupBy("fp").agg(F.min(lowest).alias("_low")), "prints")
    roots = components(links(per_print.select("fp")))
    with_root = staged(
        per_print.join(roots, per_print.fp == roots.node, "left").select(
            "fp", "_low", F.coalesce("root", "fp").alias("_root")
        ),
        "rooted",
    )
    least = with_root.groupBy("_root").agg(F.min("_low").alias("lowest"))
    return staged(with_root.join(least, "_root").select("fp", "lowest"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated
    rows stay repeated. ``component_id`` is the least non-null doc_id reachable; it
    is null where no row of the component has one. An empty table gives no rows.
    """
    signed = staged(fingerprints(docs.select("doc_id", "text")), "signed")
    groups = grouped(signed, F.col("doc_id"))
    return signed.join(groups, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lowest").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id.

    A null doc_id comes after all others; among rows of one doc_id the least hash of
    the whole row decides, and of rows equal in every column one stays. All columns
    are kept.
    """
    row, fp, text, n, low = free_names(docs, "_row", "fp", "_text", "_n", "_low")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    slim = docs.select("doc_id", whole.alias("_row"), F.col("text").alias("_text"))
    signed = staged(fingerprints(slim, "_text"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    groups = grouped(signed, order)
    chosen = staged(
        groups.select("lowest").distinct().join(
            signed.groupBy("doc_id", "_row").agg(F.count(F.lit(1)).alias("_n")),
            F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("_row") == F.col("lowest._row")),
        ).select(F.col("doc_id").alias(low), F.col("_row").alias(row), F.col("_n").alias(n)),
        "chosen",
    )
    marked = docs.withColumn(text, whole)
    match = marked["doc_id"].eqNullSafe(chosen[low]) & (marked[text] == chosen[row])
    single = marked.join(chosen.filter(F.col(n) == 1), match, "left_semi")
    if not chosen.filter(F.col(n) > 1).isEmpty():
        repeated = marked.join(chosen.filter(F.col(n) > 1), match, "left_semi")
        single = single.unionByName(repeated.dropDuplicates(["doc_id", text]))
    return single.select(*docs.columns)
